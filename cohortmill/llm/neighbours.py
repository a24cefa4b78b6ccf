"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``PERMUTATION`` nearest pivots in order of
nearness, and posted in the inverted files of the first ``POSTED`` of them. A
query probes the files of its first ``PROBED`` pivots, ranks what it finds there
by the footrule distance of the two pivot orders, and reranks the nearest by the
inner product of the original vectors.

Pivots are vectors themselves, the ones with the smallest hash of their id. Their
number grows with the square root of the table, so files and probes do too. A
full file is dealt out in blocks of bounded size, and so are its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cohortmill.llm import base

PERMUTATION, POSTED, PROBED = 64, 8, 32
#: Pivots, and candidates that a query reranks in a file, per square root of the rows; most pivots, fewest candidates.
PIVOT_RATE, RERANK_RATE, MOST_PIVOTS, LEAST_RERANKED = 1.2, 1.5, 16_384, 100
#: Vectors and queries in a cell.
FILE_BLOCK, QUERY_BLOCK = 4096, 1024


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows that take part, one per key.

    Left out: null keys and vectors; vectors that are empty, zero, or hold a
    null or non-finite component; vectors of another length than most (of
    equally common lengths the greatest counts). Of rows with the same key the
    one with the smallest vector stays.
    """
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    values = base.named(vector).cast("array<float>" if single else "array<double>")
    rows = vectors.select(base.named(key).alias("id"), values.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (common["n"] if common else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def pivots_of(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(pivots, number of rows)."""
    n = rows.count()
    wanted = min(MOST_PIVOTS, max(1, int(PIVOT_RATE * math.sqrt(n))))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
    return np.array([r["v"] for r in chosen], np.float32), n


def permuted(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``near``: the indexes of the nearest pivots, nearest first; ties to the smaller index."""
    m = min(PERMUTATION, len(pivots))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(parts):
        for part in parts:
            near = np.zeros((0, m), np.int16)
            if len(part):
                scores = np.stack(part["v"].to_numpy()).astype(np.float32) @ shared.value.T
                top = np.sort(np.argpartition(-scores, m - 1, axis=1)[:, :m], axis=1)
                order = np.argsort(-np.take_along_axis(scores, top, axis=1), axis=1, kind="stable")
                near = np.take_along_axis(top, order, axis=1)
            yield part.assign(near=list(near.astype(np.int16)))

    kind, values = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, v {values}, near array<smallint>")


def footrule_table(query: np.ndarray, length: int, pivots: int) -> tuple[np.ndarray, int]:
    """What a pivot at a place of another order adds to the footrule distance, by place and pivot, and a constant.

    A pivot that one of the two orders lacks stands behind its last place.
    """
    place = np.full(pivots, length, np.int32)
    place[query] = np.arange(len(query))
    table = np.abs(place[None, :] - np.arange(length)[:, None]) + (place - length)[None, :]
    return table.ravel(), int((length - np.arange(len(query))).sum())


def footrule(query: np.ndarray, near: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances of one pivot order to many, of one length."""
    table, constant = footrule_table(query, near.shape[1], pivots)
    return table.take(near + np.arange(near.shape[1]) * pivots).sum(axis=1) + constant


def search_cells(queries: DataFrame, files: DataFrame, pivots: int, k: int, probed: int, reranked: int) -> DataFrame:
    """(query_id, vec_id, score): up to k per query and cell."""
    kind = queries.schema["id"].dataType.simpleString()
    # New names for the queries' columns: both sides may come from one table.
    asked = queries.select(*[F.col(c).alias(c) for c in ("id", "v", "near")], F.explode(F.slice("near", 1, probed)).alias("pivot"))
    posts = files.select("id", "v", "near", F.explode(F.slice("near", 1, POSTED)).alias("pivot"))
    sizes = posts.groupBy("pivot").agg(F.ceil(F.count("*") / FILE_BLOCK).cast("int").alias("file_blocks")).join(
        asked.groupBy("pivot").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), "pivot")
    # One row per pivot, and pivots are bounded.
    sizes = F.broadcast(base.stored(sizes, "ann-sizes"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return rows.join(sizes, "pivot").select(
            "pivot", F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other), "id", "v", "near")

    def cell(asked: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        owns, found, nearness = [np.zeros(0, object)], [np.zeros(0, object)], [np.zeros(0)]
        if len(asked) and len(posted):
            ids = posted["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            near = np.stack(posted["near"].to_numpy())[order].astype(np.int64)
            length = near.shape[1]
            near += np.arange(length) * pivots
            vectors = np.stack(posted["v"].to_numpy())[order].astype(np.float64)
            for own, v, their in zip(asked["id"], asked["v"], asked["near"]):
                table, constant = footrule_table(np.asarray(their, np.int64), length, pivots)
                apart = table.take(near).sum(axis=1) + constant
                apart[ids == own] = np.iinfo(np.int32).max
                cut = min(reranked, len(ids))
                # Everything as near as the last one that is reranked goes along.
                kept = np.flatnonzero(apart <= np.partition(apart, cut - 1)[cut - 1])
                kept = kept[ids[kept] != own]
                scores = vectors[kept] @ np.asarray(v, np.float64)
                best = np.lexsort((ids[kept], -scores))[:k]
                owns.append(np.full(len(best), own, object))
                found.append(ids[kept][best].astype(object))
                nearness.append(scores[best])
        return pd.DataFrame({"query_id": np.concatenate(owns), "vec_id": np.concatenate(found),
                             "score": np.concatenate(nearness)})

    keys = ["pivot", "file", "query"]
    return dealt(asked, "query", "file").groupBy(*keys).cogroup(dealt(posts, "file", "query").groupBy(*keys)).applyInPandas(
        cell, f"query_id {kind}, vec_id {kind}, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asked, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that fulfils ``asked``.

    ``asked`` is a function of the column ``id``. Nearness is the inner product,
    in double precision on the original vectors; a row is not its own neighbour.
    Queries that find fewer than k rows, though there are more, probe all files
    without a cut, which finds every row.
    """
    rows = base.stored(usable(vectors, key, vector), "ann-vectors")
    pivots, n = pivots_of(rows)
    if n < 2:
        return vectors.sparkSession.createDataFrame(
            [], f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id "
                f"{rows.schema['id'].dataType.simpleString()}, score double")
    index = base.stored(permuted(rows, pivots), "ann-index")
    queries = index.filter(asked(F.col("id")))
    reranked = max(LEAST_RERANKED, int(RERANK_RATE * math.sqrt(n)))
    found = base.stored(best(search_cells(queries, index, len(pivots), k, PROBED, reranked), k), "ann-found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1))
    short = base.stored(queries.join(enough, queries["id"] == enough["query_id"], "leftanti"), "ann-short")
    if short.isEmpty():
        return found
    near = F.transform(F.sequence(F.lit(0), F.lit(len(pivots) - 1)), lambda i: i.cast("smallint"))
    whole = search_cells(short.withColumn("near", near), index, len(pivots), k, len(pivots), 1 << 30)
    return found.join(short, found["query_id"] == short["id"], "leftanti").unionByName(best(whole, k))
