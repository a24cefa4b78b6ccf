"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors are made of integers. Candidates lie in blocks, dimension by dimension.
An anchor reads the dimensions in descending order of its own magnitude there;
what the unread ones can still add lies between two bounds from each dimension's
least and greatest value in the block. A bitmap holds the candidates that may
still matter; it shrinks as the bounds close, and what is left at the end has
been summed exactly.

Two scans: the first finds each anchor's positives, the best rows of its own
label. Their scores open windows, and the second scan finds the best rows of
other labels inside each window. Blocks of anchors meet blocks of candidates in
cells of bounded size; only a cell's best rows leave it.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.llm import base

#: Anchors and candidates in a cell; candidates and dimensions that are read at once inside it.
ANCHOR_BLOCK, CANDIDATE_BLOCK, ROWS, STEP = 2048, 16_384, 4096, 8
#: Components reach at most so far from zero, so that a sum of up to 4,096 products is exact.
LARGEST = 1 << 25

POSITIVES, WINDOWS = "positives", "windows"


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Stored rows that take part: no (unique), id, label, v (integers).

    Left out: null labels and vectors, vectors with a null or non-finite
    component, and those whose scaled components exceed ``LARGEST``, as their
    scores need not fit into a bigint. Null and repeated keys take part.
    """
    x = F.transform(base.named(vector).cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))
    sound = F.forall(base.named(vector).cast("array<double>"), lambda c: c.isNotNull() & (
        F.abs(c) * float(scale) < float(LARGEST)))
    rows = vectors.select(
        base.named(key).cast("bigint").alias("id"), base.named(label).cast("bigint").alias("label"),
        F.when(F.coalesce(sound, F.lit(False)), x).cast("array<int>").alias("v"))
    return base.stored(rows.filter("v is not null and label is not null").withColumn(
        "no", F.monotonically_increasing_id()), "bond-rows")


class Block:
    """Candidates dimension by dimension, with each dimension's least and greatest value."""

    def __init__(self, v: np.ndarray, no: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.columns = np.ascontiguousarray(v.T)
        self.no, self.ids, self.labels = no, ids, labels
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, matters: Callable[[np.ndarray, np.ndarray], np.ndarray]
             ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates in the bitmap that still matter when all dimensions are read.

        ``matters`` judges candidates by the lowest and highest score they can reach.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack((anchor * self.low, anchor * self.high))[:, order]
        least, most = (np.concatenate((np.cumsum(e[::-1])[::-1], [0])) for e in (ends.min(axis=0), ends.max(axis=0)))
        rows = np.flatnonzero(bitmap)
        sums = np.zeros(len(rows), self.columns.dtype)
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            sums = sums + anchor[dims] @ self.columns[dims[:, None], rows]
            rest = min(at + STEP, len(order))
            kept = matters(sums + least[rest], sums + most[rest])
            if not kept.all():
                rows, sums = rows[kept], sums[kept]
            if not len(rows):
                break
        return rows, sums


def largest(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Best:
    """The best k (score, id, no) so far: higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.found = k, np.zeros((0, 3), np.int64)

    @property
    def bar(self) -> float:
        """A score below this changes nothing."""
        return self.found[-1, 0] if len(self.found) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, no: np.ndarray) -> None:
        both = np.concatenate((self.found, np.stack((scores.astype(np.int64), ids, no), axis=1)))
        self.found = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:self.k]]


def blocks_of(batch: pa.Table, exact: type) -> list[Block]:
    v = np.stack(batch.column("v").to_numpy()).astype(exact)
    no, ids, labels = (batch.column(c).to_numpy() for c in ("no", "id", "label"))
    return [Block(v[i:i + ROWS], no[i:i + ROWS], ids[i:i + ROWS], labels[i:i + ROWS]) for i in range(0, len(v), ROWS)]


def best_positives(anchor: np.ndarray, no: int, label: int, blocks: list[Block], k: int) -> Best:
    best = Best(k)
    for b in blocks:
        def matters(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= max(best.bar, largest(low, k))

        rows, scores = b.scan(anchor, (b.labels == label) & (b.no != no), matters)
        best.add(scores, b.ids[rows], b.no[rows])
    return best


def best_negatives(anchor: np.ndarray, label: int, windows: list[tuple[int, int]], blocks: list[Block], k: int) -> list[Best]:
    """The best of each window (least, greatest score)."""
    bests = [Best(k) for _ in windows]
    for b in blocks:
        def matters(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(low), bool)
            for (first, last), best in zip(windows, bests):
                sure = low[(low >= first) & (high <= last)]
                kept |= (low <= last) & (high >= max(first, best.bar, largest(sure, k)))
            return kept

        rows, scores = b.scan(anchor, b.labels != label, matters)
        for (first, last), best in zip(windows, bests):
            inside = (scores >= first) & (scores <= last)
            best.add(scores[inside], b.ids[rows[inside]], b.no[rows[inside]])
    return bests


def cells(anchors: DataFrame, rows: DataFrame, k: int, what: str) -> DataFrame:
    """(anchor, score of the window, no, id, score): the up to k best of every cell.

    ``anchors`` has no, label, v and, for windows, an array of (of, first, last).
    A null id is carried as the greatest bigint, behind all others.
    """
    # Only vectors of one length have an inner product.
    sized = lambda df: df.withColumn("dims", F.size("v"))
    asked, all_ = sized(anchors), sized(rows)
    counts = base.stored(all_.groupBy("dims").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("row_blocks")).join(
        asked.groupBy("dims").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("anchor_blocks")), "dims"), "bond-cells")

    def dealt(df: DataFrame, own: str, other: str, *more: str) -> DataFrame:
        return df.join(counts, "dims").select(
            "dims", F.pmod(F.xxhash64("no"), F.col(f"{own}_blocks")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other),
            "no", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "label", "v", *more)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            vectors = np.stack(left.column("v").to_numpy()).astype(np.int64)
            reach = int(np.abs(vectors).max(initial=0))
            for b in right.column("v").to_numpy():
                reach = max(reach, int(np.abs(b).max(initial=0)))
            # Doubles hold these sums exactly up to 2^53 and are faster; beyond that bigints do.
            exact = np.float64 if reach * reach * max(1, vectors.shape[1]) < 1 << 52 else np.int64
            blocks, vectors = blocks_of(right, exact), vectors.astype(exact)
            labels, no = left.column("label").to_numpy(), left.column("no").to_numpy()
            opened = left.column("windows").to_pylist() if what == WINDOWS else [None] * len(no)
            for i, v in enumerate(vectors):
                if what == POSITIVES:
                    out.append((no[i], None, best_positives(v, no[i], labels[i], blocks, k).found))
                else:
                    spans = [(w["first"], w["last"]) for w in opened[i]]
                    for w, best in zip(opened[i], best_negatives(v, labels[i], spans, blocks, k)):
                        out.append((no[i], w["of"], best.found))
        found = np.concatenate([f for *_, f in out]) if out else np.zeros((0, 3), np.int64)
        times = [len(f) for *_, f in out]
        return pa.table({
            "anchor": pa.array(np.repeat([a for a, *_ in out], times), pa.int64()),
            "of": pa.array([o for (_, o, f) in out for _ in range(len(f))], pa.int64()),
            "no": found[:, 2], "id": found[:, 1], "score": found[:, 0]})

    keys = ["dims", "anchor", "row"]
    asked = dealt(asked, "anchor", "row", *(["windows"] if what == WINDOWS else []))
    return asked.groupBy(*keys).cogroup(dealt(all_, "row", "anchor").groupBy(*keys)).applyInArrow(
        cell, "anchor bigint, of bigint, no bigint, id bigint, score bigint")


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of all cells with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "no")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, asked: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key fulfils ``asked``; a row's score is its inner
    product with the anchor, after every component x became floor(scale * x).
    Higher scores come first, ties by smaller key, a null key last. For each
    anchor and each of its first ``positives`` other rows of the same label: the
    first ``negatives`` rows of other labels with a score of ``low`` to ``high``
    percent of the positive's (so none if that is negative). Rows that lack
    something take no part (``usable``); vectors meet those of their own length
    only. Repeated keys are rows of their own, also as anchors.
    """
    rows = usable(vectors, key, vector, label, scale)
    anchors = base.stored(rows.filter(asked(F.col("id"))), "bond-anchors")
    best = base.stored(ranked(cells(anchors, rows, positives, POSITIVES), ["anchor"], positives).select(
        "anchor", F.col("id").alias("positive"), F.col("score").alias("of")), "bond-positives")
    # The scores s with low * of <= 100 * s <= high * of.
    exact = F.col("of").cast("decimal(19,0)")
    first, last = F.ceil(exact * F.lit(Decimal(low) / 100)).cast("bigint"), F.floor(exact * F.lit(Decimal(high) / 100)).cast("bigint")
    spans = best.select("anchor", F.struct("of", first.alias("first"), last.alias("last")).alias("w")).filter(
        "w.first <= w.last").groupBy(F.col("anchor").alias("no")).agg(F.collect_set("w").alias("windows"))
    opened = base.stored(anchors.join(spans, "no"), "bond-windows")
    found = ranked(cells(opened, rows, negatives, WINDOWS), ["anchor", "of"], negatives)
    shown = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c))
    named = anchors.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id"))
    return best.join(found.select("anchor", "of", "rank", "id", "score"), ["anchor", "of"]).join(named, "anchor").select(
        "anchor_id", shown("positive").alias("positive_id"), "rank", shown("id").alias("negative_id"),
        F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))
