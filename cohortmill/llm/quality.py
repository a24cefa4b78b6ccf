"""Quality by importance resampling over hashed n-grams, sampled by Gumbel top-k.

Two generative models give each hashed n-gram a probability: one of target text
(documents labelled as good) and one of raw text (all documents). A document's
log-weight is what ``TEMPER`` of its n-grams give on average, the same rule at
every length. Adding Gumbel noise and taking the k largest draws k documents
without replacement in proportion to weight.

``k`` is the caller's: a sample takes fewer documents than look good. As a
filter (``keep_good``), k is the number of documents that weigh at least what
nearly all labelled good ones do.

The n-grams are words, word pairs (all pairs of a word with itself count as one)
and pairs of word shapes. Counting and scoring are one pass each over whole
texts, without a shuffle of texts; only bucket counts move.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortmill.llm import base
from cohortmill.llm.words import BLANK, Group, groups, mixed, spelling

#: Buckets of the words and of the word pairs; shapes have a bucket for each pair.
BUCKETS, SHAPES = 1 << 16, 64 * 64
SIZES = (BUCKETS, BUCKETS, SHAPES)
TOTAL = sum(SIZES)
#: Labelled target documents that are used: those with the smallest hash of their key.
TARGET_DOCUMENTS = 20_000
#: Counts by which a ratio is drawn towards one, so that rare n-grams say little.
SHRINK = 30.0
#: A document weighs what so many of its n-grams do on average; more make a sample stricter.
TEMPER = 40.0
#: Share of the labelled good documents that may weigh less than those a filter counts.
MISSED = 0.001
#: Rows that may come to the driver to settle the cut exactly.
CUT_ROWS = 10_000


class Model(NamedTuple):
    """Counts of target and raw text by bucket, and the target's share of the stream that a bucket is in."""
    target: np.ndarray
    raw: np.ndarray
    share: np.ndarray


class Cut(NamedTuple):
    model: Model
    cut: float


def features(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """(row in the group, bucket) of every n-gram."""
    h, kinds = group.hashes, group.kinds.astype(np.int64)
    row = np.repeat(np.arange(len(group.bounds) - 1), np.diff(group.bounds))
    same_row = row[1:] == row[:-1]
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[:-1] == h[1:]] = 0
    place = np.uint64(BUCKETS - 1)
    return (np.concatenate((row, row[1:][same_row], row[1:][same_row])),
            np.concatenate(((h & place).astype(np.int64), BUCKETS + (pair[same_row] & place).astype(np.int64),
                            2 * BUCKETS + (kinds[:-1] * 64 + kinds[1:])[same_row])))


def model_of(target: np.ndarray, raw: np.ndarray) -> Model:
    share, at = np.zeros(TOTAL), 0
    for size in SIZES:
        part = slice(at, at + size)
        share[part] = target[part].sum() / max(1, raw[part].sum())
        at += size
    return Model(target, raw, share)


def log_weights(group: Group, good: np.ndarray, model: Model) -> np.ndarray:
    """Mean over a row's n-grams of the log of observed over expected target count, both shrunk, times ``TEMPER``.

    A document's own n-grams are taken out of the counts it is held against, of
    the target's too if it is one of the target documents. No n-gram: 0.
    """
    n = len(group.bounds) - 1
    row, bucket = features(group)
    cells, own = np.unique(row * TOTAL + bucket, return_counts=True)
    row, bucket = cells // TOTAL, cells % TOTAL
    target = model.target[bucket] - np.where(good[row], own, 0)
    expected = (model.raw[bucket] - own) * model.share[bucket]
    total = np.bincount(row, own * np.log((target + SHRINK) / (expected + SHRINK)), minlength=n)
    return TEMPER * total / np.maximum(np.bincount(row, own, minlength=n), 1)


def good_keys(labels: DataFrame, key: str) -> DataFrame:
    """(_id): keys of the documents that are labelled as good."""
    return labels.filter("quality = 1").select(base.named(key).alias("_id")).filter("_id is not null").distinct()


def target_rows(rows: DataFrame, labels: DataFrame, key: str, documents: int) -> DataFrame:
    """``rows`` with ``_good``: whether ``_id`` is one of the target documents."""
    good = good_keys(labels, key).orderBy(F.xxhash64("_id"), "_id").limit(documents).withColumn("_hit", F.lit(True))
    return rows.join(F.broadcast(good), "_id", "left").withColumn("_good", F.coalesce("_hit", F.lit(False))).drop("_hit")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        documents: int = TARGET_DOCUMENTS) -> Model:
    """Counts of all buckets.

    ``labels`` has the key and ``quality`` (1: good). Raw counts cover all
    documents; target counts cover up to ``documents`` labelled ones. Without
    any target text all log-weights are 0.
    """
    rows = target_rows(docs.select(base.named(key).alias("_id"), base.named(text).cast("string").alias("_text")),
                       labels, key, documents).select("_good", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, TOTAL), np.int64)
        for batch in batches:
            good = batch.column("_good").to_numpy(zero_copy_only=False)
            for group in groups(batch.column("_text"), spelling(BLANK, lower=False)):
                row, bucket = features(group)
                totals[0] += np.bincount(bucket, minlength=TOTAL)
                totals[1] += np.bincount(bucket[good[group.first + row]], minlength=TOTAL)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[0][used]),
                                          pa.array(totals[1][used])], ["bucket", "raw", "target"])

    parts = rows.mapInArrow(count, "bucket int, raw bigint, target bigint")
    raw, target = np.zeros(TOTAL), np.zeros(TOTAL)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return model_of(target, raw)


def noise(seed: int | Column, *columns: Column) -> Column:
    """Standard Gumbel noise from a hash, so that a rerun draws the same and another seed differently."""
    seeded = F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), *columns)
    share = (F.shiftrightunsigned(seeded, 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(share))


def score(docs: DataFrame, model: Model, labels: DataFrame, key: str = "doc_id", text: str = "text",
          documents: int = TARGET_DOCUMENTS, seed: int = 0, keep_text: bool = False, cut: float | None = None) -> DataFrame:
    """Columns of ``docs`` (the text only if asked), ``log_weight`` and ``draw`` (log-weight plus noise).

    Rows with a draw below ``cut`` are left out. A text without words (also a
    null one) has log-weight 0. Input columns named like a result are replaced.
    """
    carried = [c for c in base.beside(docs, ["log_weight", "draw"]) if keep_text or c != text]
    rows = target_rows(docs.select(
        F.struct(*[base.named(c) for c in carried]).alias("_row"), base.named(key).alias("_id"),
        noise(seed, base.named(key), base.named(text)).alias("_noise"), base.named(text).cast("string").alias("_text")),
        labels, key, documents).select("_row", "_noise", "_good", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known = bool(model.target.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.zeros(batch.num_rows)
            good = batch.column("_good").to_numpy(zero_copy_only=False)
            for group in groups(batch.column("_text"), spelling(BLANK, lower=False)) if known else ():
                part = slice(group.first, group.first + len(group.bounds) - 1)
                weights[part] = log_weights(group, good[part], shared.value)
            weights = np.round(weights, 6)
            draw = weights + batch.column("_noise").to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(weights), pa.array(draw)],
                                             ["_row", "log_weight", "draw"])
            yield out if cut is None else out.filter(pa.array(draw >= cut))

    schema = rows.select("_row").schema.add("log_weight", T.DoubleType()).add("draw", T.DoubleType())
    return rows.mapInArrow(run, schema).select("_row.*", "log_weight", "draw")


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, found by counting in ever narrower ranges; -inf if there are fewer.

    Each round is one aggregation to at most 4,096 counts.
    """
    ends = values.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if k <= 0:
        return float("inf")
    if ends["n"] <= k:
        return float("-inf")
    lo, hi, left, parts = ends["lo"], ends["hi"], k, 4096
    while True:
        inside = values.filter(F.col(column).between(lo, hi))
        step = (hi - lo) / parts
        if step <= 0 or lo + step <= lo or hi - step >= hi:
            return lo
        bucket = F.least(F.floor((F.col(column) - lo) / step), F.lit(parts - 1)).alias("bucket")
        counts = inside.groupBy(bucket).agg(F.count("*").alias("n"), F.min(column).alias("lo"),
                                            F.max(column).alias("hi")).collect()
        for row in sorted(counts, key=lambda r: -r["bucket"]):
            if left <= row["n"]:
                break
            left -= row["n"]
        lo, hi = row["lo"], row["hi"]
        if row["n"] <= CUT_ROWS:
            rest = values.filter(F.col(column).between(lo, hi)).select(column).collect()
            return sorted((r[0] for r in rest), reverse=True)[left - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int, key: str = "doc_id", text: str = "text", seed: int = 0,
             documents: int = TARGET_DOCUMENTS) -> tuple[DataFrame, Cut]:
    """Scored rows without their texts (stored), and the model with the draw that the k-th document has.

    Rows that tie with the k-th are all in; with k rows or fewer, all rows are.
    """
    model = fit(docs, labels, key, text, documents)
    scored = base.stored(score(docs, model, labels, key, text, documents, seed), "quality-scores")
    return scored, Cut(model, kth_largest(scored, "draw", k))


def number_good(scored: DataFrame, labels: DataFrame, key: str = "doc_id", missed: float = MISSED) -> int:
    """How many rows weigh at least what all but a share ``missed`` of the labelled good ones do; all rows without labels.

    ``scored`` is stored and has the key and ``log_weight``.
    """
    good = base.stored(scored.withColumnRenamed(key, "_id").join(good_keys(labels, key), "_id", "leftsemi").select(
        "log_weight"), "quality-good")
    n = good.count()
    if not n:
        return scored.count()
    least = good.agg(F.min("log_weight")).first()[0] if int(n * missed) == 0 else kth_largest(good, "log_weight", n - int(n * missed))
    return scored.filter(F.col("log_weight") >= least).count()


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
              missed: float = MISSED, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that a sample of k holds, with all columns; without k, of ``number_good`` rows."""
    marked = docs.select(F.struct(*[base.named(c) for c in docs.columns]).alias("_own"), base.named(key).alias("_key"),
                         base.named(text).alias("_body"))
    labels = labels.select(base.named(key).alias("_key"), "quality")
    model = fit(marked, labels, "_key", "_body")
    scored = base.stored(score(marked.select("_key", "_body"), model, labels, "_key", "_body", seed=seed), "quality-scores")
    if k is None:
        k = number_good(scored, labels, "_key", missed)
    kept = score(marked, model, labels, "_key", "_body", seed=seed, cut=kth_largest(scored, "draw", k))
    return kept.select("_own.*")
