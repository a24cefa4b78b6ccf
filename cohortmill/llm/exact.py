"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal if they are identical after every run of white space became one
space. Rows are told apart by ever dearer tests: the length, then a hash of the
first characters, then a hash of everything. Each test is made only for rows
that the one before left together with another row.

What survives a test reaches the rows as a bitmap of at most 16 MB. It may let a
row through by chance, which costs a hash and changes no result. So texts are
read where they lie, twice, and never shuffled; lengths and hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.llm import base

RESULTS = ["keep_id", "group_size", "kept"]
#: Characters that the hash of the beginning covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text that is compared; a null one is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"[{base.SPACES}]+", " ")


def survivors(keys: DataFrame) -> tuple[DataFrame, int]:
    """Bitmap of the (length, beginning) pairs that several rows share.

    ``keys`` is a stored table with columns length and beginning.
    """
    lengths = base.stored(keys.groupBy("length").count().filter("count > 1").select(
        F.xxhash64("length").alias("h")), "exact-lengths")
    alike = base.marked(keys, F.xxhash64("length"), base.bitmap_of(lengths), "_alike").filter("_alike")
    pairs = base.stored(alike.groupBy("length", "beginning").count().filter("count > 1").select(
        F.xxhash64("length", "beginning").alias("h")), "exact-pairs")
    return base.bitmap_of(pairs)


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: all its columns (or those in ``carry``), keep_id, group_size, kept.

    keep_id is the key of the row that stays of all rows with an equal text: the
    one with the smallest key, a null key last. Of several such rows exactly one
    stays. A null text is empty, and empty texts are equal. Input columns named
    like a result are replaced, all other names are free. An empty table gives
    an empty result.
    """
    carried = [c for c in base.beside(docs, RESULTS) if carry is None or c in carry]
    shaped = docs.select(F.struct(*[base.named(c) for c in carried]).alias("_row"), base.named(key).alias("_id"),
                         normalised(base.named(text)).alias("_text"))
    lengths = [F.octet_length("_text").alias("length"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("beginning")]
    shared = survivors(base.stored(shaped.select(*lengths), "exact-keys"))

    measured = shaped.select("*", *lengths)
    rows = base.stored(base.marked(measured, F.xxhash64("length", "beginning"), shared, "_alike").select(
        "_row", "_id", F.when(F.col("_alike"), F.sha2("_text", 256)).alias("_hash"),
        F.xxhash64("_row").alias("_tie"), F.monotonically_increasing_id().alias("_no")), "exact-rows")
    alone = [F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")]
    hashed = rows.filter("_hash is not null")
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_tie", "_no")).alias("_first")
    groups = base.stored(hashed.groupBy("_hash").agg(F.count("*").alias("_n"), first).filter("_n > 1"), "exact-groups")
    together = base.with_counted(hashed, groups, ["_hash"], "_n")
    single = F.col("_n").isNull()
    return rows.filter("_hash is null").select("_row.*", *alone).unionByName(together.select(
        "_row.*", F.when(single, F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).alias("group_size"), (single | (F.col("_no") == F.col("_first._no"))).alias("kept")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only texts that share a beginning are shuffled."""
    renamed = {c: f"_own_{c}" for c in docs.columns if c.lower() in RESULTS}
    back = {v: k for k, v in renamed.items()}
    kept = mark(docs.withColumnsRenamed(renamed), renamed.get(key, key), renamed.get(text, text)).filter("kept")
    return kept.drop(*RESULTS).withColumnsRenamed(back).select(*[base.named(c) for c in docs.columns])
