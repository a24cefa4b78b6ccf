"""Helpers that all operators share: written intermediates, column rules, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortmill.session import checkpoint_dir

# Rows per Arrow batch handed to Python. Documents may be long, so few at a time.
BATCH_ROWS = 500

SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(df: DataFrame, results: list[str]) -> list[str]:
    """Input columns that are carried along: a result column replaces one of the same name."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage ends here.

    Columns keep their order; a lost executor re-reads files instead of
    repeating the work behind them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files behind a ``stored`` table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key that holds at least one in so many rows counts as hot; there are at most that many such keys.
HOT_SHARE = 1000


def with_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` left-joined with ``table``: one row per key, its ``count`` saying how many rows have that key.

    Hot keys, at most ``HOT_SHARE`` by their definition, are broadcast, so their
    rows stay where they are; only the other rows are shuffled. Both sides are
    read more than once, so pass stored tables. Null keys match nothing.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(count) * HOT_SHARE >= total
    few = F.broadcast(table.filter(hot))
    cold = rows.join(few.select(*keys), keys, "leftanti").join(table.filter(~hot), keys, "left")
    return rows.join(few, keys).unionByName(cold)


#: Bits of a piece of a bitmap (fixed by Spark), most pieces, and bits per key that is marked.
PIECE_BITS, MOST_PIECES, BITS_PER_KEY = 32_768, 4096, 16


def bitmap_of(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(pieces, their number): a bitmap of the hashes in column ``h``, of 16 MB at most.

    More hashes make it denser, not larger. Pass a stored table.
    """
    pieces = min(MOST_PIECES, max(1, -(-hashes.count() * BITS_PER_KEY // PIECE_BITS)))
    place = F.pmod(F.col("h"), F.lit(pieces * PIECE_BITS))
    return hashes.groupBy(F.floor(place / PIECE_BITS).alias("_piece")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(PIECE_BITS))).alias("_bits")), pieces


def marked(rows: DataFrame, h: Column, bitmap: tuple[DataFrame, int], out: str) -> DataFrame:
    """Adds ``out``: whether the bitmap marks the hash. True for every hash it was made of, and rarely for another."""
    pieces, n = bitmap
    placed = rows.withColumn("_place", F.pmod(h, F.lit(n * PIECE_BITS))).withColumn(
        "_piece", F.floor(F.col("_place") / PIECE_BITS))
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(F.pmod("_place", F.lit(PIECE_BITS)), 3).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("int"), F.pmod("_place", F.lit(8)).cast("int")) == 1
    # At most MOST_PIECES rows of 4 KB.
    return placed.join(F.broadcast(pieces), "_piece", "left").withColumn(out, F.coalesce(bit, F.lit(False))).drop(
        "_piece", "_bits", "_place")


def ranged(rows: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """Stored rows with ``part``, the number of the range of ``keys`` that a row lies in.

    Ranges are contiguous and ascend with their number, so totals of whole ranges
    turn sums inside ranges into running sums over everything, and no key's rows
    must meet in one task. The last key should tell all rows apart. Pass a stored table.
    """
    return stored(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), label)
