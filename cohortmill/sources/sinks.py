"""Sinks for cohort, feature, flag and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_parquet(df: DataFrame, path: str, buckets: int | None = None, key: str | None = None) -> None:
    """Overwrite a Parquet table.

    With ``buckets`` the rows are laid out in folders by a hash of ``key``; the
    rows of one key stay together for later per-entity work, while a salt
    from the whole row spreads a huge key over eight write tasks.
    """
    if buckets and key:
        slot = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        salted = df.withColumn("entity_bucket", slot).repartition(
            F.col("entity_bucket"), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
        salted.write.mode("overwrite").partitionBy("entity_bucket").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_metrics(df: DataFrame, path: str) -> None:
    """Metric tables as JSON lines; curves grow with the scores, so tasks write their own files."""
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str, metrics: tuple[str, ...] = ()) -> dict[str, str]:
    """Write the tables of a plan to folders of their names, those in ``metrics`` as JSON lines; returns the folders."""
    folders = {name: f"{path}/{name}" for name in tables}
    for name, df in tables.items():
        if name in metrics:
            write_json_metrics(df, folders[name])
        else:
            write_parquet(df, folders[name])
    return folders
