"""Sources: CSV with a declared schema, Parquet, JSON metrics, optional inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, matched by column name; text that does not fit its type becomes null.

    Every column is read as text and cast leniently, so a bad value nulls one
    cell, not the row, and columns may stand in any order. A missing file
    raises. Columns that are not in the file come back as null.
    """
    text = spark.read.csv(path, header=True, inferSchema=False)
    return text.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in text.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_metrics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Metrics as one JSON document per file, or, with ``lines``, one object per line."""
    return spark.read.json(path, multiLine=not lines)


def try_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Optional Parquet source: an empty typed table when the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
