"""Session settings and materialisation points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Feature tables are wider than Spark's default of 100 fields, above which
# whole-stage code generation is switched off.
RUNTIME_CONF = {
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The memory of a task follows the bytes it reads, some 30 times over for measurements: small pieces of
    # the files, and small shuffle partitions, of which there are enough before adaptive execution merges them.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
}


def local_session(app: str = "cohortmill", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the wide aggregates rely on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    that has none gets a temporary folder; on a cluster that would be a folder
    the other machines cannot see, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="cohortmill-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    Like ``materialize``, and Spark then knows its size in bytes when it joins.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate to the checkpoint folder and read it back.

    Used for compact tables (counts per distinct score, cohort keys, encoded
    model rows) that several jobs read: the raw scan behind them then runs once, and losing
    an executor does not run it again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
