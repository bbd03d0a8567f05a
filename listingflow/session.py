"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Group limits below the shuffle also for the chunks of the resolution rounds.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
    # No call-site capture: it costs more than planning for wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def spark_session(app: str = "listingflow", **conf: str) -> SparkSession:
    """Session with the defaults above; master and sizes come from the caller or cluster."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="listingflow-")
    sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared checkpoint folder, and go on from the files.

    Used between rounds of iterative operators and where one result feeds several
    plans.  The data survives a lost executor and the plan does not grow; unlike
    an RDD checkpoint the files keep column pruning and size statistics.  They are
    compressed harder than Spark's default, as they are most of what a job writes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/listingflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def no_match_key() -> Column:
    """A key that matches nothing and differs from row to row: outer-join rows without a key
    are dealt to all tasks by it, not to the one task of the null key."""
    return F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))


def python_partitions(spark: SparkSession) -> int:
    """Partitions of a stage whose cost is Python work, not bytes.

    AQE sizes shuffles by bytes and would put a few megabytes of titles into one
    task; an explicit partition number is left alone by it.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
