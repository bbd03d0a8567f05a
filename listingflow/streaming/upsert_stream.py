"""Micro-batch upsert of a listing stream into a bucketed table.

The table is a Parquet folder partitioned by a prefix of the key.  A batch
rewrites only the buckets it touches (dynamic partition overwrite); running the
same batch again gives the same table, so replays after a failure are safe.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.upsert import hash_key, upsert
from ..schema import LISTING_SCHEMA, conform
from ..session import settle


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """Current table, empty when it does not exist yet; any other failure is raised."""
    schema = StructType([*LISTING_SCHEMA, StructField("bucket", StringType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_batch(
    batch: DataFrame, path: str, *, order: str, digits: int = 2, now: dt.datetime | None = None,
) -> None:
    """Merge one batch into the table at ``path``; ``now`` is the time of the change, by default the clock's."""
    spark = batch.sparkSession
    rows = conform(batch, extra=[order] if order not in LISTING_SCHEMA.names else [])
    rows = settle(rows.withColumn("hash_id", hash_key("ingest")))
    touched = rows.select(F.substring("hash_id", 1, digits).alias("bucket")).distinct()
    # At most 16 ** digits values: literal partition filters for the scan.
    buckets = [r.bucket for r in touched.collect()]
    target = read_target(spark, path).filter(F.col("bucket").isin(*buckets)).drop("bucket")
    merged = upsert(target, rows, now=F.current_timestamp() if now is None else F.lit(now), order=order)
    # The result is fixed before its own inputs are replaced.
    merged = settle(merged.withColumn("bucket", F.substring("hash_id", 1, digits)))
    # Rebalanced by bucket: a bucket beyond the advisory partition size is split into several files.
    (merged.hint("rebalance", "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, *, order: str = "last_seen_at",
                  digits: int = 2, available_now: bool = True, now: dt.datetime | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` drains what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: upsert_batch(batch, path, order=order, digits=digits, now=now))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
