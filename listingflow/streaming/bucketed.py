"""Upserts into a table partitioned by month, bucketed and sorted by key.

The key of a listing contains its date, so all rows of a key lie in one month: a batch opens the
months it has rows of and no others.  Inside a month rows are bucketed by the key, so the merge
shuffles the batch alone; the table is read in its own buckets and written in them again.

The merged months are written aside first, with the same buckets, and then take the place of the
old ones by dynamic partition overwrite.  The same batch again gives the same table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import hash_key, upsert
from ..schema import LISTING_SCHEMA, conform
from ..session import checkpoint_dir, settle

BUCKETS, NO_DATE = 16, "none"


def month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_DATE))


def create_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Register the table at ``path``, which may hold months already; known tables stay as they are."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LISTING_SCHEMA)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({columns}, month STRING) USING parquet PARTITIONED BY (month)
        CLUSTERED BY (hash_id) SORTED BY (hash_id) INTO {buckets} BUCKETS LOCATION '{path}'""")
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"MSCK REPAIR TABLE {name}")


@contextmanager
def dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Inserts replace the partitions they have rows of, inside this block."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def touched_months(rows: DataFrame) -> list[str]:
    """The months of a batch; a batch has few."""
    return sorted(r["month"] for r in rows.select("month").distinct().collect())


def merged_months(spark: SparkSession, name: str, rows: DataFrame, *, order: str, now: Column) -> DataFrame:
    """The touched months of the table with the batch ``rows`` (with ``month``) merged; only the batch is shuffled."""
    target = spark.table(name).filter(F.col("month").isin(*touched_months(rows))).drop("month")
    return upsert(target, rows.drop("month"), now=now, order=order).withColumn("month", month_of(F.col("fecha_iso")))


def upsert_months(
    batch: DataFrame, name: str, *, order: str, buckets: int = BUCKETS, now: dt.datetime | None = None,
) -> None:
    """Merge one batch into the table; ``now`` is the time of the change, by default the clock's."""
    spark = batch.sparkSession
    rows = conform(batch, extra=[order] if order not in LISTING_SCHEMA.names else [])
    rows = settle(rows.withColumn("hash_id", hash_key("ingest")).withColumn("month", month_of(F.col("fecha_iso"))))
    if rows.isEmpty():
        return
    merged = merged_months(spark, name, rows, order=order, now=F.current_timestamp() if now is None else F.lit(now))
    # Aside, in the same buckets: the months are complete before the old ones go, and need no exchange again.
    aside = f"merged_{uuid.uuid4().hex}"
    columns = spark.table(name).columns
    try:
        (merged.select(*columns).write.bucketBy(buckets, "hash_id").sortBy("hash_id")
         .option("path", f"{checkpoint_dir(spark)}/{aside}").saveAsTable(aside))
        with dynamic_overwrite(spark):
            spark.table(aside).select(*columns).write.insertInto(name, overwrite=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {aside}")


def upsert_stream(stream: DataFrame, name: str, checkpoint: str, *, order: str = "last_seen_at", buckets: int = BUCKETS,
                  available_now: bool = True, now: dt.datetime | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` drains what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: upsert_months(batch, name, order=order, buckets=buckets, now=now))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
