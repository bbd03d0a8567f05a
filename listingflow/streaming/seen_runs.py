"""Listings that a source has stopped delivering, counted in runs of the source.

A stream of (key, run) rows keeps one session per key, which reaches from its first run to ``runs``
runs after its last, in keyed state.  The run number is the event time, so the watermark is the
latest run that is complete; a run inside the session extends it, and a session whose end the
watermark has reached is a key that so many runs went by without.  All of it are Spark's own
session windows: rows and state stay in the JVM, and no key costs a call to a Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Sessions of many keys outgrow the heap, the RocksDB store does not; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def missed_runs(seen: DataFrame, runs: int) -> DataFrame:
    """(key, last_run, missed_run) for every key of the stream ``seen`` (key, run) that ``runs`` runs on end did not have.

    A key counts as gone after that and as new when it comes back.  Repeated rows count once,
    rows with a null key or run not at all.  ``runs`` is 1 or more.
    """
    use_state_store(seen.sparkSession)
    timed = seen.filter(F.col("key").isNotNull() & F.col("run").isNotNull()).select(
        F.col("key").cast("string").alias("key"), F.timestamp_seconds(F.col("run").cast("long")).alias("time")
    ).withWatermark("time", "0 seconds")
    # A run that starts where the session ends still extends it; the session is over once the watermark is there.
    sessions = timed.groupBy("key", F.session_window("time", f"{runs} seconds").alias("session")).agg(F.count(F.lit(1)).alias("n"))
    end = F.unix_seconds("session.end")
    return sessions.select("key", (end - runs).alias("last_run"), end.alias("missed_run"))
