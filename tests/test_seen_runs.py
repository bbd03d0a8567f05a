"""Keys missed by runs: one stream over several batches against a plain pass."""

from pyspark.sql import functions as F

from listingflow.streaming.seen_runs import missed_runs

RUNS = {1: "abcd", 2: "abd", 3: "ad", 4: "ab", 5: "a", 6: "ac", 7: "ae", 8: "a"}


def brute(n, upto):
    out, last = set(), {}
    for run in range(1, upto + 1):
        for key in RUNS[run]:
            if key in last and run - last[key] > n:
                out.add((key, last[key], last[key] + n))
            last[key] = run
    return out | {(k, r, r + n) for k, r in last.items() if r + n <= upto}


def test_batches(spark, tmp_path):
    source, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for upto in (2, 3, 6, 8):
        done = {2: 0, 3: 2, 6: 3, 8: 6}[upto]
        rows = [(k, r) for r in range(done + 1, upto + 1) for k in RUNS[r]] + [(None, 1), ("a", None), ("a", done + 1)]
        spark.createDataFrame(rows, "key string, run long").coalesce(1).write.mode("append").parquet(source)
        stream = missed_runs(spark.readStream.schema("key string, run long").parquet(source), 2)
        stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").option("path", sink).start().awaitTermination()
        got = [(r.key, r.last_run, r.missed_run) for r in spark.read.parquet(sink).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(2, upto)


def test_no_python_in_the_plan(spark, tmp_path):
    """Rows and keyed state stay in the JVM: a worker call for each key and timer took most of the time."""
    source, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = [(k, r) for k in ("a", "b") for r in (1, 2, 3)] + [("a", 5), ("a", 8), ("c", 8)]
    spark.createDataFrame(rows, "key string, run long").write.parquet(source)
    stream = missed_runs(spark.readStream.schema("key string, run long").parquet(source), 2).writeStream.format("parquet")
    query = stream.option("checkpointLocation", progress).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
    assert "Python" not in query._jsq.explainInternal(False)
    # Exactly two runs on keep a key; three lose it; the last run that counts as missed is the latest one.
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [("a", 5, 7), ("b", 3, 5)]
