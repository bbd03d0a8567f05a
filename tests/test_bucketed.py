"""The bucketed table: equal to plain upserts, no exchange of the table, other months untouched, replays."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from listingflow.operators import upsert
from listingflow.schema import conform
from listingflow.streaming import bucketed

COLS = "id long, nombre string, lugar string, fecha_iso date, hora string, organiza string, precio_num double, last_seen_at timestamp"
NOW = dt.datetime(2027, 1, 1)


def batch(spark, ids, price, month=None):
    def day(i):
        return None if i % 10 == 9 else dt.date(2027, month or 1 + i % 4, 1 + i % 28)

    rows = [(i, f"Acto {i}", "Sala", day(i), "20:00", "CICCA", price, dt.datetime(2027, 1, 1, 0, 0, int(price))) for i in ids]
    return conform(spark.createDataFrame(rows, COLS))


@pytest.fixture
def table(spark, tmp_path):
    name = f"target_{uuid.uuid4().hex}"
    bucketed.create_table(spark, name, str(tmp_path / "table"), buckets=4)
    yield name, str(tmp_path / "table")
    spark.sql(f"DROP TABLE {name}")


def content(df):
    return sorted((r.hash_id, r.precio_num) for r in df.select("hash_id", "precio_num").collect())


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}


def test_batches_and_replay(spark, table):
    name, path = table
    first, second = batch(spark, range(200), 5.0), batch(spark, range(150, 300), 7.0)
    for b in (first, second):
        bucketed.upsert_months(b, name, order="last_seen_at", buckets=4, now=NOW)
    plain = None
    for b in (first, second):
        keyed = b.withColumn("hash_id", upsert.hash_key("ingest"))
        plain = upsert.upsert(keyed.limit(0) if plain is None else plain, keyed, now=F.lit(NOW), order="last_seen_at")
    want = content(plain)
    assert content(spark.table(name)) == want and len(want) == 300
    bucketed.upsert_months(second, name, order="last_seen_at", buckets=4, now=NOW)
    assert content(spark.table(name)) == want
    bucketed.upsert_months(second.limit(0), name, order="last_seen_at", buckets=4, now=NOW)
    # Another session finds the months that are there.
    again = f"{name}_again"
    bucketed.create_table(spark, again, path, buckets=4)
    assert content(spark.table(again)) == want
    spark.sql(f"DROP TABLE {again}")


def test_only_months_of_the_batch_are_rewritten(spark, table):
    name, path = table
    bucketed.upsert_months(batch(spark, range(200), 5.0), name, order="last_seen_at", buckets=4, now=NOW)
    before = stamps(path)
    ids = [i for i in range(200) if i % 4 == 1 and i % 10 != 9][:30]
    bucketed.upsert_months(batch(spark, ids, 9.0), name, order="last_seen_at", buckets=4, now=NOW)
    after = stamps(path)
    changed = {os.path.basename(os.path.dirname(f)) for f in {*before, *after} if before.get(f) != after.get(f)}
    assert changed == {"month=2027-02"}
    assert all(len(glob.glob(f"{path}/month={m}/*.parquet")) <= 4 for m in ("2027-01", "2027-02", "none"))
    assert spark.table(name).filter("precio_num = 9").count() == len(ids)


def test_the_table_is_not_exchanged(spark, table):
    name, _ = table
    bucketed.upsert_months(batch(spark, range(200), 5.0), name, order="last_seen_at", buckets=4, now=NOW)
    rows = batch(spark, range(5), 6.0).withColumn("hash_id", upsert.hash_key("ingest")).withColumn("month", bucketed.month_of(F.col("fecha_iso")))
    plan = bucketed.merged_months(spark, name, rows, order="last_seen_at", now=F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    # Over the scan of the table there is a sort at most, on its way into the join.
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line and name in line)
    above = []
    for line in reversed(plan.splitlines()[:scan]):
        above.append(line)
        if "SortMergeJoin" in line:
            break
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    assert not any("Exchange" in line for line in above), plan
