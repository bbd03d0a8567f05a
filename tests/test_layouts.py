"""Nearest rows and deep pages from stored layouts against full sorts, and how little they read."""

import random

import pytest
from pyspark.sql import functions as F

from listingflow.operators import layouts, serving


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 0.0, *[rng.gauss(28, 1.5)] * 8]), rng.choice([None, *[rng.gauss(-15.5, 2)] * 8]), f"2027-01-{1 + i % 28:02d}", rng.choice([None, float(i % 50)]))
            for i in range(2000)]
    data += [(5000 + i, rng.uniform(-89, 89), rng.choice([-179.9, 179.9, rng.uniform(-180, 180)]), None, None) for i in range(200)]
    return spark.createDataFrame(data, "id long, latitud double, longitud double, day string, precio_num double").select(
        "id", "latitud", "longitud", F.to_date("day").alias("fecha_iso"), "precio_num")


def files_of(df):
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_nearest(spark, rows, tmp_path):
    path = str(tmp_path / "zones")
    layouts.write_zones(rows, path, zone=0.5)
    for lat, lon, n in ((28.1, -15.43, 18), (28.1, -15.43, 1), (40.0, -15.0, 5), (0.0, 179.99, 3), (89.9, 10.0, 4), (28.0, -15.0, 2500)):
        want = [(r.id, r.km) for r in serving.nearest(rows, lat, lon, n).collect()]
        got = [(r.id, r.km) for r in layouts.nearest_in_zones(spark, path, lat, lon, n, zone=0.5).collect()]
        assert got == want
    every = spark.read.parquet(path)
    near = every.filter(layouts.zone_square(28.1, -15.43, 0.5, 0.5))
    assert 0 < len(files_of(near)) <= 9 < len(files_of(every))


def test_bound_of_what_lies_outside():
    rng = random.Random(2)
    from math import asin, cos, radians, sin, sqrt
    for _ in range(3000):
        lat, lon, d = rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(0.01, 80)
        a, b = rng.uniform(-90, 90), rng.uniform(-180, 180)
        off = min(abs(b - lon), 360 - abs(b - lon))
        if abs(a - lat) > d or off > d:
            h = sin(radians(a - lat) / 2) ** 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(b - lon) / 2) ** 2
            assert 2 * 6371 * asin(sqrt(min(1, h))) >= layouts.beyond(lat, d) - 1e-6


@pytest.mark.parametrize("mode", ["fecha", "fecha_desc", "precio_asc", "precio_desc"])
def test_deep_pages(spark, rows, tmp_path, mode):
    path = str(tmp_path / mode)
    layouts.write_listing_pages(rows, path, mode, parts=12)
    for number, size in ((1, 18), (60, 18), (122, 18), (123, 18), (500, 18), (3, 700), (1, 5000)):
        want = [r.id for r in serving.page(rows, number, size, mode).collect()]
        assert [r.id for r in layouts.listing_page(spark, path, number, size, mode).collect()] == want
    plan = layouts.listing_page(spark, path, 60, 18, mode)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(layouts.listing_page(spark, path, 60, 18, mode).inputFiles()) >= 1
