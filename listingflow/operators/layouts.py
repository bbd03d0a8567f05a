"""Table layouts that a point query or a deep page reads a small part of.

``write_zones`` puts rows into folders by geographic zone; the nearest rows come from a growing
square of zones, with a bound on the distance of all that lies outside.  ``write_order`` writes
rows in range partitions of a sort order with the size of each, so that page n is found by
adding up sizes and reads the one or two partitions it lies in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab as v
from ..session import settle
from .serving import listing_order, nearest

ZONE, NOWHERE = 0.25, 1 << 20


# ------------------------------------------------------------------ nearest
def write_zones(df: DataFrame, path: str, zone: float = ZONE) -> None:
    """Rows by zones of ``zone`` degrees; rows without coordinates have a zone of their own."""
    known = F.coalesce((F.col("latitud") != 0) & (F.col("longitud") != 0), F.lit(False))

    def number(c: str) -> Column:
        return F.when(known, F.floor(F.col(c) / zone).cast("int")).otherwise(F.lit(NOWHERE))

    placed = df.withColumns({"zone_lat": number("latitud"), "zone_lon": number("longitud")})
    placed.hint("rebalance", "zone_lat", "zone_lon").write.partitionBy("zone_lat", "zone_lon").parquet(path)


def beyond(lat: float, degrees: float) -> float:
    """Least distance in km of all points that differ by more than ``degrees`` in latitude or in longitude."""
    side = math.asin(max(0.0, math.cos(math.radians(lat)) * math.sin(math.radians(min(degrees, 90.0)))))
    return v.EARTH_RADIUS_KM * min(math.radians(degrees), side)


def zone_square(lat: float, lon: float, degrees: float, zone: float) -> Column:
    """Zones that hold all points within ``degrees`` of a point in both coordinates, over the date line too."""
    def between(name: str, low: float, high: float) -> Column:
        return F.col(name).between(math.floor(low / zone), math.floor(high / zone))

    inside = between("zone_lon", lon - degrees, lon + degrees)
    for turn in (-360, 360):
        inside = inside | between("zone_lon", lon - degrees + turn, lon + degrees + turn)
    return between("zone_lat", lat - degrees, lat + degrees) & inside


def nearest_in_zones(spark: SparkSession, path: str, lat: float, lon: float, n: int = v.PAGE_SIZE, zone: float = ZONE) -> DataFrame:
    """The ``n`` nearest rows, as :func:`nearest` gives them; a few zones are read where they are enough.

    The square grows to twice its side until the n-th row is nearer than anything outside can
    be; where that never happens all rows are compared.
    """
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("zone_lat", "zone_lon")]
    degrees = zone
    while degrees < 90:
        square = rows.filter(zone_square(lat, lon, degrees, zone)).select(*columns)
        found = nearest(square, lat, lon, n).agg(F.count("*").alias("n"), F.max("km").alias("km")).first()
        if found["n"] == n and found["km"] < beyond(lat, degrees):
            return nearest(square, lat, lon, n)
        degrees *= 2
    return nearest(rows.select(*columns), lat, lon, n)


# ------------------------------------------------------------------ pages
def write_order(df: DataFrame, path: str, order: Sequence[Column], parts: int | None = None) -> None:
    """Rows in range partitions of a total order, and how many each of them has."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = settle(ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    placed.repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
    placed.groupBy("part").count().coalesce(1).write.parquet(f"{path}/sizes")


def stored_page(spark: SparkSession, path: str, number: int, size: int = v.PAGE_SIZE, *, order: Sequence[Column]) -> DataFrame:
    """Page ``number`` of the stored order: only the partitions it lies in are read and sorted."""
    sizes = sorted((r["part"], r["count"]) for r in spark.read.parquet(f"{path}/sizes").collect())  # one row per partition
    first, before, wanted, skip = (number - 1) * size, 0, [], 0
    for part, count in sizes:
        if before < first + size and before + count > first:
            if not wanted:
                skip = first - before
            wanted.append(part)
        before += count
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(*wanted)).drop("part")
    return rows.orderBy(*order).offset(max(skip, 0)).limit(size)


def write_listing_pages(df: DataFrame, path: str, mode: str = "fecha", parts: int | None = None) -> None:
    write_order(df, path, listing_order(mode), parts)


def listing_page(spark: SparkSession, path: str, number: int, size: int = v.PAGE_SIZE, mode: str = "fecha") -> DataFrame:
    return stored_page(spark, path, number, size, order=listing_order(mode))
