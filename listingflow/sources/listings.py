"""Reading listing tables, exports and small parameter tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocab as v
from ..schema import LISTING_SCHEMA


def read_listings(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Listing table with its fixed schema: no inference, pruning and pushdown by the scan.

    A date range also becomes a range of the ``month`` partition column (see
    ``sinks.write_table``), so other months are not even listed.
    """
    df = spark.read.schema(LISTING_SCHEMA).parquet(path)
    for bound, keep in ((first, lambda c, x: c >= x), (last, lambda c, x: c <= x)):
        if bound is not None:
            df = df.filter(keep(F.col("fecha_iso"), F.lit(bound)))
            if "month" in df.columns:
                df = df.filter(keep(F.col("month"), F.lit(bound.strftime("%Y-%m"))))
    return df.select(*LISTING_SCHEMA.names)


def pending(df: DataFrame, kind: str, as_of: dt.date | None = None) -> DataFrame:
    """Work queue: rows still to ``enrich``, to ``locate``, or to mark ``past``."""
    if kind == "enrich":
        return df.filter(~F.col("enriquecido"))
    if kind == "locate":
        return df.filter(F.col("latitud").isNull() | F.col("longitud").isNull())
    if kind == "past":
        return df.filter((F.col("fecha_iso") < F.lit(as_of)) & (F.col("estado") != "past"))
    raise ValueError(f"unknown work queue: {kind}")


def read_export(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """An export with its display headers renamed back; fails on a missing column."""
    df = spark.read.options(**options).format(fmt).load(path)
    missing = [name for name in v.EXPORT_COLUMNS.values() if name not in df.columns]
    if missing:
        raise ValueError(f"export lacks required columns: {missing}")
    return df.withColumnsRenamed({shown: name for name, shown in v.EXPORT_COLUMNS.items()})


def read_keywords(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Keyword table (ord, category, keyword) for ``lookups.classify_by_table``."""
    table = spark.read.options(header=True, **options).format(fmt).load(path)
    return table.select(F.col("ord").cast("int").alias("ord"), "category", "keyword")
