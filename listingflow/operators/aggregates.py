"""Counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.flags import is_blank_hour


def facet_counts(df: DataFrame, as_of: Column, column: str = "estilo") -> DataFrame:
    """Upcoming listings per value, largest first; a missing value counts as the default."""
    return (
        df.filter(F.col("fecha_iso") >= as_of)
        .groupBy(F.coalesce(column, F.lit(v.DEFAULT_CATEGORY)).alias("nombre"))
        .agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "nombre")
    )


def source_counts(*frames: DataFrame, source: str = "organiza") -> DataFrame:
    """Rows per source over all given frames."""
    out = frames[0].select(source)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(source))
    return out.groupBy(source).agg(F.count("*").alias("total"))


def completeness(df: DataFrame, by: str = "organiza") -> DataFrame:
    """How many rows of a source have each field."""
    return df.groupBy(by).agg(
        F.count("*").alias("total"), F.count("precio_num").alias("con_precio"),
        F.count("fecha_iso").alias("con_fecha"), F.count(F.when(F.col("hora") != "", 1)).alias("con_hora"),
        F.count("imagen_url").alias("con_imagen"), F.count("descripcion").alias("con_descripcion"),
    )


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; null counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def null_ratio(df: DataFrame, by: str | None = None) -> DataFrame:
    """Share of rows with blank hour and blank price."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count("*").alias("total"), share(is_blank_hour(F.col("hora"))).alias("hora_vacia"),
        share(F.col("precio_num").isNull()).alias("precio_vacio"),
    )


def top_repeat(df: DataFrame, column: str = "nombre") -> DataFrame:
    """Most frequent value and its count."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("total"))
        .orderBy(F.col("total").desc(), column).limit(1)
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys are equal."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def bbox(df: DataFrame) -> DataFrame:
    """Bounds of the rows that have both coordinates."""
    both = df.filter((F.col("latitud") != 0) & (F.col("longitud") != 0))
    return both.agg(
        F.min("latitud").alias("south"), F.max("latitud").alias("north"),
        F.min("longitud").alias("west"), F.max("longitud").alias("east"), F.count("*").alias("points"),
    )


def geo_counters(located: DataFrame) -> DataFrame:
    """Rows and distinct places per way of locating them."""
    return (
        located.filter(F.col("geo_method").isNotNull())
        .groupBy("geo_method", F.coalesce("lugar", F.lit("")).alias("lugar")).agg(F.count("*").alias("n"))
        .groupBy("geo_method").agg(F.sum("n").alias("filas"), F.count("*").alias("lugares"))
    )


def clean_counters(masters: DataFrame) -> DataFrame:
    """Clean-up of a table: clusters with copies, rows dropped, masters whose text or image a copy filled.

    ``masters`` are the fused rows of ``resolve.table_masters``, one per cluster.
    """
    other_text = ~F.col("text_id").eqNullSafe(F.col("id"))
    other_image = ~F.col("imagen_url").eqNullSafe(F.col("own_image"))
    return masters.agg(
        F.count_if(F.col("copies") > 1).alias("grupos_con_copias"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicados_eliminados"),
        F.count_if(other_text | other_image).alias("maestros_enriquecidos"))


def classify_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Listings classified, and those whose category changed."""
    both = before.select("id", F.col("estilo").alias("_old")).join(after.select("id", "estilo"), "id")
    return both.agg(
        F.count("*").alias("procesados"),
        F.count_if(~F.col("estilo").eqNullSafe(F.col("_old"))).alias("reclasificados"))


def events_per_day(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("fecha_iso").isNotNull()).groupBy("fecha_iso")
        .agg(F.count("*").alias("total"), F.min("hora").alias("first_hour"))
    )
