"""Export frames and table writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.parse import coords_from_link, map_link, valid_image
from ..functions.text import null_tokens, strip, strip_ai_tags
from ..operators.upsert import hash_key, mark_past, replace_future


def export_columns(df: DataFrame) -> DataFrame:
    """Display form of refined rows: map link, defaults for missing hour, price and place."""
    place = F.when(~F.col("lugar").isin(*v.PLACE_NULL_TOKENS), F.col("lugar"))
    return df.withColumns({
        "ver_mapa": map_link(F.col("latitud"), F.col("longitud")),
        "precio_num": F.coalesce(F.col("precio_num").cast("string"), F.lit(v.PRICE_UNKNOWN)),
        "hora": F.coalesce(null_tokens(F.col("hora")), F.lit(v.HOUR_UNKNOWN)),
        "lugar": F.coalesce(place, F.lit(v.PLACE_UNKNOWN)),
        "imagen_url": valid_image(F.col("imagen_url"), ()),
    }).select(*v.EXPORT_COLUMNS)


def split_export(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed and draft rows under their display headers."""
    shown = export_columns(df)
    dated = F.col("fecha_iso").isNotNull()
    renamed = dict(v.EXPORT_COLUMNS)
    return (
        shown.filter(dated).withColumnsRenamed(renamed), shown.filter(~dated).withColumnsRenamed(renamed)
    )


def write_split(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Two outputs, confirmed ones clustered by date: range partitions keep the date
    order across files without a single sorting task."""
    confirmed, drafts = split_export(df)
    # The hash splits a day that holds a large share of the rows.
    spread = F.xxhash64(*[c for c, t in confirmed.dtypes if not t.startswith("map")])
    (confirmed.repartitionByRange("Fecha", spread).sortWithinPartitions("Fecha")
     .write.mode("overwrite").options(**options).format(fmt).save(f"{path}/confirmed"))
    drafts.write.mode("overwrite").options(**options).format(fmt).save(f"{path}/drafts")


def json_records(export: DataFrame) -> DataFrame:
    """Rows with a valid date, prices as numbers, coordinates read from the map link."""
    day = F.substring(strip(F.col("fecha_iso").cast("string")), 1, 10)
    price = F.col("precio_num").try_cast("double")
    lat, lon = coords_from_link(F.col("ver_mapa"))
    return export.withColumns({
        "fecha_iso": day, "precio_num": F.when(~F.isnan(price), price), "latitud": lat, "longitud": lon,
    }).filter(F.col("fecha_iso").rlike(v.EXPORT_DATE)).drop("ver_mapa")


def write_json_records(export: DataFrame, path: str) -> None:
    json_records(export).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sanitize_nulls(df: DataFrame) -> DataFrame:
    """NaN, infinities and empty text become null; the id is left to the store."""
    def clean(name: str, dtype: str) -> Column:
        c = F.col(name)
        if dtype in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
        return F.when(c != "", c).alias(name) if dtype == "string" else c
    return df.select(*[clean(n, t) for n, t in df.dtypes if n != "id"])


def publish_rows(export: DataFrame, as_of: Column) -> DataFrame:
    """Export rows in table form: typed, tags out, state and publish key set."""
    lat, lon = coords_from_link(F.col("ver_mapa"))
    hour = null_tokens(strip(F.col("hora")), v.PUBLISH_NULL_TOKENS)
    rows = export.withColumns({
        "fecha_iso": F.try_to_date(F.substring(F.col("fecha_iso").cast("string"), 1, 10), "yyyy-MM-dd"),
        "precio_num": F.col("precio_num").try_cast("double"), "hora": hour,
        "descripcion": strip_ai_tags(F.col("descripcion")), "latitud": lat, "longitud": lon,
        "enriquecido": F.lit(False),
    }).drop("ver_mapa")
    return mark_past(rows, as_of, recompute=True).withColumn("hash_id", hash_key("publish"))


def publish(target: DataFrame, new: DataFrame, as_of: dt.date) -> DataFrame:
    """Table after a publication: past marked, future replaced, one row per key.

    New rows of one key are equal in everything the key covers; the last by text
    wins.  The result is written in one go, so readers never see a table without
    its future.
    """
    day = F.lit(as_of)
    one = new.groupBy("hash_id").agg(F.max(F.struct(*[c for c in new.columns if c != "hash_id"])).alias("r"))
    return replace_future(mark_past(target, day), one.select("r.*", "hash_id"), day)


def write_table(df: DataFrame, path: str) -> None:
    """Listing table partitioned by month, sorted by date inside the files.

    The id is the last range column, so that a large day and the undated rows are split.
    """
    month = F.date_format("fecha_iso", "yyyy-MM")
    (df.withColumn("month", month).repartitionByRange("month", "fecha_iso", "id")
     .sortWithinPartitions("month", "fecha_iso").write.mode("overwrite").partitionBy("month").parquet(path))


def append_run_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_qa_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
