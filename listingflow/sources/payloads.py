"""API payloads: JSON text in a column -> listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.flags import in_geo_scope
from ..functions.parse import extract_date, extract_hour, to_local, valid_image
from ..functions.text import blank_to_null, clean_text, name_from_slug
from ..operators.survivors import first_seen

SESSIONS = (
    "title STRING, slug STRING, url STRING, venue STRING, province STRING, city STRING, "
    "masterId STRING, imageUrl STRING, minPrice DOUBLE, "
    "sessions ARRAY<STRUCT<id: STRING, date: STRING>>"
)
SLIDER = "eventTitle STRING, eventUrl STRING, eventLocation STRING, eventDate STRING, imageUrl STRING"
DISCOVERY = (
    "id STRING, name STRING, url STRING, "
    "dates STRUCT<start: STRUCT<localDate: STRING, localTime: STRING>>, "
    "images ARRAY<STRUCT<url: STRING>>, priceRanges ARRAY<STRUCT<min: DOUBLE>>, "
    "_embedded STRUCT<venues: ARRAY<STRUCT<name: STRING>>>"
)
PAGED_ITEM = (
    "title STRING, url STRING, slug STRING, id STRING, image STRING, image_url STRING, poster STRING"
)


def _place_or(name: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(clean_text(name)), F.lit(default))


def flatten_sessions(
    payload: DataFrame, *, event_url: str, source: str, prefix: str, ord_col: str = "ord",
    json: str = "json", scope: bool = True,
) -> DataFrame:
    """One row per session of an event; an event without sessions gives one undated row."""
    item = payload.select(ord_col, F.from_json(json, SESSIONS).alias("e")).select(ord_col, "e.*")
    item = item.filter((F.col("title") != "") & (F.col("slug") != ""))
    if scope:
        item = item.filter(in_geo_scope(F.concat_ws(" ", "province", "city", "venue")))
    rows = item.select("*", F.posexplode_outer("sessions").alias("pos", "session")).withColumn(
        "at", to_local(F.col("session.date"), naive_is_utc=False)
    )
    day, hour = F.col("at.day"), F.col("at.hour")
    master = blank_to_null(F.col("masterId"))
    stamp = [F.coalesce(day.cast("string"), F.lit("None")), F.coalesce(hour, F.lit("None"))]
    key = F.when(
        master.isNotNull() & day.isNotNull(), F.concat_ws("_", master, *stamp)
    ).otherwise(F.concat_ws("_", "slug", *stamp, F.coalesce("venue", F.lit(""))))
    rows = first_seen(rows.withColumn("dedupe_key", key), ["dedupe_key"], [ord_col, "pos"])
    return rows.select(
        clean_text(F.col("title")).alias("nombre"),
        _place_or(F.col("venue"), "Gran Canaria").alias("lugar"),
        F.coalesce(blank_to_null(F.col("session.date")), F.lit("Sin fecha")).alias("fecha_raw"),
        day.alias("fecha_iso"), hour.alias("hora"), F.lit(source).alias("organiza"),
        F.coalesce(blank_to_null(F.col("url")), F.concat(F.lit(event_url), F.col("slug"))).alias("url_venta"),
        valid_image(F.col("imageUrl")).alias("imagen_url"), F.col("minPrice").alias("precio_num"),
        F.concat_ws("|", F.lit(prefix), F.coalesce(master, F.col("slug")),
                    F.coalesce("session.id", F.lit(""))).alias("source_id"),
    )


def flatten_slider(
    payload: DataFrame, *, source: str, as_of: Column, ord_col: str = "ord", json: str = "json",
    scope: bool = True,
) -> DataFrame:
    """Flat promo rows; an unreadable instant falls back to date and hour in the text."""
    item = payload.select(ord_col, F.from_json(json, SLIDER).alias("e")).select(ord_col, "e.*")
    item = item.filter((F.col("eventTitle") != "") & (F.col("eventUrl") != ""))
    item = first_seen(item, ["eventTitle", "eventLocation"], [ord_col])
    if scope:
        item = item.filter(in_geo_scope(F.col("eventLocation")))
    text = F.col("eventDate")
    rows = item.withColumn("at", to_local(text, naive_is_utc=False))
    parsed = F.col("at.day").isNotNull()
    return rows.select(
        clean_text(F.col("eventTitle")).alias("nombre"),
        _place_or(F.col("eventLocation"), "Gran Canaria").alias("lugar"),
        F.coalesce(blank_to_null(text), F.lit("Sin fecha")).alias("fecha_raw"),
        F.when(parsed, F.col("at.day")).otherwise(extract_date(text, as_of)).alias("fecha_iso"),
        F.when(parsed, F.col("at.hour")).otherwise(extract_hour(text)).alias("hora"),
        F.lit(source).alias("organiza"), F.col("eventUrl").alias("url_venta"),
        valid_image(F.col("imageUrl")).alias("imagen_url"),
    )


def flatten_discovery(payload: DataFrame, *, source: str, ord_col: str = "ord", json: str = "json") -> DataFrame:
    """Nested ticketing events, unique by id over all searches in the payload."""
    item = payload.select(ord_col, F.from_json(json, DISCOVERY).alias("e")).select(ord_col, "e.*")
    item = first_seen(item.filter(F.col("id") != ""), ["id"], [ord_col])
    day, clock = F.col("dates.start.localDate"), F.col("dates.start.localTime")
    return item.select(
        clean_text(F.coalesce("name", F.lit("Evento TM"))).alias("nombre"),
        clean_text(F.coalesce(F.get("_embedded.venues", F.lit(0))["name"], F.lit("Gran Canaria"))).alias("lugar"),
        F.trim(F.concat_ws(" ", day, clock)).alias("fecha_raw"),
        F.try_to_date(day, "yyyy-MM-dd").alias("fecha_iso"),
        F.when(F.contains(clock, F.lit(":")), F.substring(clock, 1, 5)).alias("hora"),
        F.lit(source).alias("organiza"), F.coalesce("url", F.lit("")).alias("url_venta"),
        F.get("images", F.lit(0))["url"].alias("imagen_url"),
        F.get("priceRanges", F.lit(0))["min"].alias("precio_num"), F.col("id").alias("source_id"),
    )


def flatten_paged(
    payload: DataFrame, *, base_url: str, source: str, ord_col: str = "ord", json: str = "json"
) -> DataFrame:
    """Pages that are ``{"data": [...]}`` or ``[...]``; unique by URL in page order."""
    array = f"ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in PAGED_ITEM.split(', '))}>>"
    wrapped = F.from_json(F.get_json_object(json, "$.data"), array)
    items = F.when(F.ltrim(json).startswith("["), F.from_json(json, array)).otherwise(wrapped)
    item = payload.select(ord_col, F.posexplode(items).alias("pos", "e")).select(ord_col, "pos", "e.*")
    slug, ident = blank_to_null(F.col("slug")), blank_to_null(F.col("id"))
    path = F.concat_ws("/", F.lit(base_url + "/evento"), slug, ident)
    url = F.coalesce(blank_to_null(F.col("url")), F.when(slug.isNotNull(), path))

    def absolute(c: Column) -> Column:
        return F.when(F.startswith(c, F.lit("/")), F.concat(F.lit(base_url), c)).otherwise(c)

    image = F.coalesce(*[blank_to_null(F.col(c)) for c in ("image", "image_url", "poster")])
    rows = item.withColumn("url_venta", absolute(url)).filter(F.col("url_venta").isNotNull())
    rows = first_seen(rows, ["url_venta"], [ord_col, "pos"])
    name = blank_to_null(clean_text(F.col("title")))
    return rows.select(
        F.coalesce(name, name_from_slug(F.col("url_venta"))).alias("nombre"),
        F.lit(source).alias("organiza"), "url_venta",
        valid_image(absolute(image)).alias("imagen_url"),
    )
