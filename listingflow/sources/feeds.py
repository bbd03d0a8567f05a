"""Feeds: sitemap, RSS, ICS and schema.org JSON as text rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.text import ics_escape, xml_escape
from ..operators.resolve import number_rows
from ..operators.serving import feed_rows

# Static pages of the site map and their priority.
STATIC_PAGES = [("/", "1.0"), ("/mapa", "0.8"), ("/calendario", "0.8"), ("/semana", "0.8")]
RFC822 = "EEE, dd MMM yyyy HH:mm:ss"


def _url_entry(loc: Column, freq: str, priority: Column) -> Column:
    return F.concat(
        F.lit("<url><loc>"), loc, F.lit(f"</loc><changefreq>{freq}</changefreq><priority>"), priority,
        F.lit("</priority></url>"))


def sitemap_rows(df: DataFrame, site: str, as_of: dt.date) -> DataFrame:
    """One line per page: the static ones and every upcoming listing."""
    spark = df.sparkSession
    static = spark.createDataFrame(STATIC_PAGES, "path string, priority string").select(
        F.concat(F.lit(site), "path").alias("loc"),
        _url_entry(F.concat(F.lit(site), "path"), "daily", F.col("priority")).alias("line"))
    loc = F.concat(F.lit(site + "/evento/"), F.col("id").cast("string"))
    events = feed_rows(df, as_of).select(
        loc.alias("loc"), _url_entry(loc, "weekly", F.lit("0.6")).alias("line"))
    return static.unionByName(events)


def sitemap_shards(rows: DataFrame, size: int = v.SITEMAP_SHARD) -> DataFrame:
    """Site map lines with the number of the file they go to, at most ``size`` per file."""
    numbered = number_rows(rows, ["loc"], "n")
    return numbered.withColumn("shard", F.floor((F.col("n") - 1) / size).cast("int")).drop("n")


def rss_rows(df: DataFrame, site: str, as_of: dt.date, n: int = v.RSS_ITEMS) -> DataFrame:
    """Items of the first ``n`` upcoming listings by date."""
    top = feed_rows(df, as_of).orderBy("fecha_iso", "id").limit(n)
    hour = F.coalesce(F.when(F.col("hora") != "", F.col("hora")), F.lit("00:00"))
    stamp = F.concat(F.col("fecha_iso").cast("string"), F.lit(" "), hour, F.lit(":00")).try_cast("timestamp_ntz")
    published = F.concat(F.date_format(stamp, RFC822), F.lit(" GMT"))
    run_date = dt.datetime.combine(as_of, dt.time())
    fallback = run_date.strftime("%a, %d %b %Y %H:%M:%S GMT")
    image = F.when(F.col("imagen_url").isNotNull(), F.concat(
        F.lit('<img src="'), "imagen_url", F.lit('" alt="Imagen del evento" />'))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("<p><strong>Fecha:</strong> "), xml_escape(F.col("fecha_iso").cast("string")), F.lit(" "),
        xml_escape(F.col("hora")), F.lit("</p><p><strong>Lugar:</strong> "), xml_escape(F.col("lugar")),
        F.lit("</p><p>"), xml_escape(F.coalesce("descripcion", F.lit("Evento cultural"))), F.lit("</p>"), image)
    link = F.concat(F.lit(site + "/evento/"), F.col("id").cast("string"))
    return top.select(
        "id", xml_escape(F.col("nombre")).alias("title"), link.alias("link"), text.alias("description"),
        F.coalesce(published, F.lit(fallback)).alias("pub_date"))


def ics_rows(df: DataFrame, stamp: str, uid_host: str = "listingflow", description_size: int | None = None) -> DataFrame:
    """One calendar document per dated listing; two hours long, or all day without an hour.

    ``description_size`` cuts the escaped description; the default writes all of it.
    """
    description = ics_escape(F.col("descripcion"))
    if description_size:
        description = F.substring(description, 1, description_size)
    timed = F.coalesce(F.col("hora").rlike(r"^\d{1,2}:\d{2}$"), F.lit(False))
    parts = F.split("hora", ":")
    h, m = F.when(timed, parts[0].cast("int")), F.when(timed, parts[1].cast("int"))
    compact = F.date_format("fecha_iso", "yyyyMMdd")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    end_h = F.least(h + 2, F.lit(23))
    end_m = F.when(h + 2 <= 23, m).otherwise(F.lit(59))
    start = F.when(timed, F.concat(F.lit("DTSTART:"), compact, F.lit("T"), two(h), two(m), F.lit("00"))).otherwise(
        F.concat(F.lit("DTSTART;VALUE=DATE:"), compact))
    end = F.when(timed, F.concat(F.lit("DTEND:"), compact, F.lit("T"), two(end_h), two(end_m), F.lit("00"))).otherwise(
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add("fecha_iso", 1), "yyyyMMdd")))
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//listingflow//ES"),
        F.lit("CALSCALE:GREGORIAN"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit(f"@{uid_host}")), F.lit(f"DTSTAMP:{stamp}"),
        start, end, F.concat(F.lit("SUMMARY:"), ics_escape(F.col("nombre"))),
        F.concat(F.lit("LOCATION:"), ics_escape(F.col("lugar"))),
        F.when(F.col("descripcion") != "", F.concat(
            F.lit("DESCRIPTION:"), description)),
        F.when(F.col("url_venta") != "", F.concat(F.lit("URL:"), F.col("url_venta"))),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ]
    return df.filter(F.col("fecha_iso").isNotNull()).select("id", F.concat_ws("\r\n", *lines).alias("ics"))


def jsonld_rows(df: DataFrame, locality: str = "Las Palmas de Gran Canaria", region: str = "Canarias",
                country: str = "ES", area: str = "Gran Canaria") -> DataFrame:
    """schema.org event of every dated listing as JSON; missing parts are left out."""
    hour = F.when(F.col("hora") != "", F.concat(F.lit("T"), "hora", F.lit(":00"))).otherwise(F.lit(""))
    about = F.concat(F.lit("Evento de "), F.coalesce("estilo", F.lit(v.DEFAULT_CATEGORY)), F.lit(" en "),
                     F.coalesce("lugar", F.lit("")), F.lit(f", {area}"))
    located = (F.col("latitud") != 0) & (F.col("longitud") != 0)
    t = lambda s: F.lit(s).alias("@type")
    geo = F.when(located, F.struct(t("GeoCoordinates"), F.col("latitud").alias("latitude"), F.col("longitud").alias("longitude")))
    address = F.struct(t("PostalAddress"), F.lit(locality).alias("addressLocality"),
                       F.lit(region).alias("addressRegion"), F.lit(country).alias("addressCountry"))
    offers = F.when(F.col("precio_num").isNotNull(), F.struct(
        t("Offer"), F.col("precio_num").alias("price"), F.lit("EUR").alias("priceCurrency"),
        F.col("url_venta").alias("url"), F.lit("https://schema.org/InStock").alias("availability")))
    event = F.struct(
        F.lit("https://schema.org").alias("@context"), t("Event"), F.col("nombre").alias("name"),
        F.concat(F.col("fecha_iso").cast("string"), hour).alias("startDate"),
        F.coalesce(F.when(F.col("descripcion") != "", F.col("descripcion")), about).alias("description"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
        F.lit("https://schema.org/EventScheduled").alias("eventStatus"), F.col("url_venta").alias("url"),
        F.struct(t("Place"), F.col("lugar").alias("name"), address.alias("address"), geo.alias("geo")).alias("location"),
        F.struct(t("Organization"), F.col("organiza").alias("name")).alias("organizer"),
        F.col("imagen_url").alias("image"), offers.alias("offers"))
    return df.filter(F.col("fecha_iso").isNotNull()).select("id", F.to_json(event).alias("jsonld"))
