"""Listing queries: grid, search, facets, calendar, map, nearest.

Dates are Python dates, so every window is a literal range that reaches the
Parquet scan.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from .survivors import top_n_per_day

GRID_COLUMNS = ["id", "nombre", "imagen_url", "estilo", "fecha_iso", "hora", "precio_num", "lugar", "estado"]
WINDOW_COLUMNS = [
    "id", "nombre", "latitud", "longitud", "estilo", "fecha_iso", "hora", "lugar", "imagen_url",
    "precio_num", "descripcion", "url_venta",
]
FEED_COLUMNS = ["id", "nombre", "lugar", "fecha_iso", "hora", "descripcion", "estilo", "imagen_url"]


# ---------------------------------------------------------------- windows
def date_window(name: str, as_of: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a named window.

    ``weekend`` is the next Saturday and Sunday; on a Saturday it is the
    following week's.  An ISO day is a window of one day.
    """
    day = dt.timedelta(days=1)
    if name == "today":
        return as_of, as_of
    if name == "tomorrow":
        return as_of + day, as_of + day
    if name == "weekend":
        ahead = (5 - as_of.weekday()) % 7 or 7
        return as_of + ahead * day, as_of + (ahead + 1) * day
    if name == "month":
        return as_of, as_of.replace(day=calendar.monthrange(as_of.year, as_of.month)[1])
    if name == "all":
        return None, None
    exact = dt.date.fromisoformat(name)
    return exact, exact


def in_window(df: DataFrame, name: str, as_of: dt.date) -> DataFrame:
    first, last = date_window(name, as_of)
    day = F.col("fecha_iso")
    out = df.filter(day.isNotNull())
    if first is not None:
        out = out.filter(day >= F.lit(first))
    return out.filter(day <= F.lit(last)) if last is not None else out


def public_view(df: DataFrame) -> DataFrame:
    """What anonymous readers may see: dated rows only."""
    return df.filter(F.col("fecha_iso").isNotNull())


def archive(df: DataFrame, as_of: dt.date) -> DataFrame:
    return sort_listings(df.filter(F.col("fecha_iso") < F.lit(as_of)), "fecha_desc")


def window90(df: DataFrame, as_of: dt.date, days: int = v.WINDOW_DAYS) -> DataFrame:
    last = as_of + dt.timedelta(days=days)
    return df.filter(F.col("fecha_iso").between(F.lit(as_of), F.lit(last))).select(*WINDOW_COLUMNS)


def feed_rows(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.filter(F.col("fecha_iso") >= F.lit(as_of)).select(*FEED_COLUMNS)


# ---------------------------------------------------------------- search
def matches(needle: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    low = needle.strip().lower()
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(low)), F.lit(False))
    return out


def search_index(df: DataFrame, *, key: str, fields: dict[str, str],
                 stop_words=v.SPANISH_STOP_WORDS, weights=v.SEARCH_WEIGHTS) -> DataFrame:
    """Weighted token table (token, key, weight, n) of whole texts.

    ``fields`` maps a column to its weight class.  All tokens of a row come from
    one map task, so the partial aggregate folds them before the shuffle.
    """
    # One row per field and then one per token: both steps are compiled, a function of arrays is not.
    parts = [F.struct(F.coalesce(F.col(column), F.lit("")).alias("text"), F.lit(weights[cls]).alias("w")) for column, cls in fields.items()]
    texts = df.select(F.col(key), F.inline(F.array(*parts)))
    rows = texts.select(key, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("token"), "w")
    return (
        rows.filter((F.col("token") != "") & ~F.col("token").isin(*stop_words))
        .groupBy("token", key).agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    )


def search(index: DataFrame, query: str, *, key: str, stop_words=v.QUERY_STOP_WORDS) -> DataFrame:
    """Rows that hold every word of the query, with the sum of their weights as rank."""
    words = sorted({w for w in query.lower().split() if w not in stop_words})
    hits = index.filter(F.col("token").isin(*words)).groupBy(key).agg(
        F.sum("weight").alias("rank"), F.count("*").alias("found"))
    return hits.filter(F.col("found") == len(words)).select(key, "rank")


# ---------------------------------------------------------------- order, pages
def listing_order(mode: str) -> list[Column]:
    """Order of a listing; unknown prices come last in both directions, id breaks ties."""
    day, price = F.col("fecha_iso"), F.col("precio_num")
    return {
        "fecha": [day.asc_nulls_last()], "fecha_desc": [day.desc_nulls_last()],
        "precio_asc": [price.asc_nulls_last(), day.asc_nulls_last()],
        "precio_desc": [price.desc_nulls_last(), day.asc_nulls_last()],
    }[mode] + [F.col("id").asc()]


def sort_listings(df: DataFrame, mode: str = "fecha") -> DataFrame:
    return df.orderBy(*listing_order(mode))


def page(df: DataFrame, number: int, size: int = v.PAGE_SIZE, mode: str = "fecha") -> DataFrame:
    """Rows of one page.  For deep pages use :func:`page_after`."""
    return sort_listings(df, mode).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_day: dt.date, last_id: int, size: int = v.PAGE_SIZE) -> DataFrame:
    """Next page by key: everything behind the last row shown, in date order."""
    day = F.col("fecha_iso")
    behind = (day > F.lit(last_day)) | ((day == F.lit(last_day)) & (F.col("id") > last_id))
    return sort_listings(df.filter(behind), "fecha").limit(size)


def page_info(df: DataFrame, size: int = v.PAGE_SIZE) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(size).alias("size"), F.ceil(F.col("total") / size).cast("long").alias("pages"))


def nearest(df: DataFrame, lat: float, lon: float, n: int | None = v.PAGE_SIZE) -> DataFrame:
    """Listings by great-circle distance in km; those without coordinates come last."""
    d_lat, d_lon = F.radians(F.col("latitud") - lat), F.radians(F.col("longitud") - lon)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians("latitud")) * F.pow(F.sin(d_lon / 2), 2)
    km = v.EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    known = (F.col("latitud") != 0) & (F.col("longitud") != 0)
    out = df.withColumn("km", F.when(known, km).otherwise(F.lit(v.NO_COORDS_DISTANCE)))
    return out.orderBy("km", "id").limit(n) if n else out


@dataclass(frozen=True)
class GridQuery:
    """Filters, order and page of the listing grid."""

    window: str = "all"
    category: str | None = None
    search: str | None = None
    sort: str = "fecha"
    archive: bool = False
    number: int = 1
    size: int = v.PAGE_SIZE


def grid_rows(df: DataFrame, query: GridQuery, as_of: dt.date) -> DataFrame:
    """All rows of a grid query, before paging."""
    if query.archive:
        rows = df.filter(F.col("fecha_iso") < F.lit(as_of))
    else:
        first, last = date_window(query.window, as_of)
        rows = df.filter(F.col("fecha_iso") >= F.lit(first or as_of))
        if last is not None:
            rows = rows.filter(F.col("fecha_iso") <= F.lit(last))
    if query.search and query.search.strip():
        rows = rows.filter(matches(query.search, "nombre", "lugar"))
    if query.category:
        rows = rows.filter(F.col("estilo") == query.category)
    return rows.select(*GRID_COLUMNS)


def grid(df: DataFrame, query: GridQuery, as_of: dt.date) -> DataFrame:
    """One page of the grid; ``page_info(grid_rows(...))`` has the totals."""
    mode = "fecha_desc" if query.archive and query.sort == "fecha" else query.sort
    return page(grid_rows(df, query, as_of), query.number, query.size, mode)


def fallback_today(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Today's listings; when there are none, all upcoming ones."""
    upcoming = df.filter(F.col("fecha_iso") >= F.lit(as_of)).select(*GRID_COLUMNS)
    today = upcoming.filter(F.col("fecha_iso") == F.lit(as_of))
    some = today.limit(1).agg(F.count("*").alias("_n")).filter("_n > 0")
    return today.unionByName(upcoming.join(some, F.lit(True), "left_anti"))


# ---------------------------------------------------------------- calendar
def day_spine(spark, first: dt.date, days: int) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(first + dt.timedelta(days=days - 1)))).alias("fecha_iso"))


def calendar_spine(df: DataFrame, first: dt.date, days: int) -> DataFrame:
    """(day, total) for every day, also those without listings.

    Listings are counted per day before they meet the spine.
    """
    last = first + dt.timedelta(days=days - 1)
    counts = df.filter(F.col("fecha_iso").between(F.lit(first), F.lit(last))).groupBy("fecha_iso").agg(
        F.count("*").alias("total"))
    return day_spine(df.sparkSession, first, days).join(counts, "fecha_iso", "left").select(
        "fecha_iso", F.coalesce("total", F.lit(0)).alias("total"))


def _day_cells(df: DataFrame, first: dt.date, days: int, n: int, shown: Column) -> DataFrame:
    """Spine with total, the first ``n`` entries as text, and the number not shown."""
    last = first + dt.timedelta(days=days - 1)
    window = df.filter(F.col("fecha_iso").between(F.lit(first), F.lit(last)))
    tops = top_n_per_day(window, n).groupBy("fecha_iso").agg(
        F.first("total").alias("total"), F.first("rest").alias("rest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("s")))), lambda x: x["s"]), ", ").alias("shown"))
    return day_spine(df.sparkSession, first, days).join(tops, "fecha_iso", "left").select(
        "fecha_iso", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("shown", F.lit("")).alias("shown"))


def week(df: DataFrame, as_of: dt.date, offset: int = 0, n: int = 4) -> DataFrame:
    """Monday-based week ``offset`` weeks from now: total, first ``n`` titles, rest."""
    monday = as_of - dt.timedelta(days=as_of.weekday()) + dt.timedelta(weeks=offset)
    return _day_cells(df, monday, 7, n, F.coalesce("nombre", F.lit("")))


def month_grid(df: DataFrame, year: int, month: int, n: int = 2, dots: int = 0) -> DataFrame:
    """Full Monday-based weeks around a month; cells of other months stay empty.

    With ``dots``, also the categories of the first ``dots`` listings of each day.
    """
    first = dt.date(year, month, 1)
    last = first.replace(day=calendar.monthrange(year, month)[1])
    start = first - dt.timedelta(days=first.weekday())
    end = last + dt.timedelta(days=6 - last.weekday())
    inside = df.filter(F.col("fecha_iso").between(F.lit(first), F.lit(last)))
    cells = _day_cells(inside, start, (end - start).days + 1, n, F.coalesce("nombre", F.lit("")))
    if dots:
        marks = _day_cells(inside, start, (end - start).days + 1, dots, F.coalesce("estilo", F.lit(v.DEFAULT_CATEGORY)))
        cells = cells.join(marks.select("fecha_iso", F.col("shown").alias("dots")), "fecha_iso")
    return cells.withColumn("other_month", F.month("fecha_iso") != month)


def date_strip(df: DataFrame, as_of: dt.date, days: int = 31, n: int = 3) -> DataFrame:
    """Days ahead with weekend flag and the categories of the first listings."""
    cells = _day_cells(df, as_of, days, n, F.coalesce("estilo", F.lit(v.DEFAULT_CATEGORY)))
    return cells.withColumn("weekend", F.dayofweek("fecha_iso").isin(1, 7)).drop("rest")


def first_of_days(df: DataFrame, first: dt.date, days: int, n: int = 3) -> DataFrame:
    """Every day of a span with its total, its first ``n`` titles and the number of the others."""
    return _day_cells(df, first, days, n, F.coalesce("nombre", F.lit("")))


def day(df: DataFrame, iso: dt.date) -> DataFrame:
    return df.filter(F.col("fecha_iso") == F.lit(iso))


def detail(df: DataFrame, ident: int) -> DataFrame:
    return df.filter(F.col("id") == ident)


def map_points(df: DataFrame, hidden: list[str]) -> DataFrame:
    """Rows to draw: both coordinates, category not hidden."""
    located = (F.col("latitud") != 0) & (F.col("longitud") != 0)
    shown = ~F.coalesce(F.col("estilo").isin(*hidden), F.lit(False)) if hidden else F.lit(True)
    return df.filter(located & shown).select("id", "nombre", "estilo", "latitud", "longitud", "fecha_iso")
