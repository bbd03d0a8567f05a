"""Listing queries as the front end asks them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import layouts, serving as sv
from ..operators.aggregates import facet_counts
from ..session import checkpoint_dir
from . import sqltext as s
from .registry import on_listing, query
from .tables import AS_OF, AS_OF_SQL, table

GRID = ", ".join(sv.GRID_COLUMNS)
WINDOW = ", ".join(sv.WINDOW_COLUMNS)
FROM = f"FROM listing WHERE fecha_iso >= {AS_OF_SQL}"

on_listing("public_view", "SELECT id, fecha_iso FROM listing WHERE fecha_iso IS NOT NULL")(lambda df: sv.public_view(df).select("id", "fecha_iso"))
for _name, _test in {
    "today": f"fecha_iso = {AS_OF_SQL}", "tomorrow": "fecha_iso = DATE '2027-01-02'",
    "weekend": "fecha_iso BETWEEN DATE '2027-01-02' AND DATE '2027-01-03'",
    "month": "fecha_iso BETWEEN DATE '2027-01-01' AND DATE '2027-01-31'",
    "2027-02-01": "fecha_iso = DATE '2027-02-01'", "all": "fecha_iso IS NOT NULL",
}.items():
    on_listing(f"date_window_{_name.replace('-', '_')}", f"SELECT id, fecha_iso FROM listing WHERE {_test}")(
        lambda df, n=_name: sv.in_window(df, n, AS_OF).select("id", "fecha_iso"))

on_listing("archive", f"SELECT id, fecha_iso FROM listing WHERE fecha_iso < {AS_OF_SQL}")(lambda df: sv.archive(df, AS_OF).select("id", "fecha_iso"))
on_listing("window90", f"SELECT {WINDOW} FROM listing WHERE fecha_iso BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + 90")(lambda df: sv.window90(df, AS_OF))
on_listing("feed_rows", f"SELECT {', '.join(sv.FEED_COLUMNS)} {FROM}")(lambda df: sv.feed_rows(df, AS_OF))
on_listing("search_ilike", "SELECT id, nombre, lugar FROM listing WHERE nombre ILIKE '%concierto%' OR lugar ILIKE '%teatro%' OR estilo ILIKE '%teatro%'")(
    lambda df: df.filter(sv.matches("CONCIERTO ", "nombre") | sv.matches("Teatro", "lugar", "estilo")).select("id", "nombre", "lugar"))

_ORDERS = {"fecha": "fecha_iso ASC NULLS LAST", "fecha_desc": "fecha_iso DESC NULLS LAST",
           "precio_asc": "precio_num ASC NULLS LAST, fecha_iso ASC NULLS LAST", "precio_desc": "precio_num DESC NULLS LAST, fecha_iso ASC NULLS LAST"}
for _mode, _order in _ORDERS.items():
    on_listing(f"sort_page_{_mode}", f"SELECT id, fecha_iso, precio_num FROM listing ORDER BY {_order}, id LIMIT 18 OFFSET 36")(
        lambda df, m=_mode: sv.page(df.select("id", "fecha_iso", "precio_num"), 3, mode=m))
on_listing("page_after", f"SELECT id, fecha_iso {FROM} AND (fecha_iso, id) > (DATE '2027-03-01', 600) ORDER BY fecha_iso, id LIMIT 18")(
    lambda df: sv.page_after(df.select("id", "fecha_iso"), dt.date(2027, 3, 1), 600))
on_listing("page_info", f"SELECT count(*) AS total, 18 AS size, CAST(ceil(count(*) / 18.0) AS BIGINT) AS pages {FROM}")(
    lambda df: sv.page_info(df.filter(F.col("fecha_iso") >= F.lit(AS_OF))))
_KM = """CASE WHEN latitud IS NULL OR longitud IS NULL THEN 9999.0::DOUBLE ELSE 6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) END"""
on_listing("nearest", f"""SELECT id, round({_KM}, 6) AS km FROM (SELECT *, pow(sin(radians(latitud - 28.1::DOUBLE) / 2), 2)
  + cos(radians(28.1::DOUBLE)) * cos(radians(latitud)) * pow(sin(radians(longitud + 15.43::DOUBLE) / 2), 2) AS a FROM listing)""")(
    lambda df: sv.nearest(df, 28.1, -15.43, None).select("id", F.round("km", 6).alias("km")))
_NEAREST = f"""SELECT id FROM (SELECT *, pow(sin(radians(latitud - 28.1::DOUBLE) / 2), 2)
  + cos(radians(28.1::DOUBLE)) * cos(radians(latitud)) * pow(sin(radians(longitud + 15.43::DOUBLE) / 2), 2) AS a FROM listing) ORDER BY round({_KM}, 6), id LIMIT 18"""
on_listing("nearest_page", _NEAREST)(
    lambda df: sv.nearest(df, 28.1, -15.43, 18).select("id"))


def _stored(df, name):
    return f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _in_zones(df):
    folder = _stored(df, "zones")
    layouts.write_zones(df.select("id", "latitud", "longitud"), folder, zone=0.1)
    return layouts.nearest_in_zones(df.sparkSession, folder, 28.1, -15.43, 18, zone=0.1).select("id")


def _deep_page(df, mode):
    folder = _stored(df, "pages")
    layouts.write_listing_pages(df.select("id", "fecha_iso", "precio_num"), folder, mode)
    return layouts.listing_page(df.sparkSession, folder, 500, mode=mode)


on_listing("nearest_in_zones", _NEAREST)(_in_zones)
for _mode in ("fecha", "precio_desc"):
    on_listing(f"deep_page_{_mode}", f"SELECT id, fecha_iso, precio_num FROM listing ORDER BY {_ORDERS[_mode]}, id LIMIT 18 OFFSET {499 * 18}")(
        lambda df, m=_mode: _deep_page(df, m))

on_listing("top_n", f"SELECT id, nombre {FROM} ORDER BY fecha_iso, id LIMIT 50")(
    lambda df: sv.feed_rows(df, AS_OF).orderBy("fecha_iso", "id").limit(50).select("id", "nombre"))

on_listing("grid", f"SELECT {GRID} FROM listing WHERE fecha_iso BETWEEN {AS_OF_SQL} AND DATE '2027-01-31' AND (nombre ILIKE '%gear%' OR lugar ILIKE '%gear%') ORDER BY precio_num DESC NULLS LAST, fecha_iso, id LIMIT 18")(
    lambda df: sv.grid(df, sv.GridQuery(window="month", search="Gear", sort="precio_desc"), AS_OF))
on_listing("grid_category", f"SELECT {GRID} {FROM} AND estilo = 'Cine' ORDER BY fecha_iso, id LIMIT 18 OFFSET 18")(
    lambda df: sv.grid(df, sv.GridQuery(category="Cine", number=2), AS_OF))
on_listing("grid_archive", f"SELECT {GRID} FROM listing WHERE fecha_iso < {AS_OF_SQL} ORDER BY fecha_iso DESC, id LIMIT 18")(
    lambda df: sv.grid(df, sv.GridQuery(archive=True), AS_OF))
on_listing("grid_all_rows", f"SELECT {GRID} {FROM} AND (nombre ILIKE '%ring%' OR lugar ILIKE '%ring%')")(
    lambda df: sv.grid_rows(df, sv.GridQuery(search=" ring"), AS_OF))
on_listing("fallback_today", f"SELECT {GRID} FROM listing WHERE fecha_iso = {AS_OF_SQL}")(lambda df: sv.fallback_today(df, AS_OF))
on_listing("fallback_all", f"SELECT {GRID} FROM listing WHERE fecha_iso >= DATE '2040-01-01' OR (fecha_iso >= DATE '2030-07-20' AND NOT EXISTS (SELECT 1 FROM listing WHERE fecha_iso = DATE '2030-07-20' AND lugar = 'Nadie'))")(
    lambda df: _late(df))


def _late(df):
    """No listing at all on the chosen day, so the fallback shows everything after it."""
    day = dt.date(2030, 7, 20)
    return sv.fallback_today(df.filter((F.col("fecha_iso") != F.lit(day)) | (F.col("lugar") == "Nadie")), day).unionByName(
        df.filter(F.col("fecha_iso") == F.lit(day)).select(*sv.GRID_COLUMNS))


on_listing("calendar_spine", f"SELECT d AS fecha_iso, count(id) AS total FROM (SELECT CAST(unnest(generate_series({AS_OF_SQL}, {AS_OF_SQL} + 59, INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN listing ON fecha_iso = d GROUP BY d")(
    lambda df: sv.calendar_spine(df, AS_OF, 60))


def _cells(first: str, days: int, n: int, shown: str, where: str = "true") -> str:
    return f"""cells AS (SELECT d AS fecha_iso, count(id) AS total, greatest(count(id) - {n}, 0) AS rest,
  coalesce(string_agg({shown}, ', ' ORDER BY place) FILTER (WHERE place <= {n} AND id IS NOT NULL), '') AS shown
FROM (SELECT CAST(unnest(generate_series({first}, {first} + {days - 1}, INTERVAL 1 DAY)) AS DATE) AS d)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY fecha_iso ORDER BY coalesce(hora, ''), id) AS place FROM listing WHERE {where}) ON fecha_iso = d GROUP BY d)"""


on_listing("week", "SELECT * FROM cells", _cells("DATE '2027-01-04'", 7, 4, "nombre"))(lambda df: sv.week(df, AS_OF, 1))
on_listing("month_grid", "SELECT *, month(fecha_iso) <> 3 AS other_month FROM cells", _cells("DATE '2027-03-01'", 35, 2, "nombre", "month(fecha_iso) = 3"))(
    lambda df: sv.month_grid(df, 2027, 3))
on_listing("month_dots", "SELECT cells.*, month(cells.fecha_iso) <> 3 AS other_month, d.shown AS dots FROM cells JOIN dots d USING (fecha_iso)",
    _cells("DATE '2027-03-01'", 35, 2, "nombre", "month(fecha_iso) = 3") + ", "
    + _cells("DATE '2027-03-01'", 35, 3, "coalesce(estilo, 'Otros')", "month(fecha_iso) = 3").replace("cells AS", "dots AS", 1))(
    lambda df: sv.month_grid(df, 2027, 3, dots=3))
on_listing("first_of_days", "SELECT * FROM cells", _cells(AS_OF_SQL, 120, 5, "nombre"))(lambda df: sv.first_of_days(df, AS_OF, 120, 5))
on_listing("date_strip", "SELECT fecha_iso, total, shown, dayofweek(fecha_iso) IN (0, 6) AS weekend FROM cells", _cells(AS_OF_SQL, 31, 3, "coalesce(estilo, 'Otros')"))(
    lambda df: sv.date_strip(df, AS_OF))
on_listing("day", "SELECT id, nombre FROM listing WHERE fecha_iso = DATE '2027-02-01'")(lambda df: sv.day(df, dt.date(2027, 2, 1)).select("id", "nombre"))
on_listing("detail", "SELECT * FROM listing WHERE id = 424")(lambda df: sv.detail(df, 424))
on_listing("map_points", "SELECT id, nombre, estilo, latitud, longitud, fecha_iso FROM listing WHERE latitud IS NOT NULL AND coalesce(estilo, '-') NOT IN ('Cine', 'Humor')")(
    lambda df: sv.map_points(df, ["Cine", "Humor"]))
on_listing("facets_all", f"SELECT coalesce(lugar, 'Otros') AS nombre, count(*) AS total {FROM} GROUP BY 1")(
    lambda df: facet_counts(df, F.lit(AS_OF), "lugar"))

_STOP = "(" + ", ".join(s.q(w) for w in sv.v.QUERY_STOP_WORDS) + ")"
_INDEX_STOP = "(" + ", ".join(s.q(w) for w in sv.v.SPANISH_STOP_WORDS) + ")"


def _tokens(table_name: str, key: str, fields: dict) -> str:
    return " UNION ALL ".join(
        rf"SELECT {key}, unnest(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+')) AS token, {sv.v.SEARCH_WEIGHTS[w]}::DOUBLE AS w FROM {table_name}"
        for c, w in fields.items())


_DOC = {"source": "A", "lang": "B", "text": "C"}
_LIST = {"nombre": "A", "lugar": "B", "estilo": "B", "descripcion": "C"}


@query("search_index", f"""SELECT doc_id, token, count(*) AS n, round(sum(w), 6) AS weight FROM ({_tokens('documents', 'doc_id', _DOC)})
WHERE token <> '' AND token NOT IN {_INDEX_STOP} GROUP BY doc_id, token""")
def _(spark, sf):
    index = sv.search_index(table(spark, sf, "documents"), key="doc_id", fields=_DOC)
    return index.select("doc_id", "token", "n", F.round("weight", 6).alias("weight"))


on_listing("search", f"""SELECT id, round(sum(w), 6) AS rank FROM ({_tokens('listing', 'id', _LIST)}) WHERE token IN ('concierto', 'gear') GROUP BY id HAVING count(DISTINCT token) = 2""")(
    lambda df: sv.search(sv.search_index(df, key="id", fields=_LIST), "Concierto de gear", key="id").select("id", F.round("rank", 6).alias("rank")))
