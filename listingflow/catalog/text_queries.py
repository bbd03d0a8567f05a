"""Text, flag and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags, text, vocab as v
from . import sqltext as s
from .registry import on_listing, query
from .tables import table


@query("clean_text", f"""
SELECT doc_id, length({s.clean('text')}) AS size, md5({s.clean('text')}) AS digest FROM documents""")
def _(spark, sf):
    clean = text.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).cast("long").alias("size"), F.md5(clean).alias("digest"))


@query("fold_text", f"SELECT doc_id, md5({s.fold('text')}) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("digest"))


on_listing("strip_place_suffix", f"SELECT id, {s.strip_place_suffix('nombre')} AS nombre FROM listing")(
    lambda df: df.select("id", text.strip_place_suffix(F.col("nombre")).alias("nombre")))

_SUFFIX_SQL = s.strip("nombre || CASE WHEN id % 2 = 0 THEN ' en Canarias en Vivo' WHEN id % 3 = 0 THEN ' - Concierto en Las Palmas' ELSE ' –' END")
_STEPS = ["t0 AS (SELECT id, " + _SUFFIX_SQL + " AS t FROM listing)"] + [
    f"t{i + 1} AS (SELECT id, CASE WHEN ends_with(lower(t), {s.q(x)}) THEN {s.strip(f'left(t, length(t) - {len(x)})')} ELSE t END AS t FROM t{i})"
    for i, x in enumerate(v.TITLE_SUFFIXES)
]


@on_listing("strip_suffixes", f"SELECT id, regexp_replace(t, '[ \\-–—]+$', '') AS nombre FROM t{len(v.TITLE_SUFFIXES)}", ", ".join(_STEPS))
def _(df):
    k = F.col("id")
    tail = F.when(k % 2 == 0, " en Canarias en Vivo").when(k % 3 == 0, " - Concierto en Las Palmas").otherwise(" –")
    return df.select("id", text.strip_suffixes(F.concat("nombre", tail)).alias("nombre"))


on_listing("canonical_venue", f"SELECT id, {s.canonical_venue('lugar')} AS lugar FROM listing")(
    lambda df: df.select("id", text.canonical_venue(F.col("lugar")).alias("lugar")))
on_listing("canonical_title", f"SELECT id, {s.canonical_title('nombre')} AS canon FROM listing")(
    lambda df: df.select("id", text.canonical_title(F.col("nombre")).alias("canon")))
on_listing("occurrence_key", f"SELECT id, {s.occurrence_key('nombre', 'fecha_iso', 'lugar')} AS key FROM listing")(
    lambda df: df.select("id", text.occurrence_key(F.col("nombre"), F.col("fecha_iso"), F.col("lugar")).alias("key")))


_PARTS = r"""
parts AS (SELECT id, list_filter(string_split(regexp_replace(url_venta, '/\d+(\?.*)?$', ''), '/'),
  lambda p: length(p) > 2 AND NOT regexp_matches(p, '^\d+$')) AS p FROM listing)"""


@on_listing("name_from_slug", r"""
SELECT id, array_to_string(list_transform(
  string_split(replace(replace(regexp_replace(p[-1], '^\d+-', ''), '-', ' '), '_', ' '), ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS nombre FROM parts""", _PARTS)
def _(df):
    url = F.regexp_replace("url_venta", r"/\d+(\?.*)?$", "")
    return df.select("id", text.name_from_slug(url).alias("nombre"))


on_listing("null_tokens", """
SELECT id, CASE WHEN hora IN ('', 'nan', 'None', '<NA>', 'NaN') THEN NULL ELSE hora END AS hora,
  coalesce(CASE WHEN hora NOT IN ('', 'nan', 'None', '<NA>', 'NaN') THEN hora END, 'Hora por confirmar') AS hora_vista,
  coalesce(CAST(precio_num AS VARCHAR), 'Consultar') AS precio_vista FROM listing""")(
    lambda df: df.select("id", text.null_tokens(F.col("hora")).alias("hora"),
                         F.coalesce(text.null_tokens(F.col("hora")), F.lit(v.HOUR_UNKNOWN)).alias("hora_vista"),
                         F.coalesce(F.col("precio_num").cast("string"), F.lit(v.PRICE_UNKNOWN)).alias("precio_vista")))

on_listing("strip_ai_tags", f"SELECT id, {s.strip('descripcion')} AS descripcion FROM listing")(
    lambda df: df.select("id", text.strip_ai_tags(F.concat(F.lit("[Generado por IA] "), "descripcion")).alias("descripcion")))


@query("preview", r"""
SELECT page_id, CASE WHEN coalesce(html, '') <> '' THEN left(regexp_replace(html, '<[^>]+>', '', 'g'), 200) || '...' ELSE '' END AS preview FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.preview(F.col("html")).alias("preview"))


on_listing("price_label", """
SELECT id, CASE WHEN precio_num IS NULL THEN 'Consultar' WHEN precio_num = 0 THEN 'Gratis'
  ELSE replace(printf('%.2f', precio_num), '.', ',') || ' €' END AS precio FROM listing""")(
    lambda df: df.select("id", text.price_label(F.col("precio_num")).alias("precio")))

on_listing("urgency", """
SELECT id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' WHEN d BETWEEN 2 AND 3 THEN 'days_' || d
  WHEN d BETWEEN 4 AND 7 AND dayofweek(fecha_iso) IN (0, 6) THEN 'weekend' END AS urgency
FROM (SELECT *, date_diff('day', DATE '2027-01-01', fecha_iso) AS d FROM listing)""")(
    lambda df: df.select("id", text.urgency(F.col("fecha_iso"), F.lit("2027-01-01").cast("date")).alias("urgency")))

# ------------------------------------------------------------ flags, filters
on_listing("generic_title", f"SELECT id, {s.generic_title('nombre')} AS generic FROM listing")(
    lambda df: df.select("id", flags.is_generic_title(F.col("nombre")).alias("generic")))


_PHRASES = ", ".join(s.q(p) for p in v.BOILERPLATE_PHRASES)


@query("boilerplate", f"""
SELECT doc_id, len(list_filter([{_PHRASES}], lambda p: contains(lower(text || CASE WHEN lang = 'es' THEN ' Aviso legal. COOKIES' ELSE '' END), p))) >= 2 AS boilerplate FROM documents""")
def _(spark, sf):
    body = F.concat("text", F.when(F.col("lang") == "es", " Aviso legal. COOKIES").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", flags.is_boilerplate(body).alias("boilerplate"))


on_listing("junk_title", f"SELECT id, {s.junk_title('nombre')} AS junk, CASE WHEN NOT {s.junk_title('nombre')} THEN fecha_iso END AS fecha_iso FROM listing")(
    lambda df: df.select("id", flags.is_junk_title(F.col("nombre")).alias("junk"),
                         F.when(~flags.is_junk_title(F.col("nombre")), F.col("fecha_iso")).alias("fecha_iso")))
on_listing("drop_garbage", f"SELECT id, nombre, lugar FROM listing WHERE NOT {s.garbage_row('nombre', 'lugar')}")(
    lambda df: df.filter(~flags.is_garbage_row(F.col("nombre"), F.col("lugar"))).select("id", "nombre", "lugar"))
on_listing("generic_place", f"SELECT id, {s.generic_place('lugar')} AS generic FROM listing")(
    lambda df: df.select("id", flags.is_generic_place(F.col("lugar")).alias("generic")))
on_listing("drop_social", f"SELECT id, nombre FROM listing WHERE NOT {s.social('nombre', 'url_venta')}")(
    lambda df: df.filter(~flags.is_social(F.col("nombre"), F.col("url_venta"))).select("id", "nombre"))
on_listing("future_or_draft", "SELECT id, fecha_iso FROM listing WHERE fecha_iso IS NULL OR fecha_iso >= DATE '2027-01-01'")(
    lambda df: df.filter(flags.future_or_draft(F.col("fecha_iso"), F.lit("2027-01-01").cast("date"))).select("id", "fecha_iso"))


def _scope(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return f"({s.any_of(low, v.ISLAND_WORDS)} AND NOT {s.any_of(low, v.OTHER_PLACES)})"


on_listing("geo_scope", f"""
SELECT id, {_scope('lugar')} AS in_place, {_scope('lugar')} OR {_scope('nombre')} OR {_scope('descripcion')} AS in_any,
  {s.any_of("lower(coalesce(lugar, ''))", v.ISLAND_WORDS)} AS included FROM listing""")(
    lambda df: df.select(
        "id", flags.in_geo_scope(F.col("lugar")).alias("in_place"),
        flags.in_geo_scope(F.col("lugar"), F.col("nombre"), F.col("descripcion")).alias("in_any"),
        flags.in_geo_scope(F.col("lugar"), exclude=None).alias("included")))

_SLUG = f"replace({s.fold('lugar')}, ' ', '-')"
on_listing("slug_verdict", f"""
SELECT id, CASE WHEN {s.any_of(_SLUG, v.SLUG_REJECT)} THEN false WHEN {s.any_of(_SLUG, v.SLUG_ACCEPT)} THEN true END AS verdict,
  NOT {s.any_of("lower(coalesce(lugar, ''))", v.VENUE_REJECT)} AS allowed FROM listing""")(
    lambda df: df.select(
        "id", flags.slug_verdict(F.replace(text.fold(F.col("lugar")), F.lit(" "), F.lit("-"))).alias("verdict"),
        flags.venue_allowed(F.col("lugar")).alias("allowed")))


@query("link_noise", r"""
WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS name FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (WHERE contains(href, '/category/') OR contains(href, '/tag/')
  OR contains(href, '/author/') OR contains(href, '/page/') OR contains(lower(name), 'leer') OR regexp_matches(name, '^\d[\d\s]+$')) AS noise
FROM links GROUP BY page_id""")
def _(spark, sf):
    anchor = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    links = table(spark, sf, "pages").select("page_id", F.inline(F.arrays_zip(
        F.regexp_extract_all("html", F.lit(anchor), 1), F.regexp_extract_all("html", F.lit(anchor), 2))).alias("href", "name"))
    return links.groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_if(flags.is_link_noise(F.col("href"), F.col("name"))).alias("noise"))
