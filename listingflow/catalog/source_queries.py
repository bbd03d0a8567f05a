"""Queries over payloads, captured pages, exports and feeds."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators.facts import layered_facts
from ..schema import conform
from ..session import checkpoint_dir
from ..sources import feeds, listings, pages, payloads, sinks
from . import sqltext as s
from .registry import on_listing, query
from .tables import AS_OF, AS_OF_SQL, LISTING_SQL, PLACES, PLACES_SQL, dealt, listing, table

LIT, TXT = F.lit, F.concat


def _s(c):
    return c.cast("string")


def _places():
    return F.array(*[LIT(x) for x in PLACES])


def _folder(df, name):
    return f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _export_and_back(df):
    """Both outputs written, the confirmed one read under its own headers again."""
    folder = _folder(df, "export")
    sinks.write_split(_refined(df), folder)
    back = listings.read_export(df.sparkSession, f"{folder}/confirmed")
    return back.select(*[F.col(c).cast("string") for c in v.EXPORT_COLUMNS])


def _table_and_back(df):
    """The whole table written by month, a range of dates read from it."""
    folder = _folder(df, "table")
    sinks.write_table(conform(df), folder)
    back = listings.read_listings(df.sparkSession, folder, dt.date(2026, 11, 1), dt.date(2027, 3, 15))
    return back.select("id", "nombre", "fecha_iso", "hora", "precio_num", "enriquecido")


# ------------------------------------------------------------ payloads
@query("flatten_sessions", f"""
WITH sess AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey AS sid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
    (CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 30 MINUTE) AS utc FROM lineitem),
item AS (SELECT o_orderkey AS ord, p_name AS title, replace(p_name, ' ', '-') AS slug, ({PLACES_SQL})[n_nationkey + 1] AS venue,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'M' || o_orderkey END AS master, o_totalprice AS price,
    CASE WHEN o_orderkey % 3 = 0 THEN 'https://tienda.example/' || o_orderkey END AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Las Palmas' ELSE 'Otra' END AS province
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = o_custkey
  WHERE o_orderkey % 50 <> 49),
rows AS (SELECT item.*, sid, pos, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS raw, (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Atlantic/Canary' AS loc
  FROM item LEFT JOIN sess ON l_orderkey = ord
  WHERE {s.any_of("lower(province || ' ' || venue)", v.ISLAND_WORDS)} AND NOT {s.any_of("lower(province || ' ' || venue)", v.OTHER_PLACES)}),
keyed AS (SELECT *, CASE WHEN master IS NOT NULL AND loc IS NOT NULL THEN master || '_' || strftime(loc, '%Y-%m-%d_%H:%M')
  ELSE slug || '_' || coalesce(strftime(loc, '%Y-%m-%d_%H:%M'), 'None_None') || '_' || venue END AS k FROM rows)
SELECT title AS nombre, venue AS lugar, coalesce(raw, 'Sin fecha') AS fecha_raw, CAST(loc AS DATE) AS fecha_iso,
  strftime(loc, '%H:%M') AS hora, 'EntradasCanarias' AS organiza, coalesce(url, 'https://ventas.example/' || slug) AS url_venta,
  price AS precio_num, 'EC|' || coalesce(master, slug) || '|' || coalesce(sid, '') AS source_id
FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord, pos) = 1""")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, p = table(spark, sf, "nation"), table(spark, sf, "part")
    stamp = TXT(F.date_format("l_shipdate", "yyyy-MM-dd"), LIT("T23:30:00Z"))
    sessions = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", stamp.alias("at")))),
        lambda x: F.struct(TXT(_s(x["l_linenumber"]), LIT("-"), _s(x["l_partkey"])).alias("id"), x["at"].alias("date"))).alias("sessions"))
    k = F.col("o_orderkey")
    rows = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(p, F.col("p_partkey") == F.col("o_custkey")).join(sessions, F.col("l_orderkey") == k, "left"))
    payload = rows.select(k.alias("ord"), F.to_json(F.struct(
        F.when(k % 50 != 49, F.col("p_name")).otherwise("").alias("title"), F.replace("p_name", LIT(" "), LIT("-")).alias("slug"),
        F.element_at(_places(), F.col("n_nationkey") + 1).alias("venue"),
        F.when(k % 4 != 0, TXT(LIT("M"), _s(k))).otherwise("").alias("masterId"),
        F.when(k % 3 == 0, TXT(LIT("https://tienda.example/"), _s(k))).alias("url"),
        F.when(k % 2 == 0, "Las Palmas").otherwise("Otra").alias("province"),
        F.col("o_totalprice").alias("minPrice"), "sessions")).alias("json"))
    return payloads.flatten_sessions(
        payload, event_url="https://ventas.example/", source="EntradasCanarias", prefix="EC").drop("imagen_url")


@query("flatten_slider", f"""
WITH item AS (SELECT event_id AS ord, event_type || ' ' || user_id AS title, ({PLACES_SQL})[user_id % 25 + 1] AS place,
    'https://e.example/' || event_id AS url, event_id % 2 = 0 AS iso, ts FROM events),
one AS ({s.first_row('item', 'title, place', 'ord')}), loc AS (SELECT *, (date_trunc('minute', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Atlantic/Canary' AS l FROM one
  WHERE {s.any_of("lower(place)", v.ISLAND_WORDS)} AND NOT {s.any_of("lower(place)", v.OTHER_PLACES)})
SELECT title AS nombre, place AS lugar, CASE WHEN iso THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') ELSE strftime(ts, '%d/%m/%Y a las 20:30') END AS fecha_raw,
  CASE WHEN iso THEN CAST(l AS DATE) ELSE CAST(ts AS DATE) END AS fecha_iso, CASE WHEN iso THEN strftime(l, '%H:%M') ELSE '20:30' END AS hora,
  'Slider' AS organiza, url AS url_venta FROM loc""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'Z'")
    free = TXT(F.date_format("ts", "dd/MM/yyyy"), LIT(" a las 20:30"))
    payload = table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.to_json(F.struct(
        TXT("event_type", LIT(" "), _s(F.col("user_id"))).alias("eventTitle"),
        TXT(LIT("https://e.example/"), _s(F.col("event_id"))).alias("eventUrl"),
        F.element_at(_places(), (F.col("user_id") % 25 + 1).cast("int")).alias("eventLocation"),
        F.when(F.col("event_id") % 2 == 0, iso).otherwise(free).alias("eventDate"))).alias("json"))
    return payloads.flatten_slider(payload, source="Slider", as_of=LIT(AS_OF)).drop("imagen_url")


@query("flatten_discovery", f"""
WITH one AS ({s.first_row('orders', 'o_custkey', 'o_orderkey')})
SELECT 'Acto ' || o_custkey AS nombre, CASE WHEN o_custkey % 3 = 0 THEN 'Gran Canaria' ELSE 'Sala ' || o_custkey END AS lugar,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_custkey % 2 = 0 THEN ' 20:30:00' ELSE '' END AS fecha_raw, CAST(o_orderdate AS DATE) AS fecha_iso,
  CASE WHEN o_custkey % 2 = 0 THEN '20:30' END AS hora, 'Ticketmaster' AS organiza, 'https://t.example/' || o_custkey AS url_venta,
  CASE WHEN o_custkey % 5 <> 0 THEN 'https://i.example/' || o_custkey || '-1.jpg' END AS imagen_url,
  CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS precio_num, CAST(o_custkey AS VARCHAR) AS source_id FROM one""")
def _(spark, sf):
    c = F.col("o_custkey")
    venue = F.when(c % 3 != 0, F.array(F.struct(TXT(LIT("Sala "), _s(c)).alias("name")), F.struct(LIT("Otra").alias("name"))))
    images = F.when(c % 5 != 0, F.array(*[F.struct(TXT(LIT("https://i.example/"), _s(c), LIT(f"-{i}.jpg")).alias("url")) for i in (1, 2)]))
    payload = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.to_json(F.struct(
        _s(c).alias("id"), TXT(LIT(" Acto  "), _s(c)).alias("name"), TXT(LIT("https://t.example/"), _s(c)).alias("url"),
        F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("localDate"),
                          F.when(c % 2 == 0, "20:30:00").alias("localTime")).alias("start")).alias("dates"),
        images.alias("images"),
        F.when(c % 7 != 0, F.array(F.struct(F.col("o_totalprice").alias("min")))).alias("priceRanges"),
        F.struct(venue.alias("venues")).alias("_embedded"))).alias("json"))
    return payloads.flatten_discovery(payload, source="Ticketmaster")


@query("flatten_paged", """
SELECT CASE WHEN c_custkey % 6 = 0 THEN 'Customer#' || c_custkey ELSE trim(c_name) END AS nombre, 'Auditorio' AS organiza,
  CASE c_custkey % 3 WHEN 0 THEN 'https://aud.example/evento/customer#' || c_custkey || '/' || c_custkey
    WHEN 1 THEN 'https://aud.example/x/' || c_custkey ELSE 'https://aud.example/evento/customer#' || c_custkey END AS url_venta,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://aud.example/img/' || c_custkey || '.jpg' END AS imagen_url FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    slug = TXT(LIT("customer#"), _s(k))
    item = F.struct(
        F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("title"),
        F.when(k % 3 == 1, TXT(LIT("/x/"), _s(k))).alias("url"), F.when(k % 3 != 1, slug).alias("slug"),
        F.when(k % 3 == 0, _s(k)).alias("id"), F.when(k % 2 == 0, TXT(LIT("/img/"), _s(k), LIT(".jpg"))).alias("poster"))
    page = F.floor(k / 20)
    packed = table(spark, sf, "customer").groupBy(page.alias("ord")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("i")))), lambda x: x["i"]).alias("data"))
    payload = packed.select("ord", F.when(F.col("ord") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data"))).alias("json"))
    return payloads.flatten_paged(payload, base_url="https://aud.example", source="Auditorio")


# ------------------------------------------------------------ captured pages
def tag_text(x: str) -> str:
    out = rf"regexp_replace({x}, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&euro;", "€"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{ch}')"
    return s.clean(out)


_ANCHOR = r"""(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>"""


@query("extract_cards", rf"""
WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, regexp_extract_all(html, '{_ANCHOR}') AS cards FROM pages),
b AS (SELECT page_id, site, unnest(cards) AS card, unnest(range(len(cards))) AS pos FROM a),
c AS (SELECT *, regexp_extract(card, '(?is)href="([^"]*)"', 1) AS href FROM b),
d AS (SELECT *, regexp_extract(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN site || href
  ELSE site || '/' || href END, '^[^?]*') AS url, {tag_text('card')} AS text FROM c WHERE href <> '')
SELECT page_id, pos, text AS title, url, text FROM d QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""")
def _(spark, sf):
    cards = pages.extract_cards(table(spark, sf, "pages"), "generico")
    return cards.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url", "text")


@query("extract_heading", rf"""
SELECT page_id, CASE WHEN length(h) > 5 AND NOT {s.generic_title('h')} THEN h END AS nombre_deep FROM (
SELECT page_id, {tag_text(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")} AS h FROM pages)""")
def _(spark, sf):
    return pages.extract_heading(table(spark, sf, "pages"))


_BOIL = "[" + ", ".join(s.q(p) for p in v.BOILERPLATE_PHRASES) + "]"


def _boiler(x: str) -> str:
    return f"len(list_filter({_BOIL}, lambda k: contains(lower({x}), k))) >= 2"


def _paragraphs(x: str, size: int) -> str:
    parts = rf"regexp_split_to_array({x}, '(?is)<(?:p|li)\b[^>]*>')[2:]"
    texts = rf"list_transform({parts}, lambda t: {tag_text('''regexp_extract(t, '(?is)^(.*?)(?:</(?:p|li|article|ul|div)>|$)', 1)''')})"
    return f"array_to_string(list_filter({texts}, lambda t: length(t) > {size} AND NOT {_boiler('t')}), chr(10))"


# The containers as (tag, attribute part), in order of preference.
_CONTAINERS = [
    ("div", 'itemprop="description"'), ("div", 'class="description"'), ("[a-z]+", "event-description"), ("[a-z]+", "entry-content"),
    ("article", ""), ("[a-z]+", "detail-text"), ("[a-z]+", "info-event"), ("[a-z]+", "content-detail"),
    ("[a-z]+", "field-body"), ("[a-z]+", 'class="texto"'), ("[a-z]+", 'class="cuerpo"'),
]
_ARMS = [rf"""nullif(regexp_extract(body, '(?is)<{t}\b[^>]*{m}[^>]*>(.*?)</(?:{t})>', 1), '')""" for t, m in _CONTAINERS]
_FOUND = ", ".join(f"{_paragraphs(f'coalesce({a}, {chr(39)}{chr(39)})', 5)} AS f{i}" for i, a in enumerate(_ARMS))
_PICK = " ".join(f"WHEN length(f{i}) > 30 AND NOT {_boiler(f'f{i}')} THEN f{i}" for i in range(len(_ARMS)))


@query("extract_paragraphs", rf"""
WITH b AS (SELECT page_id, url, regexp_replace(html, '(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>', ' ', 'g') AS body FROM pages),
f AS (SELECT page_id, url, {_paragraphs('body', 20)} AS loose, {_FOUND} FROM b)
SELECT page_id, url, CASE {_PICK} ELSE nullif(loose, '') END AS descripcion FROM f""")
def _(spark, sf):
    return pages.extract_paragraphs(table(spark, sf, "pages"))


def event_pages(spark, sf):
    """One page of mark-up per listing: JSON-LD, microdata, sections, times, images."""
    df = dealt(listing(spark, sf))
    k, hour = F.col("id"), F.when(F.col("hora") != "", F.col("hora"))
    name = F.replace("nombre", LIT("|"), LIT("-"))
    start = TXT(_s(F.col("fecha_iso")), F.coalesce(TXT(LIT("T"), hour, LIT(":00")), LIT("")))
    place = F.coalesce("lugar", LIT("X"))
    located = F.when(k % 3 == 0, TXT(LIT('{"name":"'), place, LIT('"}'))).when(
        k % 3 == 1, TXT(LIT('[{"name":"'), place, LIT('"}]'))).otherwise(TXT(LIT('"'), place, LIT('"')))
    price = _s(F.col("precio_num"))
    offers = F.when(k % 2 == 0, TXT(LIT('[{"price":"'), price, LIT('","url":"'), F.col("url_venta"), LIT('"}]'))).otherwise(
        TXT(LIT('{"lowPrice":'), price, LIT("}")))
    ld = TXT(LIT('{"@type":"'), F.when(k % 4 == 3, "Article").otherwise("MusicEvent"), LIT('","name":"'), name, LIT('"'),
             F.coalesce(TXT(LIT(',"startDate":"'), start, LIT('","datePublished":"'), start, LIT('"')), LIT("")),
             LIT(',"location":'), located, F.coalesce(TXT(LIT(',"offers":'), offers), LIT("")), LIT("}"))
    script = TXT(LIT('<script type="application/ld+json">{bad</script><script type="application/ld+json">'),
                 F.when(k % 5 == 0, TXT(LIT("["), LIT('{"@type":"WebSite"},'), ld, LIT("]"))).otherwise(ld), LIT("</script>"))
    image = F.coalesce("imagen_url", LIT("/nada.png"))
    micro = TXT(LIT('<article itemtype="https://schema.org/Event"><h5 class="card-title"><span>'), name, LIT("</span></h5>"),
                F.coalesce(TXT(LIT('<meta itemprop="startDate" content="'), start, LIT('"/>')), LIT("")),
                LIT('<div style="background-image: url('), LIT("'"), image, LIT("'"), LIT(')"></div><span class="badge">'),
                F.coalesce("estilo", LIT(" ")), LIT('</span><div class="text-truncate">'), place, LIT("</div></article>"))
    section = TXT(LIT("<h3>1. "), name, LIT("</h3><ul><li>📍 : "), place, LIT("</li><li>🗓 "), F.col("fecha_raw"), LIT("</li><li>⏰ "),
                  F.coalesce(hour, LIT("por confirmar")), LIT('</li><li>Entrada gratis</li></ul><a href="'), F.col("url_venta"),
                  LIT('">Comprar</a><h3>Conclusión final</h3><p>Fin</p>'))
    html = TXT(LIT("<html><head>"), F.when(k % 2 == 0, TXT(LIT('<meta property="og:image" content="'), image, LIT('"/>'))).otherwise(""),
               script, LIT("</head><body>"), micro, section,
               F.coalesce(TXT(LIT('<time datetime="'), _s(F.col("fecha_iso")), LIT('">x</time>')), LIT("")),
               LIT('<img class="site-logo" src="https://img.example.com/logo.png" width="900"/><img src="'), image,
               LIT('" width="640"/></body></html>'))
    return df.select(k.alias("page_id"), F.col("url_venta").alias("url"), html.alias("html"))


_HOUR = "CASE WHEN hora NOT IN ('', '05:00', '06:00', '07:00') THEN hora END"
_GOOD_IMAGE = s.valid_image("imagen_url")


@query("extract_jsonld", f"""
WITH {LISTING_SQL} SELECT id AS page_id, replace(nombre, '|', '-') AS name, fecha_iso AS day,
  CASE WHEN fecha_iso IS NOT NULL THEN {_HOUR} END AS hour, precio_num AS price, CASE WHEN lugar IS NOT NULL THEN lugar END AS venue,
  CASE WHEN id % 2 = 0 AND precio_num IS NOT NULL THEN url_venta END AS offer_url FROM listing WHERE id % 4 <> 3""")
def _(spark, sf):
    return pages.extract_jsonld(event_pages(spark, sf), LIT(AS_OF)).select("page_id", "name", "day", "hour", "price", "venue", "offer_url")


@query("extract_article_date", f"""
WITH {LISTING_SQL} SELECT id AS page_id, fecha_iso AS day, {_HOUR} AS hour FROM listing WHERE id % 4 = 3 AND fecha_iso IS NOT NULL""")
def _(spark, sf):
    return pages.extract_article_date(event_pages(spark, sf), LIT(AS_OF)).select("page_id", "day", "hour")


@query("extract_microdata", f"""
WITH {LISTING_SQL} SELECT id AS page_id, replace(nombre, '|', '-') AS title,
  CAST(fecha_iso AS VARCHAR) || coalesce('T' || nullif(hora, '') || ':00', '') AS start, coalesce(lugar, 'X') AS place,
  coalesce(imagen_url, '/nada.png') AS image, coalesce(estilo, '') AS tags FROM listing""")
def _(spark, sf):
    rows = pages.extract_microdata(event_pages(spark, sf))
    return rows.select("page_id", "title", "start", "place", "image", F.array_join("tags", ",").alias("tags"))


@query("segment_sections", f"""
WITH {LISTING_SQL} SELECT id AS page_id, replace(nombre, '|', '-') AS title, coalesce(lugar, 'X') AS place,
  CAST(strptime(fecha_raw, '%d/%m/%Y') AS DATE) AS day, {_HOUR} AS hour, CAST(0 AS DOUBLE) AS price,
  url_venta AS link FROM listing""")
def _(spark, sf):
    return pages.segment_sections(event_pages(spark, sf), LIT(AS_OF)).select(
        "page_id", "title", "place", "day", "hour", "price", "link")


@query("extract_image", f"""
WITH {LISTING_SQL} SELECT id AS page_id, {_GOOD_IMAGE} AS imagen_url FROM listing WHERE {_GOOD_IMAGE} IS NOT NULL""")
def _(spark, sf):
    return pages.extract_image(event_pages(spark, sf))


@query("page_facts", f"""
WITH {LISTING_SQL} SELECT id AS page_id, coalesce(CASE WHEN id % 4 <> 3 THEN CAST(precio_num AS VARCHAR) END, '0.0') AS precio_num,
  CAST(coalesce(fecha_iso, CAST(strptime(fecha_raw, '%d/%m/%Y') AS DATE)) AS VARCHAR) AS fecha_iso,
  {_HOUR} AS hora, CASE WHEN id % 4 <> 3 THEN lugar END AS lugar FROM listing""")
def _(spark, sf):
    return layered_facts(pages.first_facts(event_pages(spark, sf), LIT(AS_OF)))


# ------------------------------------------------------------ table scans, sinks
on_listing("pending_enrich", "SELECT id FROM listing WHERE NOT enriquecido")(
    lambda df: listings.pending(df, "enrich").select("id"))
on_listing("pending_locate", "SELECT id, lugar FROM listing WHERE latitud IS NULL OR longitud IS NULL")(
    lambda df: listings.pending(df, "locate").select("id", "lugar"))
on_listing("pending_past", f"SELECT id, fecha_iso FROM listing WHERE fecha_iso < {AS_OF_SQL} AND estado <> 'past'")(
    lambda df: listings.pending(df, "past", AS_OF).select("id", "fecha_iso"))

_EXPORT = f"""export AS (SELECT id, nombre, CASE WHEN lugar IS NULL OR lugar IN ('Sin especificar', '', 'nan', 'NaN') THEN 'Recinto por confirmar' ELSE lugar END AS lugar,
  fecha_iso, coalesce(CASE WHEN hora NOT IN ('', 'nan', 'None', '<NA>', 'NaN') THEN hora END, 'Hora por confirmar') AS hora,
  coalesce(CAST(precio_num AS VARCHAR), 'Consultar') AS precio_num, estilo, organiza, url_venta, {s.valid_image('imagen_url', None)} AS imagen_url,
  descripcion, CASE WHEN latitud > 27 AND latitud < 30 THEN 'https://www.google.com/maps?q=' || latitud || ',' || longitud ELSE '' END AS ver_mapa,
  organiza AS merged_from_sources FROM listing)"""


def _refined(df):
    return df.withColumn("merged_from_sources", F.col("organiza"))


on_listing("export_confirmed", "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in v.EXPORT_COLUMNS.items()) + " FROM export WHERE fecha_iso IS NOT NULL", _EXPORT)(
    lambda df: sinks.split_export(_refined(df))[0])
on_listing("read_export", "SELECT " + ", ".join(f"CAST({a} AS VARCHAR) AS {a}" for a in v.EXPORT_COLUMNS) + " FROM export WHERE fecha_iso IS NOT NULL", _EXPORT)(
    lambda df: _export_and_back(df))
on_listing("read_listings", """SELECT id, nombre, fecha_iso, hora, precio_num, enriquecido FROM listing
WHERE fecha_iso BETWEEN DATE '2026-11-01' AND DATE '2027-03-15'""")(lambda df: _table_and_back(df))
on_listing("export_drafts", "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in v.EXPORT_COLUMNS.items()) + " FROM export WHERE fecha_iso IS NULL", _EXPORT)(
    lambda df: sinks.split_export(_refined(df))[1])
on_listing("json_records", r"""
SELECT nombre, CAST(fecha_iso AS VARCHAR) AS fecha_iso, TRY_CAST(precio_num AS DOUBLE) AS precio_num, hora, lugar,
  TRY_CAST(nullif(regexp_extract(ver_mapa, 'q=([-\d.]+),([-\d.]+)', 1), '') AS DOUBLE) AS latitud,
  TRY_CAST(nullif(regexp_extract(ver_mapa, 'q=([-\d.]+),([-\d.]+)', 2), '') AS DOUBLE) AS longitud FROM export WHERE fecha_iso IS NOT NULL""", _EXPORT)(
    lambda df: sinks.json_records(sinks.export_columns(_refined(df))).select("nombre", "fecha_iso", "precio_num", "hora", "lugar", "latitud", "longitud"))
on_listing("sanitize_nulls", """
SELECT nombre, nullif(hora, '') AS hora, nullif(imagen_url, '') AS imagen_url, CASE WHEN precio_num > 400 THEN NULL ELSE precio_num END AS precio_num FROM listing""")(
    lambda df: sinks.sanitize_nulls(df.select("id", "nombre", "hora", "imagen_url", F.when(
        F.col("precio_num") > 400, F.lit(float("nan"))).otherwise(F.col("precio_num")).alias("precio_num"))))

_PUBLISH_HASH = "sha256(organiza || '|' || url_venta || '|' || coalesce(CAST(fecha_iso AS VARCHAR), 'None') || '|' || hora)"
on_listing("publish_rows", f"""
SELECT nombre, fecha_iso, TRY_CAST(precio_num AS DOUBLE) AS precio_num, hora, {s.strip('descripcion')} AS descripcion,
  CASE WHEN fecha_iso >= {AS_OF_SQL} THEN 'upcoming' ELSE 'past' END AS estado, {_PUBLISH_HASH} AS hash_id FROM export""", _EXPORT)(
    lambda df: sinks.publish_rows(sinks.export_columns(_refined(df)), LIT(AS_OF)).select(
        "nombre", "fecha_iso", "precio_num", "hora", "descripcion", "estado", "hash_id"))
on_listing("publish_table", f"""
SELECT estado, count(*) AS filas, count(fecha_iso) AS fechadas, sum(CASE WHEN fecha_iso >= {AS_OF_SQL} THEN 1 ELSE 0 END) AS futuras FROM (
  SELECT fecha_iso, CASE WHEN fecha_iso < {AS_OF_SQL} THEN 'past' ELSE estado END AS estado FROM listing WHERE fecha_iso < {AS_OF_SQL} OR fecha_iso IS NULL
  UNION ALL SELECT DISTINCT ON (organiza, url_venta, fecha_iso, hora) fecha_iso, 'upcoming' FROM export WHERE fecha_iso >= {AS_OF_SQL}) GROUP BY estado""", _EXPORT)(
    lambda df: sinks.publish(df, sinks.publish_rows(sinks.export_columns(_refined(df)).filter(F.col("fecha_iso") >= LIT(AS_OF)), LIT(AS_OF)), AS_OF)
    .groupBy("estado").agg(F.count("*").alias("filas"), F.count("fecha_iso").alias("fechadas"),
                           F.count_if(F.col("fecha_iso") >= LIT(AS_OF)).alias("futuras")))

# ------------------------------------------------------------ feeds
SITE = "https://agenda.example"
_URL = "'<url><loc>' || loc || '</loc><changefreq>' || freq || '</changefreq><priority>' || p || '</priority></url>'"
on_listing("sitemap_rows", f"""
SELECT loc, {_URL} AS line FROM (
SELECT '{SITE}' || path AS loc, 'daily' AS freq, p FROM (VALUES ('/', '1.0'), ('/mapa', '0.8'), ('/calendario', '0.8'), ('/semana', '0.8')) t(path, p)
UNION ALL SELECT '{SITE}/evento/' || id, 'weekly', '0.6' FROM listing WHERE fecha_iso >= {AS_OF_SQL})""")(
    lambda df: feeds.sitemap_rows(df, SITE, AS_OF))
on_listing("sitemap_shards", f"""
SELECT shard, count(*) AS n, min(loc) AS first, max(loc) AS last FROM (SELECT loc, CAST((row_number() OVER (ORDER BY loc) - 1) // 1000 AS INT) AS shard FROM (
SELECT '{SITE}' || path AS loc FROM (VALUES ('/'), ('/mapa'), ('/calendario'), ('/semana')) t(path)
UNION ALL SELECT '{SITE}/evento/' || id FROM listing WHERE fecha_iso >= {AS_OF_SQL})) GROUP BY shard""")(
    lambda df: feeds.sitemap_shards(feeds.sitemap_rows(df, SITE, AS_OF), 1000).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("loc").alias("first"), F.max("loc").alias("last")))


def _xml(x: str) -> str:
    out = f"coalesce({x}, '')"
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&apos;"), ('"', "&quot;")):
        out = f"replace({out}, '{raw}', '{ent}')"
    return out


on_listing("rss_rows", f"""
SELECT id, {_xml('nombre')} AS title, '{SITE}/evento/' || id AS link,
 '<p><strong>Fecha:</strong> ' || fecha_iso || ' ' || {_xml('hora')} || '</p><p><strong>Lugar:</strong> ' || {_xml('lugar')} || '</p><p>'
 || {_xml("coalesce(descripcion, 'Evento cultural')")} || '</p>' || CASE WHEN imagen_url IS NOT NULL THEN '<img src="' || imagen_url || '" alt="Imagen del evento" />' ELSE '' END AS description,
 strftime(fecha_iso, '%a, %d %b %Y ') || coalesce(nullif(hora, ''), '00:00') || ':00 GMT' AS pub_date
FROM listing WHERE fecha_iso >= {AS_OF_SQL} ORDER BY fecha_iso, id LIMIT 50""")(
    lambda df: feeds.rss_rows(df, SITE, AS_OF))


def _ics(x: str) -> str:
    return rf"replace(replace(replace(coalesce({x}, ''), '\', '\\'), ';', '\;'), ',', '\,')"


_CR = " || chr(13) || chr(10) || "
on_listing("ics_rows", rf"""
SELECT id, 'BEGIN:VCALENDAR'{_CR}'VERSION:2.0'{_CR}'PRODID:-//listingflow//ES'{_CR}'CALSCALE:GREGORIAN'{_CR}'BEGIN:VEVENT'{_CR}
 'UID:' || id || '@listingflow'{_CR}'DTSTAMP:20270101T000000Z'{_CR}
 CASE WHEN h IS NULL THEN 'DTSTART;VALUE=DATE:' || d ELSE 'DTSTART:' || d || 'T' || lpad(h::VARCHAR, 2, '0') || m || '00' END{_CR}
 CASE WHEN h IS NULL THEN 'DTEND;VALUE=DATE:' || strftime(fecha_iso + 1, '%Y%m%d')
   WHEN h + 2 <= 23 THEN 'DTEND:' || d || 'T' || lpad((h + 2)::VARCHAR, 2, '0') || m || '00' ELSE 'DTEND:' || d || 'T235900' END{_CR}
 'SUMMARY:' || {_ics('nombre')}{_CR}'LOCATION:' || {_ics('lugar')} || coalesce(chr(13) || chr(10) || 'DESCRIPTION:' || {_ics('descripcion')} || CASE WHEN descripcion IS NULL THEN NULL ELSE '' END, '')
 {_CR}'URL:' || url_venta{_CR}'END:VEVENT'{_CR}'END:VCALENDAR' AS ics
FROM (SELECT *, strftime(fecha_iso, '%Y%m%d') AS d, TRY_CAST(string_split(nullif(hora, ''), ':')[1] AS INT) AS h, string_split(hora, ':')[2] AS m
  FROM listing WHERE fecha_iso IS NOT NULL)""")(
    lambda df: feeds.ics_rows(df, "20270101T000000Z"))

on_listing("jsonld_rows", """
SELECT id, '{"@context":"https://schema.org","@type":"Event","name":"' || nombre || '","startDate":"' || fecha_iso || coalesce('T' || nullif(hora, '') || ':00', '')
 || '","description":"' || coalesce(descripcion, 'Evento de ' || coalesce(estilo, 'Otros') || ' en ' || coalesce(lugar, '') || ', Gran Canaria')
 || '","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode","eventStatus":"https://schema.org/EventScheduled","url":"' || url_venta
 || '","location":{"@type":"Place",' || coalesce('"name":"' || lugar || '",', '') || '"address":{"@type":"PostalAddress","addressLocality":"Las Palmas de Gran Canaria","addressRegion":"Canarias","addressCountry":"ES"}'
 || coalesce(',"geo":{"@type":"GeoCoordinates","latitude":' || latitud || ',"longitude":' || longitud || '}', '')
 || '},"organizer":{"@type":"Organization","name":"' || organiza || '"}' || coalesce(',"image":"' || imagen_url || '"', '')
 || coalesce(',"offers":{"@type":"Offer","price":' || precio_num || ',"priceCurrency":"EUR","url":"' || url_venta || '","availability":"https://schema.org/InStock"}', '') || '}' AS jsonld
FROM listing WHERE fecha_iso IS NOT NULL""")(lambda df: feeds.jsonld_rows(df))
