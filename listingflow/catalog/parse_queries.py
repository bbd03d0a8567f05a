"""Extraction queries: price, date, hour, image, link, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, vocab as v
from ..operators import facts
from ..operators.upsert import drop_long_courses
from . import sqltext as s
from .registry import on_listing, query
from .tables import AS_OF, AS_OF_SQL, MONTH_NAMES, MONTHS_SQL, ORDERS_SQL, case, orders, table

LIT, TXT = F.lit, F.concat


def _s(c):
    return c.cast("string")


def today():
    return F.lit(AS_OF)


# ------------------------------------------------------------ price
PRICE_TEXT_SQL = """prices AS (SELECT o_orderkey AS id, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Entradas de ' || a || ' - ' || b || ' €'
  WHEN '2-HIGH' THEN 'COMPRAR - Desde: ' || a || ' €'
  WHEN '3-MEDIUM' THEN a || ' EUROS en taquilla'
  WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Entrada libre hasta aforo' ELSE 'Por confirmar' END
  ELSE 'Precio final € ' || b || ' (gratis menores)' END AS t
FROM (SELECT *, replace(CAST(floor(o_totalprice / 5) / CAST(100 AS DOUBLE) AS VARCHAR), '.', ',') AS a,
  CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS VARCHAR) AS b FROM ord))"""


def price_text(spark, sf):
    a = F.replace(_s(F.floor(F.col("o_totalprice") / 5) / 100.0), LIT("."), LIT(","))
    b = _s(F.floor(F.col("o_totalprice") / 500))
    t = case(F.col("o_orderpriority"), {
        "1-URGENT": TXT(LIT("Entradas de "), a, LIT(" - "), b, LIT(" €")),
        "2-HIGH": TXT(LIT("COMPRAR - Desde: "), a, LIT(" €")),
        "3-MEDIUM": TXT(a, LIT(" EUROS en taquilla")),
        "4-NOT SPECIFIED": F.when(F.col("o_orderkey") % 2 == 0, "Entrada libre hasta aforo").otherwise("Por confirmar"),
    }).otherwise(TXT(LIT("Precio final € "), b, LIT(" (gratis menores)")))
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), t.alias("t"))


_NUM = r"(\d+[.,]?\d*)"
_FREE = s.any_of("lower(t)", v.FREE_WORDS)


@query("extract_price", rf"""
WITH {ORDERS_SQL}, {PRICE_TEXT_SQL}, found AS (SELECT id, t, CAST(replace(coalesce(
    nullif(regexp_extract(t, '(?i){_NUM}\s*(?:-|al|y)\s*{_NUM}\s*(?:€|eur)', 1), ''),
    nullif(regexp_extract(t, '(?i)(?:desde|a partir de|precio)\s*:?\s*{_NUM}', 1), ''),
    nullif(regexp_extract(t, '(?i)(?:€|euros|eur)\s*{_NUM}', 1), ''),
    nullif(regexp_extract(t, '(?i){_NUM}\s*(?:€|eur)', 1), '')), ',', '.') AS DOUBLE) AS p FROM prices)
SELECT id, CASE WHEN p < 500 THEN p WHEN {_FREE} THEN CAST(0 AS DOUBLE) END AS price,
  CAST(replace(nullif(regexp_extract(t, '{_NUM}\s*€', 1), ''), ',', '.') AS DOUBLE) AS card FROM found""")
def _(spark, sf):
    t = F.col("t")
    return price_text(spark, sf).select("id", parse.extract_price(t).alias("price"), parse.card_price(t).alias("card"))


on_listing("price_cap", "SELECT id, CASE WHEN precio_num > 300 THEN NULL ELSE precio_num END AS precio_num FROM listing")(
    lambda df: df.select("id", parse.price_cap(F.col("precio_num")).alias("precio_num")))

# ------------------------------------------------------------ dates
DATE_TEXT_SQL = f"""dates AS (SELECT o_orderkey AS id, o_orderkey, o_orderpriority, day, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Fecha ' || CAST(day AS VARCHAR) || 'T20:00:00'
  WHEN '2-HIGH' THEN 'Apertura 19:00 ' || d || '/' || m || '/' || CASE WHEN o_orderkey % 2 = 0 THEN y ELSE right(y, 2) END
  WHEN '3-MEDIUM' THEN 'Del ' || d || ' al 28 de ' || upper(mn) || ' ' || y
  WHEN '4-NOT SPECIFIED' THEN d || ' de ' || mn || CASE WHEN o_orderkey % 2 = 0 THEN ' de ' || y ELSE '' END
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN '31/02/2027 y ' || d || ' de ' || left(mn, 3) || ' ' || y ELSE 'Tel. 928-36-99' END END AS t
FROM (SELECT *, CAST(day(day) AS VARCHAR) AS d, CAST(month(day) AS VARCHAR) AS m, CAST(year(day) AS VARCHAR) AS y,
  ({MONTHS_SQL})[month(day)] AS mn FROM ord))"""


def date_text(spark, sf):
    d, m, y = _s(F.day("day")), _s(F.month("day")), _s(F.year("day"))
    mn = F.element_at(F.array(*[LIT(x) for x in MONTH_NAMES]), F.month("day"))
    even = F.col("o_orderkey") % 2 == 0
    t = case(F.col("o_orderpriority"), {
        "1-URGENT": TXT(LIT("Fecha "), _s(F.col("day")), LIT("T20:00:00")),
        "2-HIGH": TXT(LIT("Apertura 19:00 "), d, LIT("/"), m, LIT("/"), F.when(even, y).otherwise(F.right(y, LIT(2)))),
        "3-MEDIUM": TXT(LIT("Del "), d, LIT(" al 28 de "), F.upper(mn), LIT(" "), y),
        "4-NOT SPECIFIED": TXT(d, LIT(" de "), mn, F.when(even, TXT(LIT(" de "), y)).otherwise("")),
    }).otherwise(F.when(even, TXT(LIT("31/02/2027 y "), d, LIT(" de "), F.left(mn, LIT(3)), LIT(" "), y)).otherwise("Tel. 928-36-99"))
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), "day", t.alias("t"))


_WORD = r"[\p{L}\p{N}_]+"


def _inferred(m: str, d: str) -> str:
    cand = s.day_of(f"year({AS_OF_SQL})", m, d)
    return f"CASE WHEN {cand} < {AS_OF_SQL} - 30 THEN year({AS_OF_SQL}) + 1 WHEN {cand} IS NOT NULL THEN year({AS_OF_SQL}) END"


def _ok(x: str) -> str:
    return f"CASE WHEN year({x}) BETWEEN 2024 AND 2030 THEN {x} END"


@query("extract_date", rf"""
WITH {ORDERS_SQL}, {DATE_TEXT_SQL}, g AS (SELECT id, t,
  TRY_CAST(nullif(regexp_extract(t, '\d{{4}}-\d{{2}}-\d{{2}}'), '') AS DATE) AS iso,
  regexp_extract(t, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})', ['d', 'm', 'y']) AS dmy,
  regexp_extract(t, '(?i)(\d{{1,2}})\s+(?:al|y|de|a)\s+(\d{{1,2}})\s+de\s+({_WORD})\s+(20\d{{2}})?', ['d', 'e', 'm', 'y']) AS span,
  regexp_extract(t, '(?i)(\d{{1,2}})\s+de\s+({_WORD})(?:\s+(?:de\s+)?(20\d{{2}}))?', ['d', 'm', 'y']) AS txt FROM dates),
n AS (SELECT *, TRY_CAST(CASE WHEN length(dmy.y) = 2 THEN '20' || dmy.y ELSE dmy.y END AS INT) AS y2,
  TRY_CAST(dmy.m AS INT) AS m2, TRY_CAST(dmy.d AS INT) AS d2,
  {s.months('lower(span.m)')} AS m3, TRY_CAST(span.d AS INT) AS d3, TRY_CAST(span.y AS INT) AS y3,
  coalesce({s.months('lower(txt.m)')}, CASE WHEN length(txt.m) > 3 THEN {s.months('left(lower(txt.m), 3)')} END) AS m4,
  TRY_CAST(txt.d AS INT) AS d4, TRY_CAST(txt.y AS INT) AS y4 FROM g)
SELECT id, coalesce({_ok('iso')}, {_ok(s.day_of('y2', 'm2', 'd2'))},
  {_ok(s.day_of(f"coalesce(y3, {_inferred('m3', 'd3')})", 'm3', 'd3'))},
  {_ok(s.day_of(f"coalesce(y4, {_inferred('m4', 'd4')})", 'm4', 'd4'))}) AS fecha FROM n""")
def _(spark, sf):
    return date_text(spark, sf).select("id", parse.extract_date(F.col("t"), today()).alias("fecha"))


@query("infer_year", f"""
WITH {ORDERS_SQL}, x AS (SELECT o_orderkey AS id, month(day) AS m, least(day(day) + 3, 31) AS d FROM ord)
SELECT id, {_inferred('m', 'd')} AS anio, {s.day_of(_inferred('m', 'd'), 'm', 'd')} AS badge,
  {s.day_of(_inferred('m', 'd'), 'm', 'd')} AS normal FROM x""")
def _(spark, sf):
    d = F.least(F.day("day") + 3, LIT(31))
    mn = F.element_at(F.array(*[LIT(x) for x in MONTH_NAMES]), F.month("day"))
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("id"), parse.infer_year(F.month("day"), d, today()).alias("anio"),
        parse.badge_date(TXT(LIT(" "), _s(d)), F.upper(mn), today()).alias("badge"),
        parse.normalize_date(TXT(LIT("Sábado "), _s(d), LIT(" de "), mn), today()).alias("normal"))


def span_text():
    f = lambda c: F.date_format(c, "dd.MM.yyyy")
    k = F.col("o_orderkey")
    return F.when(k % 3 == 0, TXT(LIT("Exposición "), f("day"))).when(k % 3 == 1, TXT(
        f("day"), LIT(" - "), f(F.date_add("day", (k % 60).cast("int"))), LIT(" Sala 2"))).otherwise("Todo el día")


SPAN_SQL = """x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN day END AS s,
  CASE WHEN o_orderkey % 3 = 0 THEN day WHEN o_orderkey % 3 = 1 THEN CAST(day + CAST(o_orderkey % 60 AS INT) AS DATE) END AS e FROM ord)"""


@query("extract_date_range", f"""WITH {ORDERS_SQL}, {SPAN_SQL}
SELECT id, s AS fecha_inicio, e AS fecha_fin, coalesce(e - s > 30, false) AS es_curso FROM x""")
def _(spark, sf):
    r = parse.extract_date_range(span_text())
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), r.alias("r")).select(
        "id", F.col("r.start").alias("fecha_inicio"), F.col("r.end").alias("fecha_fin"), F.col("r.is_course").alias("es_curso"))


@query("drop_long_courses", f"""WITH {ORDERS_SQL}, {SPAN_SQL}
SELECT id, CASE WHEN s >= {AS_OF_SQL} THEN s END AS fecha_iso FROM x
WHERE NOT coalesce(e - s > 30, false) AND NOT coalesce(s < {AS_OF_SQL} AND NOT e >= {AS_OF_SQL}, false)""")
def _(spark, sf):
    rows = orders(spark, sf).select(F.col("o_orderkey").alias("id"), parse.extract_date_range(span_text()).alias("span"))
    return drop_long_courses(rows, today()).select("id", "fecha_iso")


@query("last_day_of_range", f"""WITH {ORDERS_SQL}, x AS (SELECT o_orderkey AS id, month(day) AS m, day(day) AS d FROM ord)
SELECT id, {s.day_of(_inferred('m', 'd'), 'm', 'd')} AS fecha FROM x""")
def _(spark, sf):
    mn = F.element_at(F.array(*[LIT(x) for x in MONTH_NAMES]), F.month("day"))
    text = TXT(LIT("Del 1 al "), _s(F.day("day")), LIT(" de "), mn)
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), parse.last_day_of_range(text, today()).alias("fecha"))


# ------------------------------------------------------------ hours
HOUR_TEXT_SQL = """hours AS (SELECT o_orderkey AS id, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Puertas 10.31€, a las ' || h || ':' || mm
  WHEN '2-HIGH' THEN 'Desde ' || h || '.' || mm || ' € , sesión ' || h || 'h' || mm
  WHEN '3-MEDIUM' THEN 'Pase ' || h || ' hrs'
  WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Todo el día' ELSE '25:00 y ' || h || ' h.' END
  ELSE '2027-02-14T' || lpad(h, 2, '0') || ':' || mm || ':00' END AS t
FROM (SELECT *, CAST(o_orderkey % 24 AS VARCHAR) AS h, CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '45' END AS mm FROM ord))"""


def hour_text(spark, sf):
    k = F.col("o_orderkey")
    h, mm = _s(k % 24), F.when(k % 3 == 0, "00").otherwise("45")
    t = case(F.col("o_orderpriority"), {
        "1-URGENT": TXT(LIT("Puertas 10.31€, a las "), h, LIT(":"), mm),
        "2-HIGH": TXT(LIT("Desde "), h, LIT("."), mm, LIT(" € , sesión "), h, LIT("h"), mm),
        "3-MEDIUM": TXT(LIT("Pase "), h, LIT(" hrs")),
        "4-NOT SPECIFIED": F.when(k % 2 == 0, "Todo el día").otherwise(TXT(LIT("25:00 y "), h, LIT(" h."))),
    }).otherwise(TXT(LIT("2027-02-14T"), F.lpad(h, 2, "0"), LIT(":"), mm, LIT(":00")))
    return orders(spark, sf).select(k.alias("id"), t.alias("t"))


# Amounts of money are cut out first, as RE2 has no look-ahead.
_CUT = r"regexp_replace(t, '(?i)(^|[\s,;(T])[012]?\d[:.h][0-5]\d\s*(?:€|euros|%|\$)', '\1', 'g')"


@query("extract_hour", rf"""WITH {ORDERS_SQL}, {HOUR_TEXT_SQL}, g AS (SELECT id, t,
  regexp_extract(t, '(?i)a\s+las?\s+([012]?\d)[:.h]([0-5]\d)', ['h', 'm']) AS a,
  regexp_extract({_CUT}, '(?i)(?:^|[\s,;(T])([012]?\d)[:.h]([0-5]\d)(?:\s*(?:horas?|hrs?|h))?(?:\b|$)', ['h', 'm']) AS b,
  regexp_extract(t, '(?i)(?:^|[\s,;(T])(\d{{1,2}})\s*(?:horas|hrs|h)(?:\b|$)', 1) AS c,
  regexp_extract(t, '(\d{{1,2}})[:.hH](\d{{2}})', ['h', 'm']) AS p FROM hours),
x AS (SELECT *, coalesce(CASE WHEN TRY_CAST(a.h AS INT) <= 23 THEN lpad(a.h, 2, '0') || ':' || a.m END,
  CASE WHEN TRY_CAST(b.h AS INT) <= 23 THEN lpad(b.h, 2, '0') || ':' || b.m END,
  CASE WHEN TRY_CAST(c AS INT) <= 23 THEN lpad(c, 2, '0') || ':00' END) AS hora FROM g)
SELECT id, CASE WHEN hora NOT IN ('05:00', '06:00', '07:00') THEN hora END AS hora,
  CASE WHEN NOT contains(lower(t), 'todo el') AND p.h <> '' THEN lpad(p.h, 2, '0') || ':' || p.m END AS simple FROM x""")
def _(spark, sf):
    t = F.col("t")
    return hour_text(spark, sf).select("id", parse.extract_hour(t).alias("hora"), parse.plain_hour(t).alias("simple"))


on_listing("hour_to_minutes", """
SELECT id, coalesce(TRY_CAST(string_split(hora, ':')[1] AS INT) * 60 + TRY_CAST(string_split(hora, ':')[2] AS INT), -999) AS minutos FROM listing""")(
    lambda df: df.select("id", parse.hour_to_minutes(F.col("hora")).alias("minutos")))


@query("to_local", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 30 MINUTE AS utc FROM lineitem),
y AS (SELECT *, (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Atlantic/Canary' AS loc, ((utc - INTERVAL 2 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Atlantic/Canary' AS off FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(loc AS DATE) AS dia, strftime(loc, '%H:%M') AS hora,
  CAST(off AS DATE) AS dia_zona, strftime(off, '%H:%M') AS hora_zona, strftime(utc, '%H:%M') AS hora_sin_zona FROM y""")
def _(spark, sf):
    stamp = TXT(F.date_format("l_shipdate", "yyyy-MM-dd"), LIT("T23:30:00"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", parse.to_local(stamp).alias("a"),
        parse.to_local(TXT(stamp, LIT("+02:00"))).alias("b"), parse.to_local(stamp, naive_is_utc=False).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("a.day").alias("dia"), F.col("a.hour").alias("hora"),
                       F.col("b.day").alias("dia_zona"), F.col("b.hour").alias("hora_zona"), F.col("c.hour").alias("hora_sin_zona"))


# ------------------------------------------------------------ urls
on_listing("valid_image", f"SELECT id, {s.valid_image('imagen_url')} AS imagen_url, {s.valid_image('imagen_url', None)} AS export FROM listing")(
    lambda df: df.select("id", parse.valid_image(F.col("imagen_url")).alias("imagen_url"),
                         parse.valid_image(F.col("imagen_url"), ()).alias("export")))


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1))"
_CODES = " ".join(f"WHEN contains(h, '{a}') THEN '{b}'" for a, b in v.HOST_CODES)


@query("domain_of", rf"""WITH {ORDERS_SQL.replace('ord AS', 'unused AS')}, u AS (SELECT page_id, url FROM pages
  UNION ALL SELECT 1000000 + c_custkey, (['https://www.tomaticket.es/', 'https://TICKETY.es/e', 'https://entradas.com/x', 'mal'])[c_custkey % 4 + 1] FROM customer)
SELECT page_id, CASE {_CODES} ELSE 'generico' END AS codigo,
  CASE WHEN contains(lower(url), 'tomaticket') THEN 'tomaticket' WHEN contains(lower(url), 'tickety') THEN 'tickety' END AS fuente
FROM (SELECT *, {_HOST} AS h FROM u)""")
def _(spark, sf):
    more = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("page_id"), F.element_at(F.array(
        LIT("https://www.tomaticket.es/"), LIT("https://TICKETY.es/e"), LIT("https://entradas.com/x"), LIT("mal")),
        (F.col("c_custkey") % 4 + 1).cast("int")).alias("url"))
    urls = table(spark, sf, "pages").select("page_id", "url").unionByName(more)
    return urls.select("page_id", parse.domain_of(F.col("url")).alias("codigo"), parse.page_venue_source(F.col("url")).alias("fuente"))


@on_listing("resolve_url", """
SELECT id, CASE WHEN id % 2 = 0 THEN base ELSE regexp_replace(base, '/register/?$', '/') END AS url FROM (
SELECT id, CASE WHEN id % 2 = 0 THEN 'https://site.example/' || regexp_extract(url_venta, '^https?://[^/]*/([^?]*)', 1) || '/'
  ELSE 'https://site.example/' || regexp_extract(url_venta, '^https?://[^/]*/([^?]*)', 1) || '/' END AS base FROM listing)""")
def _(df):
    path = F.regexp_extract("url_venta", r"^https?://[^/]*(/.*)$", 1)
    href = F.when(F.col("id") % 2 == 0, path).otherwise(TXT(F.regexp_extract(path, r"^/([^?]*)", 1), LIT("/register")))
    return df.select("id", parse.resolve_url(href, "https://site.example", slash="add").alias("url"))


@query("prefer_ticket_link", """
WITH x AS (SELECT o_custkey, list(url ORDER BY o_orderkey) AS links FROM (SELECT o_custkey, o_orderkey,
  (['https://blog.example/a', 'https://otra.example/b', 'https://www.tomaticket.es/c'])[o_orderkey % 3 + 1] AS url FROM orders) GROUP BY o_custkey)
SELECT o_custkey, coalesce(list_filter(links, lambda u: contains(u, 'tomaticket'))[1],
  list_filter(links, lambda u: NOT contains(u, 'blog.example'))[1], 'https://blog.example/p') AS link FROM x""")
def _(spark, sf):
    url = F.element_at(F.array(LIT("https://blog.example/a"), LIT("https://otra.example/b"), LIT("https://www.tomaticket.es/c")),
                       (F.col("o_orderkey") % 3 + 1).cast("int"))
    packed = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", url.alias("u")))), lambda x: x["u"]).alias("links"))
    return packed.select("o_custkey", parse.prefer_ticket_link(F.col("links"), LIT("https://blog.example/p"), LIT("blog.example")).alias("link"))


on_listing("map_link", r"""
SELECT id, link, TRY_CAST(nullif(regexp_extract(link, 'q=([-\d.]+),([-\d.]+)', 1), '') AS DOUBLE) AS lat,
  TRY_CAST(nullif(regexp_extract(link, 'q=([-\d.]+),([-\d.]+)', 2), '') AS DOUBLE) AS lon FROM (
SELECT id, CASE WHEN latitud > 27 AND latitud < 28 THEN 'https://www.google.com/maps?q=' || latitud || ',' || longitud ELSE '' END AS link
FROM (SELECT id, latitud + CASE WHEN id % 5 = 0 THEN 100 ELSE 0 END AS latitud, longitud FROM listing))""".replace("< 28", "< 30"))(
    lambda df: (lambda lat: df.select("id", parse.map_link(lat, F.col("longitud")).alias("link")).select(
        "id", "link", *[c.alias(n) for c, n in zip(parse.coords_from_link(F.col("link")), ("lat", "lon"))]))(
            F.col("latitud") + F.when(F.col("id") % 5 == 0, 100).otherwise(0)))


# ------------------------------------------------------------ layers, merge
CANDIDATES_SQL = """cand AS (
  SELECT l_orderkey AS page_id, (['precio_num', 'fecha_iso', 'hora', 'lugar'])[l_linenumber % 4 + 1] AS field,
    l_suppkey % 4 + 1 AS layer, l_partkey AS ord,
    CASE l_linenumber % 4 WHEN 3 THEN CASE WHEN l_quantity < 10 THEN 'Gran Canaria' WHEN l_quantity < 20 THEN '12,5 €' ELSE 'Sala ' || l_partkey END
      ELSE CAST(l_partkey AS VARCHAR) END AS value FROM lineitem)"""


@query("layered_facts", f"""WITH {CANDIDATES_SQL}, ok AS (SELECT * FROM cand WHERE field <> 'lugar' OR layer = 1 OR (
  length(value) > 2 AND length(value) < 120 AND NOT regexp_matches(value, '^\\d+[.,]\\d+\\s*€')
  AND NOT regexp_matches(value, '^\\d{{2}}[/.-]\\d{{2}}') AND NOT {s.generic_place('value')}))
SELECT page_id, {', '.join(f"arg_min(value, layer * 1000000000 + ord) FILTER (WHERE field = '{f}') AS {f}" for f in facts.FIELDS)}
FROM ok GROUP BY page_id""")
def _(spark, sf):
    m = F.col("l_linenumber") % 4
    value = F.when(m == 3, F.when(F.col("l_quantity") < 10, "Gran Canaria").when(F.col("l_quantity") < 20, "12,5 €").otherwise(
        TXT(LIT("Sala "), _s(F.col("l_partkey"))))).otherwise(_s(F.col("l_partkey")))
    field = F.element_at(F.array(*[LIT(x) for x in ("precio_num", "fecha_iso", "hora", "lugar")]), (m + 1).cast("int"))
    cand = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), field.alias("field"), (F.col("l_suppkey") % 4 + 1).alias("layer"),
        F.col("l_partkey").alias("ord"), value.alias("value"), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return facts.layered_facts(cand, ties=["file_path", "row_index"])  # the first in the table, as the SQL has it


@on_listing("card_detail_merge", f"""
SELECT * FROM (SELECT 'u' || c.id AS url, coalesce(
    CASE WHEN NOT {s.generic_title("d.nombre")} THEN d.nombre END, CASE WHEN NOT {s.generic_title("c.nombre")} THEN c.nombre END) AS nombre,
  coalesce(d.precio_num, c.precio_num) AS precio_num, coalesce(c.hora, d.hora) AS hora, c.lugar AS lugar
FROM listing c LEFT JOIN (SELECT * FROM listing WHERE enriquecido) d ON d.id = c.id + 1) WHERE nombre IS NOT NULL""")
def _(df):
    url = TXT(LIT("u"), _s(F.col("id")))
    cards = df.select(url.alias("url"), "nombre", "precio_num", "hora", "lugar")
    details = df.filter("enriquecido").select(TXT(LIT("u"), _s(F.col("id") - 1)).alias("url"), "nombre", "precio_num", "hora")
    # A one-part key such as "u12" is no readable name, so rows without a title go.
    return facts.card_detail_merge(cards, details, card_first=("hora",))
