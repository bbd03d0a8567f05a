"""Look-ups, joins, aggregates, survivorship, upsert and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, functions as F

from ..functions import vocab as v
from ..operators import aggregates, lookups, quality, sets, survivors, upsert
from ..schema import LISTING_SCHEMA, backfill, conform
from ..session import checkpoint_dir, settle
from ..streaming import bucketed
from ..streaming.seen_runs import missed_runs
from ..streaming.upsert_stream import read_target, upsert_stream
from . import sqltext as s
from .registry import on_listing, query
from .tables import AS_OF, AS_OF_SQL, LISTING_SQL, ORDERS_SQL, dealt, listing, order_stream, orders, table

LIT, TXT = F.lit, F.concat


def _s(c):
    return c.cast("string")


def today():
    return F.lit(AS_OF)


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(s.q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") t({names})"


# ------------------------------------------------------------ look-ups
_COORDS = "coords AS (SELECT ord, key, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM " + _values(
    [(i, *r) for i, r in enumerate(v.PLACE_COORDS)], "ord, key, lat, lon") + ")"
_GAZ = """gaz AS (SELECT lower(c_name) AS place_norm, 1 AS query_ord, 27 + c_nationkey * 0.1::DOUBLE AS lat, -15.5::DOUBLE AS lon FROM customer
  UNION ALL SELECT place, qo, la, lo FROM (VALUES ('pub el rincon', 2, 28.0::DOUBLE, -15.4::DOUBLE), ('pub el rincon', 1, 40.0::DOUBLE, -3.0::DOUBLE), ('club nautico', 1, 28.1::DOUBLE, -15.42::DOUBLE)) g(place, qo, la, lo))"""


def gazetteer(spark, sf):
    c = table(spark, sf, "customer")
    base = c.select(F.lower("c_name").alias("place_norm"), LIT(1).alias("query_ord"),
                    (27 + F.col("c_nationkey") * 0.1).alias("lat"), LIT(-15.5).alias("lon"))
    known = spark.createDataFrame([("pub el rincon", 2, 28.0, -15.4), ("pub el rincon", 1, 40.0, -3.0), ("club nautico", 1, 28.1, -15.42)],
                                  "place_norm string, query_ord int, lat double, lon double")
    return base.unionByName(known)


@query("lookup_coords", f"""
WITH {LISTING_SQL}, {_COORDS}, {_GAZ}, places AS (SELECT DISTINCT {s.fold('lugar')} AS p FROM listing),
d AS (SELECT p, arg_min(lat, (CASE WHEN key = p THEN 0 ELSE 1000 END) + ord) AS lat, arg_min(lon, (CASE WHEN key = p THEN 0 ELSE 1000 END) + ord) AS lon
  FROM places JOIN coords ON contains(p, key) OR contains(key, p) WHERE p <> '' GROUP BY p),
g AS (SELECT place_norm, arg_min(lat, query_ord) AS lat, arg_min(lon, query_ord) AS lon FROM gaz
  WHERE lat > 27.5 AND lat < 28.3 AND lon > -16.0 AND lon < -15.2 GROUP BY place_norm)
SELECT id, CASE WHEN miss THEN coalesce(d.lat, g.lat, 28.1235::DOUBLE) ELSE latitud END AS latitud,
  CASE WHEN miss THEN coalesce(d.lon, g.lon, (-15.4363)::DOUBLE) ELSE longitud END AS longitud,
  CASE WHEN NOT miss THEN NULL WHEN d.lat IS NOT NULL THEN 'dictionary' WHEN g.lat IS NOT NULL THEN 'gazetteer' ELSE 'fallback' END AS geo_method
FROM (SELECT *, latitud IS NULL OR longitud IS NULL AS miss, {s.fold('lugar')} AS p FROM listing) l LEFT JOIN d USING (p) LEFT JOIN g ON g.place_norm = l.p""")
def _(spark, sf):
    return lookups.lookup_coords(listing(spark, sf), gazetteer(spark, sf)).select("id", "latitud", "longitud", "geo_method")


@query("gazetteer_box", f"""WITH {_GAZ} SELECT place_norm, arg_min(lat, query_ord) AS lat, arg_min(lon, query_ord) AS lon FROM gaz
WHERE lat > 27.5 AND lat < 28.3 AND lon > -16.0 AND lon < -15.2 GROUP BY place_norm""")
def _(spark, sf):
    return lookups.gazetteer_hits(gazetteer(spark, sf)).select("place_norm", F.col("gaz.lat").alias("lat"), F.col("gaz.lon").alias("lon"))


_PATTERNS = "pats AS (SELECT * FROM " + _values([(i, *r) for i, r in enumerate(v.VENUE_PATTERNS)], "ord, pat, venue") + ")"
_DOMAINS = " ".join(f"WHEN contains(lower(url_venta), {s.q(a)}) THEN {s.q(b)}" for a, b in v.VENUE_DOMAINS)
_ADDRESS = s.strip(r"regexp_extract(descripcion, '(?i)(?:en\s+(?:el|la|los|las)\s+)?((?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Campus|Salón de actos|Edificio)\s+[^.,:;\n]{3,60})', 1)")


def _first_pattern(col: str) -> str:
    return f"(SELECT arg_min(venue, ord) FROM pats WHERE contains({s.fold(col)}, pat))"


_DETECTED = f"""found AS (SELECT *, CASE WHEN {s.generic_place('lugar')} THEN coalesce({_first_pattern('nombre')}, {_first_pattern('descripcion')},
  CASE {_DOMAINS} END, CASE WHEN length({_ADDRESS}) > 5 THEN {_ADDRESS} END) END AS venue FROM listing)"""
on_listing("detect_venue", """SELECT id, coalesce(venue, lugar) AS lugar, CASE WHEN venue IS NULL THEN latitud END AS latitud,
  CASE WHEN venue IS NULL THEN longitud END AS longitud FROM found""", _PATTERNS + ", " + _DETECTED)(
    lambda df: lookups.detect_venue(df).select("id", "lugar", "latitud", "longitud"))

_SCORES = []
for _i, (_cat, _words) in enumerate(v.STARTER_KEYWORDS):
    _points = " + ".join(f"CASE WHEN contains(lower(t), {s.q(w)}) THEN 3 WHEN contains(lower(t || ' ' || coalesce(d, '')), {s.q(w)}) THEN 1 ELSE 0 END" for w in _words)
    _SCORES.append(f"{{'score': {_points}, 'ord': {-_i}, 'name': {s.q(_cat)}}}")
_BEST = f"list_sort([{', '.join(_SCORES)}], 'DESC')[1]"
on_listing("classify_keywords", f"""SELECT id, CASE WHEN b.score > 0 THEN b.name ELSE estilo END AS estilo FROM (
SELECT id, estilo, {_BEST} AS b FROM (SELECT id, estilo, nombre AS t, descripcion AS d FROM listing))""")(
    lambda df: lookups.classify_keywords(df).select("id", "estilo"))


@query("classify_documents", f"""SELECT doc_id, CASE WHEN b.score > 0 THEN b.name ELSE 'Otros' END AS estilo FROM (
SELECT doc_id, {_BEST} AS b FROM (SELECT doc_id, source AS t, text AS d FROM documents))""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("nombre"), F.col("text").alias("descripcion"), LIT(v.DEFAULT_CATEGORY).alias("estilo"))
    return lookups.classify_keywords(docs).select("doc_id", "estilo")


_KEYWORDS = """kw AS (SELECT CAST(substr(p_brand, 7) AS INT) AS ord, p_brand AS category, p_name AS keyword FROM part)"""


@query("classify_by_table", f"""WITH {LISTING_SQL}, {_KEYWORDS},
uses AS (SELECT keyword, category, any_value(ord) AS ord, count(*) AS n FROM kw GROUP BY keyword, category),
words AS (SELECT DISTINCT keyword FROM uses),
hits AS (SELECT id, keyword, CASE WHEN contains(lower(nombre), keyword) THEN 3 ELSE 1 END AS w FROM listing JOIN words
  ON contains(lower(nombre || ' ' || coalesce(descripcion, '')), keyword)),
points AS (SELECT id, category, any_value(ord) AS ord, sum(w * n) AS score FROM hits JOIN uses USING (keyword) GROUP BY id, category),
best AS (SELECT id, category FROM points QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1)
SELECT id, coalesce(category, estilo) AS estilo FROM listing LEFT JOIN best USING (id)""")
def _(spark, sf):
    words = table(spark, sf, "part").select(
        F.substring("p_brand", 7, 9).cast("int").alias("ord"), F.col("p_brand").alias("category"), F.col("p_name").alias("keyword"))
    rows = dealt(listing(spark, sf).select("id", "nombre", "descripcion", "estilo"))
    return lookups.classify_by_table(rows, words).select("id", "estilo")


on_listing("classify_counters", f"""SELECT count(*) AS procesados, count(*) FILTER (WHERE b.score > 0 AND b.name IS DISTINCT FROM estilo) AS reclasificados FROM (
SELECT estilo, {_BEST} AS b FROM (SELECT estilo, nombre AS t, descripcion AS d FROM listing))""")(
    lambda df: aggregates.classify_counters(df, lookups.classify_keywords(df)))


@query("apply_labels", f"""WITH {LISTING_SQL}, lab AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Desconocida' WHEN quality = 1 THEN 'Teatro' ELSE 'Otros' END AS categoria FROM labels)
SELECT listing.id, CASE WHEN categoria IN ({', '.join(s.q(c) for c in v.CATEGORIES)}) AND categoria <> 'Otros' THEN categoria ELSE estilo END AS estilo
FROM listing LEFT JOIN lab ON lab.id = listing.id""")
def _(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "Desconocida").when(
        F.col("quality") == 1, "Teatro").otherwise("Otros").alias("categoria"))
    return lookups.apply_labels(listing(spark, sf), lab).select("id", "estilo")


_MANY = "SELECT doc_id, unnest([1, 2, 3]) AS n FROM documents"


@query("apply_labels_repeated", f"""WITH {LISTING_SQL}, lab AS (SELECT doc_id AS id, n AS ord, ['Otros', 'Cine', 'Teatro', 'Humor', 'Nada'][(doc_id + n) % 5 + 1] AS categoria FROM ({_MANY})),
last AS (SELECT id, max_by(categoria, ord) AS categoria FROM lab WHERE categoria IN ({', '.join(s.q(c) for c in v.CATEGORIES)}) AND categoria <> 'Otros' GROUP BY id)
SELECT listing.id, coalesce(categoria, estilo) AS estilo FROM listing LEFT JOIN last ON last.id = listing.id""")
def _(spark, sf):
    """Three labels of each id; the last one that is a category counts."""
    k, n = F.col("id"), F.col("order")
    lab = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(*[LIT(i) for i in (1, 2, 3)])).alias("order"))
    names = F.array(*[LIT(c) for c in ("Otros", "Cine", "Teatro", "Humor", "Nada")])
    lab = lab.withColumn("categoria", F.element_at(names, ((k + n) % 5 + 1).cast("int")))
    return lookups.apply_labels(listing(spark, sf), lab).select("id", "estilo")


@query("apply_enrichment_repeated", f"""WITH {LISTING_SQL}, enr AS (SELECT doc_id AS id, max_by('Sala ' || n, n) AS pl FROM ({_MANY}) GROUP BY doc_id)
SELECT listing.id, CASE WHEN pl IS NOT NULL AND {s.generic_place('lugar')} THEN pl ELSE lugar END AS lugar FROM listing LEFT JOIN enr ON enr.id = listing.id""")
def _(spark, sf):
    """Three enrichments of each id; the last one counts."""
    none = LIT(None).cast("string")
    enr = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(*[LIT(i) for i in (3, 1, 2)])).alias("order")).select(
        "id", "order", none.alias("descripcion_limpia"), LIT(None).cast("double").alias("precio_num"), none.alias("hora"),
        TXT(LIT("Sala "), _s(F.col("order"))).alias("lugar_corregido"))
    return lookups.apply_enrichment(listing(spark, sf), enr).select("id", "lugar")


@query("apply_enrichment", f"""WITH {LISTING_SQL}, enr AS (SELECT doc_id AS id, '[Generado por IA] ' || text AS t, n_chars::DOUBLE AS p,
  CASE WHEN doc_id % 2 = 0 THEN '21:00' ELSE 'tarde' END AS h, CASE WHEN doc_id % 3 = 0 THEN ' Sala ' || source ELSE 'x' END AS pl FROM documents),
j AS (SELECT listing.*, t, p, h, CASE WHEN {s.generic_place('lugar')} AND length(pl) > 2 THEN {s.strip('pl')} END AS np FROM listing LEFT JOIN enr ON enr.id = listing.id)
SELECT id, md5(CASE WHEN length(t) > 20 THEN {s.strip("replace(t, '[Generado por IA]', '')")} ELSE descripcion END) AS descripcion, coalesce(np, lugar) AS lugar,
  CASE WHEN np IS NULL THEN latitud END AS latitud, coalesce(precio_num, p) AS precio_num,
  coalesce(hora, CASE WHEN contains(h, ':') THEN h END) AS hora, true AS enriquecido FROM j""")
def _(spark, sf):
    k = F.col("doc_id")
    enr = table(spark, sf, "documents").select(
        k.alias("id"), TXT(LIT("[Generado por IA] "), "text").alias("descripcion_limpia"), F.col("n_chars").cast("double").alias("precio_num"),
        F.when(k % 2 == 0, "21:00").otherwise("tarde").alias("hora"), F.when(k % 3 == 0, TXT(LIT(" Sala "), "source")).otherwise("x").alias("lugar_corregido"))
    out = lookups.apply_enrichment(listing(spark, sf), enr)
    return out.select("id", F.md5("descripcion").alias("descripcion"), "lugar", "latitud", "precio_num", "hora", "enriquecido")


@query("apply_page_venue", f"""WITH {LISTING_SQL}, ven AS (SELECT url_venta, arg_min({s.strip('v')}, id) AS venue FROM (SELECT *, CASE WHEN id % 4 = 1 THEN 'Las Palmas' WHEN id % 4 = 2 THEN 'x' ELSE ' Sala ' || id END AS v FROM listing)
  WHERE length({s.strip('v')}) > 2 AND NOT {s.generic_place(s.strip('v'))} GROUP BY url_venta),
j AS (SELECT l.*, CASE WHEN {s.generic_place('lugar')} AND regexp_matches(lower(l.url_venta), 'tomaticket|tickety') THEN venue END AS np FROM listing l LEFT JOIN ven USING (url_venta))
SELECT id, coalesce(np, lugar) AS lugar, CASE WHEN np IS NULL THEN latitud END AS latitud FROM j""")
def _(spark, sf):
    df, k = listing(spark, sf), F.col("id")
    text = F.when(k % 4 == 1, "Las Palmas").when(k % 4 == 2, "x").otherwise(TXT(LIT(" Sala "), _s(k)))
    return lookups.apply_page_venue(df, df.select("url_venta", k.alias("ord"), text.alias("venue"))).select("id", "lugar", "latitud")


on_listing("drop_matched", f"SELECT id FROM listing WHERE NOT {s.garbage_row('nombre', 'lugar')}")(
    lambda df: lookups.drop_matched(df, lookups.garbage(df)).select("id"))
on_listing("attach_sources", "SELECT id, s AS merged_from_sources FROM listing JOIN (SELECT nombre, string_agg(DISTINCT organiza, ' + ' ORDER BY organiza) AS s FROM listing GROUP BY nombre) USING (nombre)")(
    lambda df: lookups.attach_sources(df.withColumn("cluster", F.col("nombre")), _merged(df)).select("id", "merged_from_sources"))


def _merged(df):
    from ..operators.resolve import merged_sources
    return merged_sources(df.withColumn("cluster", F.col("nombre")))


on_listing("merged_sources", "SELECT fecha_iso, string_agg(DISTINCT organiza, ' + ' ORDER BY organiza) AS merged_from_sources FROM listing WHERE fecha_iso IS NOT NULL GROUP BY fecha_iso")(
    lambda df: _by_day(df.filter("fecha_iso IS NOT NULL")))


def _by_day(df):
    from ..operators.resolve import merged_sources
    return merged_sources(df, "fecha_iso")


on_listing("related", f"""
SELECT a.id, place, related_id FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.fecha_iso, b.id) - 1 AS place
  FROM listing a JOIN (SELECT * FROM listing WHERE fecha_iso >= {AS_OF_SQL} QUALIFY row_number() OVER (PARTITION BY estilo ORDER BY fecha_iso, id) <= 5) b
  ON a.estilo = b.estilo AND a.id <> b.id) a WHERE place < 4""")(
    lambda df: lookups.related(df, as_of=today()).select("id", F.col("place").cast("long").alias("place"), "related_id"))
on_listing("next_date", f"SELECT estilo, min(fecha_iso) AS next_date FROM listing WHERE fecha_iso > {AS_OF_SQL} GROUP BY estilo")(
    lambda df: lookups.next_date(df, today()))

# ------------------------------------------------------------ aggregates
on_listing("facet_counts", f"SELECT coalesce(estilo, 'Otros') AS nombre, count(*) AS total FROM listing WHERE fecha_iso >= {AS_OF_SQL} GROUP BY 1")(
    lambda df: aggregates.facet_counts(df, today()))
on_listing("source_counts", "SELECT organiza, count(*) AS total FROM listing GROUP BY 1")(
    lambda df: aggregates.source_counts(*sets.split(df, F.col("fecha_iso").isNotNull())))
on_listing("completeness", """SELECT organiza, count(*) AS total, count(precio_num) AS con_precio, count(fecha_iso) AS con_fecha, count(nullif(hora, '')) AS con_hora,
  count(imagen_url) AS con_imagen, count(descripcion) AS con_descripcion FROM listing GROUP BY organiza""")(aggregates.completeness)
on_listing("null_ratio", f"SELECT organiza, count(*) AS total, avg(CASE WHEN {s.blank_hour('hora')} THEN 1 ELSE 0 END) AS hora_vacia, avg(CASE WHEN precio_num IS NULL THEN 1 ELSE 0 END) AS precio_vacio FROM listing GROUP BY organiza")(
    lambda df: aggregates.null_ratio(df, "organiza"))
on_listing("top_repeat", "SELECT nombre, count(*) AS total FROM listing GROUP BY nombre ORDER BY total DESC, nombre LIMIT 1")(aggregates.top_repeat)
query("duplicate_count", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")(
    lambda spark, sf: aggregates.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))
on_listing("bbox", "SELECT min(latitud) AS south, max(latitud) AS north, min(longitud) AS west, max(longitud) AS east, count(*) AS points FROM listing WHERE latitud IS NOT NULL")(aggregates.bbox)


@query("geo_counters", f"""WITH {LISTING_SQL}, {_COORDS}, m AS (SELECT *, {s.fold('lugar')} AS p FROM listing WHERE latitud IS NULL)
SELECT CASE WHEN p <> '' AND EXISTS (SELECT 1 FROM coords WHERE contains(p, key) OR contains(key, p)) THEN 'dictionary' ELSE 'fallback' END AS geo_method,
  count(*) AS filas, count(DISTINCT coalesce(lugar, '')) AS lugares FROM m GROUP BY 1""")
def _(spark, sf):
    return aggregates.geo_counters(lookups.lookup_coords(listing(spark, sf)))


on_listing("events_per_day", "SELECT fecha_iso, count(*) AS total, min(hora) AS first_hour FROM listing WHERE fecha_iso IS NOT NULL GROUP BY fecha_iso")(aggregates.events_per_day)

# ------------------------------------------------------------ survivorship
on_listing("keep_first", s.first_row("listing", "organiza, url_venta, fecha_iso, coalesce(hora, '')", s.SURVIVOR_ORDER, "id"))(
    lambda df: survivors.keep_first(df).select("id"))
on_listing("quality_score", f"SELECT id, CAST({s.quality_score()} AS INT) AS score FROM listing")(
    lambda df: df.select("id", survivors.quality_score().alias("score")))
on_listing("best_of_group", s.first_row("listing", "fecha_iso, lugar", f"{s.quality_score()} DESC, {s.SURVIVOR_ORDER}", "id"))(
    lambda df: survivors.best_of_group(df.withColumn("g", F.concat_ws("|", F.coalesce(_s(F.col("fecha_iso")), LIT("-")), F.coalesce("lugar", LIT("-")))), "g").select("id"))
on_listing("master_of_cluster", s.first_row("listing", "nombre", s.MASTER_ORDER, "nombre, id, organiza"))(
    lambda df: survivors.master_of_cluster(df, "nombre").select("nombre", "id", "organiza"))
on_listing("first_fill", f"""
SELECT m.id, d.descripcion AS descripcion, i.imagen_url AS imagen_url, n AS copies FROM
 ({s.first_row('listing', 'nombre', s.MASTER_ORDER, 'nombre, id')}) m
 JOIN (SELECT nombre, count(*) AS n FROM listing GROUP BY nombre) USING (nombre)
 JOIN ({s.first_row('listing', 'nombre', f'coalesce(length(descripcion), 0) DESC, {s.MASTER_ORDER}', 'nombre, descripcion')}) d USING (nombre)
 LEFT JOIN ({s.first_row('(SELECT * FROM listing WHERE imagen_url IS NOT NULL)', 'nombre', s.MASTER_ORDER, 'nombre, imagen_url')}) i USING (nombre)""")(
    lambda df: _merge(df.withColumn("cluster", F.col("nombre"))))


def _merge(df):
    from ..operators.resolve import merge_clusters
    return merge_clusters(df).drop("cluster")


query("first_seen", f"SELECT conv_id, turn, role FROM ({s.first_row('conversations', 'conv_id, role', 'turn')})")(
    lambda spark, sf: survivors.first_seen(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role"))
query("keep_first_lineitem", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")(
    lambda spark, sf: survivors.keep_best(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey"))
on_listing("top_n_per_day", """SELECT id, fecha_iso, CAST(place AS INT) AS place, total, greatest(total - 4, 0) AS rest FROM (
SELECT *, row_number() OVER (PARTITION BY fecha_iso ORDER BY coalesce(hora, ''), id) AS place, count(*) OVER (PARTITION BY fecha_iso) AS total FROM listing WHERE fecha_iso IS NOT NULL) WHERE place <= 4""")(
    lambda df: survivors.top_n_per_day(df, 4).select("id", "fecha_iso", "place", "total", "rest"))

# ------------------------------------------------------------ sets
def _no_data():
    raise OSError("source is down")


on_listing("union_sources", "SELECT organiza, count(*) AS total, 'broken' AS failed FROM (SELECT * FROM listing WHERE organiza = 'CICCA' UNION ALL SELECT * FROM listing WHERE organiza <> 'CICCA') GROUP BY organiza")(
    lambda df: _united(*sets.union_sources({
        "a": df.filter("organiza = 'CICCA'"), "b": lambda: df.filter("organiza <> 'CICCA'").drop("estilo"),
        "broken": _no_data})))


def _united(rows, failed):
    return aggregates.source_counts(rows).withColumn("failed", LIT(" + ".join(failed)))


on_listing("fallback_source", "SELECT id FROM listing WHERE organiza = 'CICCA'")(
    lambda df: sets.fallback_source(df.filter("organiza = 'nadie'").select("id"), df.filter("organiza = 'CICCA'").select("id")))
on_listing("fallback_unused", "SELECT id FROM listing WHERE organiza = 'Tickety'")(
    lambda df: sets.fallback_source(df.filter("organiza = 'Tickety'").select("id"), df.select("id")))
on_listing("split_confirmed", "SELECT fecha_iso IS NOT NULL AS confirmed, count(*) AS n FROM listing GROUP BY 1")(
    lambda df: (lambda a, b: a.withColumn("confirmed", LIT(True)).unionByName(b.withColumn("confirmed", LIT(False))))(
        *sets.split(df.select("fecha_iso"), F.col("fecha_iso").isNotNull())).groupBy("confirmed").agg(F.count("*").alias("n")))

# ------------------------------------------------------------ keys, upsert
_INGEST = f"sha256(organiza || '|' || {s.fold('nombre')} || '|' || coalesce(CAST(fecha_iso AS VARCHAR), 'None') || '|' || trim(coalesce(hora, '')) || '|' || {s.fold('lugar')})"
on_listing("hash_key", f"""SELECT id, {_INGEST} AS ingest,
  sha256(organiza || '|' || url_venta || '|' || coalesce(CAST(fecha_iso AS VARCHAR), 'None') || '|' || coalesce(hora, 'None')) AS publish FROM listing""")(
    lambda df: df.select("id", upsert.hash_key("ingest").alias("ingest"), upsert.hash_key("publish").alias("publish")))

_TAKEN = ["nombre", "fecha_raw", "fecha_iso", "estilo", "imagen_url", "descripcion", "latitud", "longitud", "hora", "lugar", "url_venta"]
_SIDES = f"""keyed AS (SELECT *, {_INGEST} AS hash_id FROM listing),
tgt AS (SELECT DISTINCT ON (hash_id) *, 10 AS source_priority, 'g' || id AS event_group_id FROM keyed WHERE fecha_iso < DATE '2029-01-01' ORDER BY hash_id, id),
src AS (SELECT *, precio_num + 1 AS new_price, CASE WHEN id % 2 = 0 THEN 'n' || id ELSE '' END AS gid FROM keyed WHERE fecha_iso >= DATE '2026-01-01'),
batch AS (SELECT hash_id, arg_max_null(new_price, id) AS price, arg_max(gid, id) FILTER (WHERE gid <> '') AS gid, arg_min(organiza, id) AS organiza,
  {', '.join(f'arg_max_null({c}, id) AS {c}' for c in _TAKEN)} FROM src GROUP BY hash_id)"""


def _upsert_sides(df):
    keyed = conform(df.withColumn("hash_id", upsert.hash_key("ingest")), LISTING_SCHEMA)
    target = survivors.keep_best(keyed.filter(F.col("fecha_iso") < LIT("2029-01-01").cast("date")), ["hash_id"], [F.col("id")])
    target = target.withColumns({"source_priority": LIT(10), "event_group_id": TXT(LIT("g"), _s(F.col("id"))), "enriquecido": LIT(True)})
    batch = keyed.filter(F.col("fecha_iso") >= LIT("2026-01-01").cast("date")).withColumns({
        "precio_num": F.col("precio_num") + 1, "event_group_id": F.when(F.col("id") % 2 == 0, TXT(LIT("n"), _s(F.col("id")))).otherwise("")})
    return target, batch


on_listing("upsert", f"""SELECT coalesce(t.hash_id, b.hash_id) AS hash_id, CASE WHEN b.hash_id IS NOT NULL THEN price ELSE precio_num END AS precio_num,
  {', '.join(f"CASE WHEN b.hash_id IS NOT NULL THEN b.{c} ELSE t.{c} END AS {c}" for c in _TAKEN)}, CASE WHEN t.hash_id IS NOT NULL THEN t.organiza ELSE b.organiza END AS organiza,
  coalesce(b.gid, t.event_group_id) AS event_group_id,
  CASE WHEN t.hash_id IS NOT NULL THEN 10 ELSE 50 END AS source_priority, b.hash_id IS NULL AS enriquecido, coalesce(t.estado, 'upcoming') AS estado
FROM tgt t FULL JOIN batch b ON t.hash_id = b.hash_id""", _SIDES)(
    lambda df: upsert.upsert(*_upsert_sides(df), now=LIT("2027-01-01").cast("timestamp"), order="id").select(
        "hash_id", "precio_num", *_TAKEN, "organiza", "event_group_id", "source_priority", "enriquecido", "estado"))
on_listing("upsert_counters", "SELECT count(*) FILTER (WHERE t.hash_id IS NULL) AS insertados, count(t.hash_id) AS actualizados FROM batch b LEFT JOIN tgt t USING (hash_id)", _SIDES)(
    lambda df: upsert.upsert_counters(*_upsert_sides(df)))


@query("upsert_stream", f"""WITH {LISTING_SQL} SELECT {_INGEST} AS hash_id, count(*) AS copias, arg_max_null(precio_num, id) AS precio_num FROM listing GROUP BY 1""")
def _(spark, sf):
    # Orders arrive in three parts; the stream is stopped and goes on from its progress each time,
    # so later batches meet keys that are in the table already.
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = table(spark, sf, "orders")
    top = raw.agg(F.max("o_orderkey")).first()[0]
    rows = None
    for part in range(3):
        raw.filter(F.expr(f"o_orderkey * 3 div {top + 1}") == part).write.mode("append").parquet(f"{folder}/in")
        if rows is None:
            rows = listing(spark, sf, order_stream(spark, f"{folder}/in")).withColumn("last_seen_at", F.timestamp_seconds("id"))
        upsert_stream(rows, f"{folder}/table", f"{folder}/progress", digits=1).awaitTermination()
    merged = read_target(spark, f"{folder}/table").select("hash_id", "precio_num")
    copies = listing(spark, sf).groupBy(upsert.hash_key("ingest").alias("hash_id")).agg(F.count("*").alias("copias"))
    return merged.join(copies, "hash_id", "full_outer")


@query("upsert_months", f"""WITH {LISTING_SQL} SELECT {_INGEST} AS hash_id, coalesce(strftime(fecha_iso, '%Y-%m'), 'none') AS month,
  arg_max_null(precio_num, id) AS precio_num, any_value(organiza) AS organiza, 'upcoming' AS estado FROM listing GROUP BY 1, 2""")
def _(spark, sf):
    # Two parts of the orders come in as a stream; the second one opens the months it has rows of.
    unique = uuid.uuid4().hex
    folder, name = f"{checkpoint_dir(spark)}/months-{unique}", f"months_{unique}"
    raw = table(spark, sf, "orders")
    top = raw.agg(F.max("o_orderkey")).first()[0]
    bucketed.create_table(spark, name, f"{folder}/table", buckets=8)
    for part in range(2):
        raw.filter(F.expr(f"o_orderkey * 2 div {top + 1}") == part).write.mode("append").parquet(f"{folder}/in")
        rows = listing(spark, sf, order_stream(spark, f"{folder}/in")).withColumn("last_seen_at", F.timestamp_seconds("id"))
        bucketed.upsert_stream(rows, name, f"{folder}/progress", buckets=8).awaitTermination()
    return spark.table(name).select("hash_id", "month", "precio_num", "organiza", "estado")


@query("missed_runs", f"""WITH {ORDERS_SQL}, seen AS (SELECT DISTINCT o_custkey AS k, year(day) * 12 + month(day) AS run FROM ord),
next AS (SELECT k, run, lead(run) OVER (PARTITION BY k ORDER BY run) AS after, (SELECT max(run) FROM seen) AS latest FROM seen)
SELECT CAST(k AS VARCHAR) AS key, CAST(run AS BIGINT) AS last_run, CAST(run + 6 AS BIGINT) AS missed_run FROM next
WHERE coalesce(after - run > 6, run + 6 <= latest)""")
def _(spark, sf):
    # Customers as keys, months as runs; the months come in as two batches of one stream.
    folder = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    seen = settle(orders(spark, sf).select(F.col("o_custkey").alias("key"), (F.year("day") * 12 + F.month("day")).cast("long").alias("run")))
    middle = seen.agg(F.percentile_approx("run", 0.5)).first()[0]
    for part in (F.col("run") <= middle, F.col("run") > middle):
        seen.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = missed_runs(spark.readStream.schema(seen.schema).parquet(f"{folder}/in"), 6).writeStream.format("parquet")
        stream.option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


on_listing("mark_past", f"SELECT id, CASE WHEN fecha_iso < {AS_OF_SQL} THEN 'past' ELSE estado END AS estado FROM listing")(
    lambda df: upsert.mark_past(df, today()).select("id", "estado"))
on_listing("replace_future", f"SELECT id, fecha_iso FROM listing WHERE fecha_iso < {AS_OF_SQL} OR fecha_iso IS NULL UNION ALL SELECT id, CAST(fecha_iso + 1 AS DATE) FROM listing WHERE fecha_iso >= {AS_OF_SQL}")(
    lambda df: upsert.replace_future(df.select("id", "fecha_iso"), df.filter(F.col("fecha_iso") >= today()).select("id", F.date_add("fecha_iso", 1).alias("fecha_iso")), today()))
on_listing("backfill", f"SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'ya' END, {_INGEST}) AS hash_id, coalesce(latitud, 28.1235::DOUBLE) AS latitud, coalesce(hora, '') AS hora FROM listing")(
    lambda df: backfill(df.withColumn("hash_id", F.when(F.col("id") % 2 == 0, "ya")), hash_id=upsert.hash_key("ingest"), latitud=LIT(28.1235), hora=LIT("")).select("id", "hash_id", "latitud", "hora"))
on_listing("conform", "SELECT id, nombre, CAST(fecha_iso AS DATE) AS fecha_iso, TRY_CAST(hora AS DOUBLE) AS precio_num, 50 AS source_priority, 'Sin especificar' AS lugar FROM listing")(
    lambda df: conform(df.withColumn("precio_num", F.col("hora")).drop("lugar").withColumn("precio", LIT("viejo"))).select(
        "id", "nombre", "fecha_iso", "precio_num", "source_priority", "lugar"))


@query("mark_stale", f"WITH {ORDERS_SQL} SELECT o_orderkey AS id, date_diff('day', day, {AS_OF_SQL}) > 30 AS stale FROM ord")
def _(spark, sf):
    rows = orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.col("day").alias("last_seen_at"))
    return upsert.mark_stale(rows, today(), 30).select("id", "stale")


# ------------------------------------------------------------ quality
def gate_values(rows: str) -> str:
    """Common table ``m``: the gate values of ``rows``."""
    return f"""m AS (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE fecha_iso IS NOT NULL AND {s.blank_hour('hora')}) / count(fecha_iso) AS blank_hour,
  100.0::DOUBLE * count(*) FILTER (WHERE {s.generic_title('nombre')}) / count(*) AS generic_titles,
  100.0::DOUBLE * count(*) FILTER (WHERE fecha_iso IS NULL) / count(*) AS no_date,
  100.0::DOUBLE * count(*) FILTER (WHERE {s.generic_place('lugar')}) / count(*) AS generic_places,
  (SELECT max(n)::DOUBLE FROM (SELECT count(*) AS n FROM {rows} GROUP BY nombre HAVING nombre IS NOT NULL)) AS repeated_title FROM {rows})"""


GATE_ROWS = """SELECT 'blank_hour' AS gate, blank_hour AS value, 25.0::DOUBLE AS threshold, CASE WHEN blank_hour > 25 THEN 'alert' ELSE 'ok' END AS level FROM m
UNION ALL SELECT 'generic_titles', generic_titles, 5.0, CASE WHEN generic_titles > 5 THEN 'abort' ELSE 'ok' END FROM m
UNION ALL SELECT 'no_date', no_date, 40.0, CASE WHEN no_date > 40 THEN 'error' ELSE 'ok' END FROM m
UNION ALL SELECT 'generic_places', generic_places, 60.0, CASE WHEN generic_places > 60 THEN 'alert' ELSE 'ok' END FROM m
UNION ALL SELECT 'repeated_title', repeated_title, 5.0, CASE WHEN repeated_title > 15 THEN 'error' WHEN repeated_title > 5 THEN 'alert' ELSE 'ok' END FROM m"""
on_listing("table_gates", GATE_ROWS, gate_values("listing"))(quality.table_gates)
on_listing("drop_gate", f"""SELECT 'drop_ratio' AS gate, v AS value, 60.0::DOUBLE AS threshold, CASE WHEN v >= 60 THEN 'alert' ELSE 'ok' END AS level FROM (
SELECT 100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE fecha_iso >= {AS_OF_SQL})) / count(*) AS v FROM listing)""")(
    lambda df: quality.drop_gate(df, df.filter(F.col("fecha_iso") >= today())))
_MISSING = "missing AS (SELECT x FROM " + _values([(x,) for x in v.EXPECTED_SOURCES], "x") + " WHERE x NOT IN (SELECT DISTINCT organiza FROM listing))"
on_listing("source_gate", f"""SELECT 'failed_sources' AS gate, 100.0::DOUBLE * count(*) / {len(v.EXPECTED_SOURCES)} AS value, 30.0::DOUBLE AS threshold,
  CASE WHEN 100.0::DOUBLE * count(*) / {len(v.EXPECTED_SOURCES)} > 30 THEN 'alert' ELSE 'ok' END AS level, string_agg(x, ' + ' ORDER BY x) AS missing FROM missing""", _MISSING)(quality.source_gate)

_QA = f"""conf AS (SELECT * FROM listing WHERE fecha_iso IS NOT NULL), q AS (SELECT
  (SELECT count(*) FROM listing) AS total_eventos, count(*) AS confirmados, (SELECT count(*) FROM listing WHERE fecha_iso IS NULL) AS borradores_n,
  sum((lugar IS NULL)::INT + (imagen_url IS NULL)::INT + (estilo IS NULL)::INT + (descripcion IS NULL)::INT + (precio_num IS NULL)::INT + (hora IS NULL)::INT)::BIGINT AS nan_en_export,
  0.0::DOUBLE AS missing_fecha, count(*) FILTER (WHERE hora IS NULL)::DOUBLE / count(*) AS missing_hora,
  count(*) FILTER (WHERE precio_num IS NULL)::DOUBLE / count(*) AS missing_precio, count(*) FILTER (WHERE imagen_url IS NULL)::DOUBLE / count(*) AS missing_img,
  (SELECT sum(n - 1)::DOUBLE FROM (SELECT count(*) AS n FROM conf GROUP BY organiza, url_venta, fecha_iso, hora)) AS dupes_same_source,
  (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM conf GROUP BY nombre, fecha_iso))::DOUBLE / count(*) AS dupes_cross,
  count(*) FILTER (WHERE length(nombre) < 3 OR lower(nombre) IN ('ext', 'none'))::DOUBLE AS titulos_basura,
  count(*) FILTER (WHERE {s.any_of("lower(coalesce(lugar, ''))", v.PLACE_LEAK_PHRASES)})::DOUBLE AS lugares_contaminados,
  count(*) FILTER (WHERE precio_num > 500)::DOUBLE AS precios_imposibles, count(*) FILTER (WHERE hora IN ('22:33', '00:00', '12:04', '10:31'))::DOUBLE AS horas_sentinel,
  (SELECT count(*) FROM listing WHERE fecha_iso IS NULL)::DOUBLE / (SELECT count(*) FROM listing) AS borradores FROM conf),
f AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {m} > {limit} THEN '{m}' END" for m, limit in quality.QA_LIMITS.items())}], lambda x: x IS NOT NULL), ' + ') AS failures FROM q)"""
on_listing("qa_report", "SELECT *, failures = '' AS passed FROM f", _QA)(
    lambda df: (lambda a, b: quality.qa_report(a.select("nombre", "lugar", "fecha_iso", "hora", "precio_num", "estilo", "organiza", "url_venta", "imagen_url", "descripcion"), b))(
        *sets.split(df, F.col("fecha_iso").isNotNull())))
on_listing("run_metrics", """SELECT 12.5::DOUBLE AS elapsed_seconds, count(*) AS total_eventos, count(fecha_iso) AS totales_confirmados, count(*) - count(fecha_iso) AS totales_borradores,
  round(100.0::DOUBLE * count(*) FILTER (WHERE fecha_iso IS NOT NULL AND coalesce(hora, '') = '') / count(fecha_iso), 2) AS pct_hora_vacia_en_conf,
  round(100.0::DOUBLE * count(*) FILTER (WHERE fecha_iso IS NOT NULL AND precio_num IS NULL) / count(fecha_iso), 2) AS pct_precio_vacio_en_conf,
  count(DISTINCT organiza) AS fuentes FROM listing""")(
    lambda df: quality.run_metrics(*sets.split(df, F.col("fecha_iso").isNotNull()), timestamp=LIT("2027-01-01").cast("timestamp"), elapsed=12.5).select(
        "elapsed_seconds", "total_eventos", "totales_confirmados", "totales_borradores", "pct_hora_vacia_en_conf", "pct_precio_vacio_en_conf",
        F.size("distribucion_fuentes").cast("long").alias("fuentes")))

_RUNS = f"""prev AS (SELECT organiza, count(*) AS total FROM listing WHERE fecha_iso < {AS_OF_SQL} GROUP BY 1),
cur AS (SELECT organiza, count(*) AS total FROM listing WHERE fecha_iso >= {AS_OF_SQL} AND organiza <> 'CICCA' AND (organiza <> 'Tickety' OR hora = '00:00') GROUP BY 1),
cmp AS (SELECT organiza, coalesce(prev.total, 0) AS prev, coalesce(cur.total, 0) AS cur FROM prev FULL JOIN cur USING (organiza))"""


def _runs(df):
    past = aggregates.source_counts(df.filter(F.col("fecha_iso") < today()))
    now = df.filter((F.col("fecha_iso") >= today()) & (F.col("organiza") != "CICCA") & ((F.col("organiza") != "Tickety") | (F.col("hora") == "00:00")))
    return quality.compare_runs(aggregates.source_counts(now), past)


on_listing("compare_runs", "SELECT * FROM cmp", _RUNS)(_runs)
on_listing("regressions", "SELECT *, CASE WHEN cur = 0 AND prev > 5 THEN 'critical' ELSE 'warning' END AS level FROM cmp WHERE (cur = 0 AND prev > 5) OR cur < prev * 0.4", _RUNS)(
    lambda df: quality.source_regressions(_runs(df)))


def _kpi(df):
    return quality.run_metrics(*sets.split(df, F.col("fecha_iso").isNotNull()), timestamp=LIT("2027-01-01").cast("timestamp"), elapsed=0.0)


on_listing("total_regressions", """SELECT c.n - p.n AS diff_total, c.h - p.h AS diff_hora, c.n < p.n AS volume_alert, c.h - p.h > 5 AS hour_alert FROM
 (SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(hora, '') = '' AND fecha_iso IS NOT NULL) / count(fecha_iso), 2) AS h FROM listing WHERE estilo IS NULL) c,
 (SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(hora, '') = '' AND fecha_iso IS NOT NULL) / count(fecha_iso), 2) AS h FROM listing) p""")(
    lambda df: quality.total_regressions(_kpi(df.filter("estilo IS NULL")), _kpi(df)))

on_listing("audit", f"SELECT id, coalesce(venue, lugar) AS lugar, CASE WHEN precio_num > 300 THEN NULL ELSE precio_num END AS precio_num FROM found WHERE NOT {s.garbage_row('nombre', 'lugar')}", _PATTERNS + ", " + _DETECTED)(
    lambda df: quality.audit(df).select("id", "lugar", "precio_num"))
def sanitized(rows: str) -> str:
    """Common tables that end in ``san``; ``san1`` is the stage at which titles are gated."""
    return f"""san1 AS (SELECT * REPLACE (CASE WHEN NOT {s.junk_title('nombre')} THEN fecha_iso END AS fecha_iso, {s.strip_place_suffix('nombre')} AS nombre,
  {s.canonical_venue('lugar')} AS lugar, CASE WHEN precio_num > 300 THEN NULL ELSE precio_num END AS precio_num) FROM {rows} WHERE NOT {s.social('nombre', 'url_venta')}),
san2 AS (SELECT * REPLACE (CASE WHEN NOT {s.generic_title('nombre')} THEN fecha_iso END AS fecha_iso) FROM san1),
san AS (SELECT * FROM san2 WHERE fecha_iso IS NULL OR fecha_iso >= {AS_OF_SQL})"""


SANITIZED = sanitized("listing")
# The stages before: audited, classified and located rows.
PREPARED = f"""{_PATTERNS}, {_DETECTED}, {_COORDS},
audited AS (SELECT * EXCLUDE (venue) REPLACE (coalesce(venue, lugar) AS lugar, CASE WHEN venue IS NULL THEN latitud END AS latitud,
  CASE WHEN venue IS NULL THEN longitud END AS longitud, CASE WHEN precio_num > 300 THEN NULL ELSE precio_num END AS precio_num)
  FROM found WHERE NOT {s.garbage_row('nombre', 'lugar')}),
classified AS (SELECT * EXCLUDE (b, t, d) REPLACE (CASE WHEN b.score > 0 THEN b.name ELSE estilo END AS estilo)
  FROM (SELECT *, {_BEST} AS b FROM (SELECT *, nombre AS t, descripcion AS d FROM audited))),
spots AS (SELECT p, arg_min(lat, (CASE WHEN key = p THEN 0 ELSE 1000 END) + ord) AS lat, arg_min(lon, (CASE WHEN key = p THEN 0 ELSE 1000 END) + ord) AS lon
  FROM (SELECT DISTINCT {s.fold('lugar')} AS p FROM classified) JOIN coords ON contains(p, key) OR contains(key, p) WHERE p <> '' GROUP BY p),
located AS (SELECT c.* REPLACE (CASE WHEN latitud IS NULL OR longitud IS NULL THEN coalesce(lat, 28.1235::DOUBLE) ELSE latitud END AS latitud,
  CASE WHEN latitud IS NULL OR longitud IS NULL THEN coalesce(lon, (-15.4363)::DOUBLE) ELSE longitud END AS longitud)
  FROM classified c LEFT JOIN spots ON p = {s.fold('lugar')})"""
on_listing("sanitize", "SELECT id, nombre, lugar, fecha_iso, precio_num FROM san", SANITIZED)(
    lambda df: quality.sanitize(df, today()).select("id", "nombre", "lugar", "fecha_iso", "precio_num"))


def _watched(df):
    """The gates measured on the way of the pass that writes the sanitized rows."""
    metrics = Observation("watched")
    settle(quality.demote_and_cut(quality.watch_gates(quality.canonical_rows(df), metrics), today()))
    return quality.watched_gates(df.sparkSession, metrics)


_STAGED = f"""SELECT 'blank_hour' AS gate, 100.0::DOUBLE * count(*) FILTER (WHERE {s.blank_hour('hora')}) / count(*) AS value, 25.0::DOUBLE AS threshold,
  CASE WHEN 100.0::DOUBLE * count(*) FILTER (WHERE {s.blank_hour('hora')}) / count(*) > 25 THEN 'alert' ELSE 'ok' END AS level FROM san1 WHERE fecha_iso IS NOT NULL
UNION ALL SELECT 'generic_titles', 100.0::DOUBLE * count(*) FILTER (WHERE {s.generic_title('nombre')}) / count(*), 5.0::DOUBLE,
  CASE WHEN 100.0::DOUBLE * count(*) FILTER (WHERE {s.generic_title('nombre')}) / count(*) > 5 THEN 'abort' ELSE 'ok' END FROM san1"""
on_listing("staged_gates", _STAGED, SANITIZED)(quality.staged_gates)
on_listing("watched_gates", _STAGED, SANITIZED)(_watched)
on_listing("audit_counters", f"""SELECT count(*) AS total, count(*) FILTER (WHERE bad) AS basura_eliminada,
  count(*) FILTER (WHERE NOT bad AND venue IS NOT NULL AND venue IS DISTINCT FROM lugar) AS lugares_corregidos, 0::BIGINT AS deep_scrape_hits,
  count(*) FILTER (WHERE NOT bad AND precio_num > 300) AS precios_corregidos
FROM (SELECT *, {s.garbage_row('nombre', 'lugar')} AS bad FROM found)""", _PATTERNS + ", " + _DETECTED)(quality.audit_counters)
