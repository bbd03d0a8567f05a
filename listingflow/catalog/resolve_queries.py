"""Entity resolution queries.

The SQL scores pairs with the bit-parallel longest common subsequence on 128-bit numbers and
runs the greedy leader pass as a recursive query, one title of every block a step; sessions are
a second one, one row of every cluster a step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import title_similarity
from ..functions.text import canonical_title, name_from_slug
from ..operators import quality, resolve, survivors
from ..operators.aggregates import clean_counters
from ..operators.lookups import attach_sources
from ..plans import refine
from . import sqltext as s
from .registry import on_listing, query
from .relational_queries import GATE_ROWS, PREPARED, SANITIZED, gate_values, sanitized
from .tables import AS_OF, LISTING_SQL, listing, table


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of under 120 letters."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    hits = f"""list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(length({a})),
      lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)"""
    last = f"list_reduce(list_concat([{full}], {hits}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    bits = f"list_sum(list_transform(range(length({a})), lambda i: (({last} >> i::INT) & 1)::INT))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - {bits} END)"


def _scores(pairs: str, use_ratio: bool = True) -> str:
    """Common tables that end in ``scored``: the rows of ``pairs`` (with texts a and b) and their score."""
    words = lambda x: f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"
    score = "greatest(score, 200.0::DOUBLE * full_lcs / nullif(length(a) + length(b), 0))" if use_ratio else "score"
    return f"""tok AS (SELECT *, {words('a')} AS wa, {words('b')} AS wb FROM {pairs}),
sets AS (SELECT *, list_filter(wa, lambda w: list_contains(wb, w)) AS both_words FROM tok),
rests AS (SELECT *, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS ra,
  array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS rb,
  length(array_to_string(both_words, ' ')) AS sh, CASE WHEN len(both_words) > 0 THEN length(array_to_string(both_words, ' ')) + 1 ELSE 0 END AS ld FROM sets),
counted AS (SELECT *, {_lcs('ra', 'rb')} AS rest_lcs, {_lcs('a', 'b') if use_ratio else '0'} AS full_lcs FROM rests),
based AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE WHEN len(both_words) > 0 AND (ra = '' OR rb = '') THEN 100.0::DOUBLE
  ELSE greatest(200.0::DOUBLE * (ld + rest_lcs) / (2 * ld + length(ra) + length(rb)),
    CASE WHEN len(both_words) > 0 THEN 200.0::DOUBLE * sh / (sh + ld + least(length(ra), length(rb))) ELSE 0 END) END AS score FROM counted),
scored AS (SELECT * REPLACE (CASE WHEN score < 100 THEN {score} ELSE score END AS score) FROM based)"""


def _leaders(
    rows: str, where: str, block: str = "CAST(fecha_iso AS VARCHAR)", title: str = s.canonical_title("nombre"),
    order: str = s.SURVIVOR_ORDER, least: int = 82, use_ratio: bool = True,
) -> str:
    """Common tables that end in ``led`` (block, title, leader): the greedy pass over the titles of each block."""
    return f"""keyed AS (SELECT {block} AS block, {title} AS title,
  row_number() OVER (ORDER BY {order}) AS place FROM {rows} WHERE {where}),
firsts AS (SELECT block, title, min(place) AS place FROM keyed GROUP BY ALL),
ranked AS (SELECT block, title, row_number() OVER (PARTITION BY block ORDER BY place) AS k FROM firsts),
duo AS (SELECT x.block, x.k AS i, y.k AS j, y.title AS a, x.title AS b FROM ranked x JOIN ranked y ON x.block = y.block AND x.k < y.k),
{_scores('duo', use_ratio)},
near AS (SELECT block, j, list(i ORDER BY i) AS earlier FROM scored WHERE score >= {least} GROUP BY ALL),
steps AS (SELECT ranked.block, k, coalesce(earlier, []) AS earlier FROM ranked LEFT JOIN near ON ranked.block = near.block AND k = j),
walk AS (SELECT block, 1::BIGINT AS k, [1::BIGINT] AS heads, 1::BIGINT AS head FROM steps WHERE k = 1
  UNION ALL
  SELECT w.block, t.k, CASE WHEN len(hit) = 0 THEN list_append(heads, t.k) ELSE heads END, CASE WHEN len(hit) = 0 THEN t.k ELSE hit[1] END
  FROM walk w JOIN steps t ON w.block = t.block AND t.k = w.k + 1, LATERAL (SELECT list_filter(t.earlier, lambda e: list_contains(w.heads, e)) AS hit)),
led AS (SELECT x.block, x.title, h.title AS leader FROM walk JOIN ranked x USING (block, k) JOIN ranked h ON h.block = walk.block AND h.k = walk.head)"""


_BLOCK = f"concat_ws(chr(1), coalesce(CAST(fecha_iso AS VARCHAR), '-'), coalesce(hora, ''), {s.fold('lugar')})"
_TABLE_CLUSTERS = _leaders("listing", f"NOT {s.generic_title('nombre')}", _BLOCK, "lower(nombre)", "id", 90, False) + f""", clustered AS (
  SELECT listing.*, led.block || chr(1) || leader AS cluster FROM listing JOIN led ON led.block = {_BLOCK} AND led.title = lower(nombre)
  WHERE NOT {s.generic_title('nombre')})"""
_CLEAN = f""", placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {s.MASTER_ORDER}) AS r FROM clustered),
fused AS (SELECT cluster, first(length(descripcion) ORDER BY coalesce(length(descripcion), 0) DESC, r) AS size,
  coalesce(first(imagen_url ORDER BY r) FILTER (coalesce(imagen_url, '') <> ''), first(imagen_url ORDER BY r)) AS imagen_url FROM placed GROUP BY cluster)"""


def _clusters(sanitized_rows: str) -> str:
    """Common tables that end in ``clustered``: rows without same-source copies and their cluster."""
    keys = "organiza, url_venta, fecha_iso, coalesce(hora, '')"
    return f"""{sanitized_rows}, one AS ({s.first_row('san', keys, s.SURVIVOR_ORDER)}),
{_leaders('one', 'fecha_iso IS NOT NULL')},
clustered AS (SELECT one.*, CASE WHEN fecha_iso IS NULL THEN 'draft|' || id ELSE block || '|' || leader END AS cluster
  FROM one LEFT JOIN led ON block = CAST(fecha_iso AS VARCHAR) AND title = {s.canonical_title('nombre')})"""


def _sessions(rows: str) -> str:
    """Common tables that end in ``sub_of`` (cluster, id, sub): hour groups of ``rows`` of ``clustered``."""
    minute = "coalesce(TRY_CAST(string_split(hora, ':')[1] AS INT) * 60 + TRY_CAST(string_split(hora, ':')[2] AS INT), -999)"
    near = "t.m = -999 OR list_contains(g, -999) OR len(list_filter(g, lambda x: abs(x - t.m) < 120)) > 0"
    return f"""timed AS (SELECT cluster, id, CASE WHEN {s.generic_place('lugar')} THEN -999 ELSE {minute} END AS m,
  row_number() OVER (PARTITION BY cluster ORDER BY {s.SURVIVOR_ORDER}) AS k FROM {rows}),
heard AS (SELECT cluster, id, k, [[m]] AS groups, 1::BIGINT AS hit FROM timed WHERE k = 1
  UNION ALL
  SELECT t.cluster, t.id, t.k, CASE WHEN f.at = 0 THEN list_append(h.groups, [t.m])
    ELSE list_transform(h.groups, lambda g, i: CASE WHEN i = f.at THEN list_append(g, t.m) ELSE g END) END,
    CASE WHEN f.at = 0 THEN len(h.groups) + 1 ELSE f.at END
  FROM heard h JOIN timed t ON t.cluster = h.cluster AND t.k = h.k + 1,
    LATERAL (SELECT coalesce(list_position(list_transform(h.groups, lambda g: {near}), true), 0)::BIGINT AS at) f),
sub_of AS (SELECT cluster, id, (hit - 1)::INT AS sub FROM heard)"""


_VENUE = "lower(trim(coalesce(lugar, '')))"
_KEPT = f"""same AS (SELECT cluster FROM clustered WHERE {_VENUE} <> '' AND NOT {s.generic_place(_VENUE)} GROUP BY cluster
  HAVING count(*) >= 2 AND count(DISTINCT {_VENUE}) = 1),
apart AS (SELECT * FROM clustered WHERE cluster NOT IN (SELECT cluster FROM same)),
{_sessions('apart')},
placed AS (SELECT c.*, coalesce(sub, 0) AS sub FROM clustered c LEFT JOIN sub_of USING (cluster, id)),
sources AS (SELECT cluster, string_agg(DISTINCT organiza, ' + ' ORDER BY organiza) AS merged_from_sources FROM clustered GROUP BY cluster),
kept AS (SELECT placed.*, merged_from_sources FROM ({s.first_row('placed', 'cluster, sub', f"{s.quality_score()} DESC, {s.SURVIVOR_ORDER}")}) placed JOIN sources USING (cluster))"""


def _ready(df):
    """Rows as they enter the resolution: sanitised and free of same-source copies."""
    return survivors.keep_first(quality.sanitize(df, F.lit(AS_OF)))


on_listing("title_similarity", "SELECT id, score FROM scored", f"""pair AS (SELECT id, {s.canonical_title('nombre')} AS a,
  {s.canonical_title('p_name')} AS b FROM listing JOIN orders ON o_orderkey = id JOIN part ON p_partkey = o_custkey), {_scores('pair')}""")(
    lambda df: df.select("id", title_similarity(
        canonical_title(F.col("nombre")), canonical_title(name_from_slug(F.regexp_replace("url_venta", r"/\d+(\?.*)?$", "")))).alias("score")))
on_listing("similar_pairs", "SELECT block, title, leader FROM led WHERE title <> leader", _leaders("listing", "fecha_iso IS NOT NULL"))(lambda df: resolve.similar_pairs(
    df.filter("fecha_iso IS NOT NULL"), block=F.col("fecha_iso").cast("string"),
    title=canonical_title(F.col("nombre")), rank=survivors.survivor_rank()))
on_listing("fuzzy_cluster", "SELECT id, fecha_iso, cluster FROM clustered", _clusters(SANITIZED))(
    lambda df: resolve.fuzzy_cluster(_ready(df)).select("id", "fecha_iso", "cluster"))
on_listing("hour_subgroups", "SELECT cluster, id, sub FROM sub_of", f"{_clusters(SANITIZED)}, {_sessions('clustered')}")(
    lambda df: _subgroups(resolve.fuzzy_cluster(_ready(df))))
on_listing("session_survivors", "SELECT id, cluster, merged_from_sources FROM kept", f"{_clusters(SANITIZED)}, {_KEPT}")(lambda df: refine.resolve(quality.sanitize(df, F.lit(AS_OF))).select("id", "cluster", "merged_from_sources"))
on_listing("table_clusters", "SELECT id, cluster FROM clustered", _TABLE_CLUSTERS)(lambda df: resolve.table_clusters(df).select("id", "cluster"))
on_listing("clean_table", f"""SELECT placed.id, nombre, fused.size, fused.imagen_url FROM placed JOIN fused USING (cluster) WHERE r = 1
UNION ALL SELECT id, nombre, length(descripcion), imagen_url FROM listing WHERE {s.generic_title('nombre')}""", _TABLE_CLUSTERS + _CLEAN)(lambda df: resolve.clean_table(df).select("id", "nombre", F.length("descripcion").alias("size"), "imagen_url"))
on_listing("clean_counters", """SELECT (SELECT count(*) FROM (SELECT cluster FROM placed GROUP BY cluster HAVING count(*) > 1)) AS grupos_con_copias,
  (SELECT count(*) - count(DISTINCT cluster) FROM placed) AS duplicados_eliminados,
  count(*) FILTER (WHERE size IS DISTINCT FROM length(descripcion) OR fused.imagen_url IS DISTINCT FROM placed.imagen_url) AS maestros_enriquecidos
FROM placed JOIN fused USING (cluster) WHERE r = 1""", _TABLE_CLUSTERS + _CLEAN)(lambda df: clean_counters(resolve.table_masters(df)))
on_listing("refine", """SELECT id, nombre, lugar, fecha_iso, hora, precio_num, estilo, organiza, latitud, longitud, merged_from_sources
FROM kept""", f"{PREPARED}, {_clusters(sanitized('located'))}, {_KEPT}")(lambda df: refine.refine(df, AS_OF).select(
    "id", "nombre", "lugar", "fecha_iso", "hora", "precio_num", "estilo", "organiza", "latitud", "longitud", "merged_from_sources"))


def _subgroups(clustered):
    rows = clustered.select("cluster", survivors.survivor_rank().alias("rank"), resolve.session_minute().alias("minute"))
    return resolve.hour_subgroups(rows).select("cluster", F.col("rank.id").alias("id"), "sub")


on_listing("dedupe_same_source", s.first_row("san", "organiza, url_venta, fecha_iso, coalesce(hora, '')", s.SURVIVOR_ORDER, "id, nombre"), SANITIZED)(
    lambda df: _ready(df).select("id", "nombre"))
_PLACE = "lower(trim(coalesce(lugar, '')))"
on_listing("same_venue_merge", f"""SELECT nombre AS cluster FROM listing WHERE {_PLACE} <> '' AND NOT {s.generic_place(_PLACE)}
GROUP BY nombre HAVING count(*) >= 2 AND count(DISTINCT {_PLACE}) = 1""")(
    lambda df: resolve.same_venue_clusters(df.withColumn("cluster", F.col("nombre"))))
on_listing("occurrence_groups", f"""SELECT id, sha256({s.occurrence_key('nombre', 'fecha_iso', 'lugar')}) AS event_group_id FROM listing""")(
    lambda df: resolve.occurrence_groups(df).select("id", "event_group_id"))
on_listing("group_ids", f"""SELECT id, 'group_' || dense_rank() OVER (ORDER BY first_id) AS event_group_id FROM (
SELECT id, min(id) OVER (PARTITION BY {s.occurrence_key('nombre', 'fecha_iso', 'lugar')}) AS first_id FROM listing)""")(
    lambda df: resolve.occurrence_groups(df, numbered=True).select("id", "event_group_id"))
on_listing("survivors", "SELECT id, merged_from_sources FROM best JOIN told ON best.fecha_iso IS NOT DISTINCT FROM told.fecha_iso AND best.nombre = told.nombre", f"""best AS (
  {s.first_row("listing", "fecha_iso, nombre", f"{s.quality_score()} DESC, {s.SURVIVOR_ORDER}")}),
told AS (SELECT fecha_iso, nombre, string_agg(DISTINCT organiza, ' + ' ORDER BY organiza) AS merged_from_sources FROM listing GROUP BY ALL)""")(
    lambda df: attach_sources(survivors.best_of_group(_titled(df), "cluster"), resolve.merged_sources(_titled(df))).select("id", "merged_from_sources"))


def _titled(df):
    return df.withColumn("cluster", F.concat_ws("|", F.coalesce(F.col("fecha_iso").cast("string"), F.lit("-")), "nombre"))


@query("fingerprint_text", rf"""
SELECT doc_id, length(CASE WHEN row_number() OVER (PARTITION BY lang, mark ORDER BY doc_id) = 1 THEN text END) AS size
FROM (SELECT *, {s.strip('left(text, 200)')} AS mark FROM documents)""")
def _(spark, sf):
    docs = resolve.fingerprint_text(table(spark, sf, "documents"), run="lang", text="text", order=["doc_id"])
    return docs.select("doc_id", F.length("text").cast("long").alias("size"))


@query("gate_report", f"""WITH {LISTING_SQL}, {SANITIZED}, {gate_values('san')},
d AS (SELECT 100.0::DOUBLE * ((SELECT count(*) FROM listing) - (SELECT count(*) FROM san)) / (SELECT count(*) FROM listing) AS v)
{GATE_ROWS}
UNION ALL SELECT 'drop_ratio', v, 60.0, CASE WHEN v >= 60 THEN 'alert' ELSE 'ok' END FROM d""")
def _(spark, sf):
    df = listing(spark, sf)
    return refine.gate_report(df, quality.sanitize(df, F.lit(AS_OF)))


@query("dedupe_payload", "SELECT DISTINCT ON (event_type, user_id) event_id, event_type, user_id FROM events ORDER BY event_type, user_id, ts, event_id")
def _(spark, sf):
    events = table(spark, sf, "events")
    return survivors.first_seen(events, ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "event_type", "user_id")
