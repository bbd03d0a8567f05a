"""DuckDB SQL for the queries SQL can express, written apart from the Spark code."""

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP10_SQL = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM cut
), keyed AS (
  SELECT doc_id, pos, l, translate(trim(l, {WS}), {AZ}) AS k FROM line
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(rest, '^[^?#]*([?][^#]*)', 1, 's') AS query
  FROM cut
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN contains(host, 'spam') OR contains(host, 'casino') OR contains(query, 'utm_source=ads')
         OR contains(path, 'utm_source=ads') OR regexp_matches(host || path || query, '[.]exe$')
         OR contains(path || query, '/login') OR regexp_matches(host || path || query, '^[^/?#]*(spam|casino)[^/?#]*(/|$)')
       THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

_BITS = " + ".join(f"{16 >> k} * CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INTEGER)" for k in range(5))
OP1_SQL = f"""
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages
), grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM page
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM grouped
"""


def _op4_sql() -> str:
    """Sentences by a join on the sentence table, sequences as aggregated strings."""
    from .licenses import RULES, SENTENCES

    known = ", ".join(f"({i}, '{s}')" for i, forms in SENTENCES.items() for s in forms)
    rules = ", ".join(f"('{n}', {len(ids)}, '{'.*'.join(f'<{i}>' for i in ids)}')" for n, ids in RULES)
    return f"""
WITH known(id, s) AS (VALUES {known}), rules(license, n, pattern) AS (VALUES {rules}), ways AS (
  SELECT doc_id, 1 AS way, text AS t FROM documents
  UNION ALL
  SELECT doc_id, 2, regexp_replace(regexp_replace(regexp_replace(text, '\\n\\n+', chr(1), 'g'), '\\n', ' ', 'g'), chr(1), chr(10), 'g') FROM documents
), cut AS (
  SELECT doc_id, way, string_split(regexp_replace(regexp_replace(lower(t), 'spdx-license-identifier:[ \\t]*', 'spdx license identifier ', 'g'), '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM ways
), sentence AS (
  SELECT doc_id, way, unnest(range(len(parts))) AS pos, trim(regexp_replace(unnest(parts), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM cut
), ids AS (
  SELECT doc_id, way, string_agg('<' || id || '>', '' ORDER BY pos) AS ids FROM sentence JOIN known USING (s) GROUP BY ALL
)
SELECT doc_id, license, max(n) AS n_sentences FROM ids JOIN rules ON regexp_matches(ids, pattern) GROUP BY ALL
"""


OP4_SQL = _op4_sql()

# CRC-32 bit by bit: a byte is mixed in and eight shifts follow; list_reduce goes over the bytes and the shifts (-1).
_BYTES = (
    "list_transform(range(length(x)), lambda i: CASE WHEN unicode(substr(x, i + 1, 1)) < 128 THEN [unicode(substr(x, i + 1, 1))] "
    "ELSE [192 | (unicode(substr(x, i + 1, 1)) >> 6), 128 | (unicode(substr(x, i + 1, 1)) & 63)] END)"
)
OP11_SQL = f"""
WITH run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(r, {AZ}) AS x, translate(r, {AZ}) AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7
), step AS (
  SELECT run, list_transform(flatten(list_transform(flatten({_BYTES}), lambda b: [b, -1, -1, -1, -1, -1, -1, -1])), lambda b: CAST(b AS BIGINT)) AS steps FROM run
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(steps, lambda c, b:
    xor(xor(c, CASE WHEN b < 0 THEN 0 ELSE b END) >> 1, (xor(c, CASE WHEN b < 0 THEN 0 ELSE b END) & 1) * 3988292384), CAST(4294967295 AS BIGINT))) AS h
  FROM step
), word AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i) || '_' || substr(word, i + 2) AS holed, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.holed = b.holed AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.less = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), form AS (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n,
    CASE WHEN most >= 10 * n THEN (SELECT min(other) FROM near WHERE near.word = word.word AND other_n = most) END AS form
  FROM word LEFT JOIN best USING (word)
), way AS (
  WITH RECURSIVE go(word, place, form) AS (
    SELECT word, word, form FROM form
    UNION ALL
    SELECT go.word, form.word, form.form FROM go JOIN form ON go.form = form.word
  ) SELECT word, place AS root FROM go WHERE form IS NULL
)
SELECT form.word, form.form, root, n, n_near, form_n FROM form JOIN way USING (word)
"""

OP13_SQL = """
WITH item AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), score AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS s
  FROM item a JOIN item b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
), negative AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, s AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS place
  FROM positive JOIN score USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE place <= 3
"""
