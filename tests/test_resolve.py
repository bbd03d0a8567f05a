"""Distributed resolution against sequential brute force on small random sets."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from listingflow.functions.similarity import title_score
from listingflow.functions.text import canonical_title
from listingflow.operators import resolve
from listingflow.operators.aggregates import clean_counters
from listingflow.plans.refine import resolve as resolve_plan

SCHEMA = ("id long, nombre string, lugar string, fecha_iso date, hora string, organiza string, url_venta string, "
          "descripcion string, imagen_url string, precio_num double")
PLACES = ["Gran Canaria", "Sala Scala", "Teatro Cuyás", None, "Sala Scala"]


def make(seed, n, days=3, titles=14):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["rock", "jazz", "noche", "fito", "luna", "gran", "show"]) for _ in range(rng.randint(1, 4))) for _ in range(titles)]
    rows = []
    for i in range(n):
        t = rng.choice(base) + rng.choice(["", "", " en concierto", "s", " live"])
        # A third of all rows sits on one day.
        day = dt.date(2027, 1, 1 if rng.random() < 0.34 else rng.randint(2, 1 + days)) if rng.random() > 0.1 else None
        hour = rng.choice([None, "", "18:00", "19:30", "20:00", "21:30", "23:00", "10:00"])
        rows.append((i, t, rng.choice(PLACES), day, hour, rng.choice(["CICCA", "Tickety", "Otra"]), f"u{i % 17}",
                     rng.choice([None, "x" * rng.randint(1, 400)]), rng.choice([None, "", f"https://img/{i}.png"]), rng.choice([None, 5.0])))
    return rows


def fold(x):
    import unicodedata
    x = unicodedata.normalize("NFKD", (x or "").lower().strip())
    return "".join(c for c in x if not unicodedata.combining(c))


def generic(place):
    return fold(place) in {"gran canaria", "las palmas", "las palmas de gran canaria", "españa", "espana", "canarias",
                           "islas canarias", "sin especificar", ""}


def order(r):
    return (fold(r[1]), generic(r[2]), -len(r[7] or ""), r[0])


def canon_of(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, t string")
    return {r.id: r.c for r in df.select("id", canonical_title(F.col("t")).alias("c")).collect()}


def slow_clusters(rows, canon):
    by_day = defaultdict(list)
    for r in sorted(rows, key=order):
        if r[3] is not None:
            by_day[r[3]].append(r)
    out = {}
    for day, group in by_day.items():
        leaders = []
        for r in group:
            c = canon[r[0]]
            hit = next((x for x in leaders if title_score(c, x) >= 82), None)
            if hit is None:
                leaders.append(c)
                hit = c
            out[r[0]] = (day, hit)
    return out


def groups_of(labels):
    out = defaultdict(set)
    for k, label in labels.items():
        out[label].add(k)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed,chunk,slice_size", [(1, 4096, 20000), (2, 5, 7), (3, 3, 4)])
def test_fuzzy_cluster_equals_sequential_pass(spark, seed, chunk, slice_size):
    rows = make(seed, 160)
    got = resolve.fuzzy_cluster(spark.createDataFrame(rows, SCHEMA), chunk=chunk, slice_size=slice_size)
    got = {r.id: r.cluster for r in got.filter("fecha_iso IS NOT NULL").select("id", "cluster").collect()}
    want = slow_clusters(rows, canon_of(spark, rows))
    assert set(got) == set(want)
    assert groups_of(got) == groups_of(want)


def slow_subgroups(items, gap=120):
    groups, out = [], {}
    for key, m in items:
        hit = next((i for i, g in enumerate(groups) if m == -999 or any(h == -999 or abs(m - h) < gap for h in g)), None)
        if hit is None:
            hit = len(groups)
            groups.append([])
        groups[hit].append(m)
        out[key] = hit
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 3), (3, 2), (4, 5)])
def test_hour_subgroups_equal_sequential_pass(spark, seed, chunk):
    rng = random.Random(seed)
    rows, want = [], {}
    for cluster in range(6):
        size = 60 if cluster == 0 else rng.randint(1, 9)
        free = 0.0 if cluster == 0 else 0.15
        minutes = [-999 if rng.random() < free else rng.choice([600, 660, 700, 720, 780, 900, 1000, 1015, 1140, 1300]) for _ in range(size)]
        items = list(enumerate(minutes))
        want.update({(str(cluster), k): v for k, v in slow_subgroups(items).items()})
        rows += [(str(cluster), (k,), m) for k, m in items]
    df = spark.createDataFrame(rows, "cluster string, rank struct<id: int>, minute int")
    got = {(r.cluster, r.rank.id): r.sub for r in resolve.hour_subgroups(df, chunk=chunk).collect()}
    assert got == want


def test_late_member_pulls_repeated_minute_to_an_earlier_group(spark):
    # 720 first opens group 1; after 660 joined group 0, the next 720 fits group 0.
    rows = [("a", (i,), m) for i, m in enumerate([600, 720, 660, 720, 720])]
    df = spark.createDataFrame(rows, "cluster string, rank struct<id: int>, minute int")
    for chunk in (1, 2, 100):
        got = [r.sub for r in resolve.hour_subgroups(df, chunk=chunk).orderBy("rank").collect()]
        assert got == [0, 1, 0, 0, 0]


def score(r):
    pref = {"CICCA": 65, "Tickety": 80}.get(r[5], 50)
    place = (r[2] or "").strip()
    return (pref + (10 if (r[4] or "").strip() else 0) + (10 if r[9] is not None else 0)
            + (0 if not place else 2 if generic(place) else 20) + min(len(r[7] or "") // 100, 10))


def minutes(r):
    return -999 if not r[4] or generic(r[2]) else int(r[4][:2]) * 60 + int(r[4][3:])


def slow_resolve(rows, canon, merge_drafts=False):
    seen, first = set(), []
    for r in sorted(rows, key=order):
        k = (r[5], r[6], r[3], r[4] or "")
        if k not in seen:
            seen.add(k)
            first.append(r)
    label = slow_clusters(first, canon)
    clusters = defaultdict(list)
    for r in first:
        clusters[label.get(r[0], ("draft",) if merge_drafts else ("draft", r[0]))].append(r)
    keep = {}
    for key, group in clusters.items():
        sources = " + ".join(sorted({r[5] for r in group}))
        named = [(r[2] or "").strip().lower() for r in group]
        named = [p for p in named if p and not generic(p)]
        if len(named) >= 2 and len(set(named)) == 1:
            parts = {0: group}
        else:
            subs = slow_subgroups([(r[0], minutes(r)) for r in group])
            parts = defaultdict(list)
            for r in group:
                parts[subs[r[0]]].append(r)
        for part in parts.values():
            best = max(part, key=score)
            keep[best[0]] = sources
    return keep


@pytest.mark.parametrize("seed,chunk,drafts", [(5, 4096, "pass"), (6, 4, "pass"), (7, 4096, "merge"), (8, 3, "merge")])
def test_resolution_equals_sequential_rules(spark, seed, chunk, drafts):
    rows = make(seed, 150)
    got = resolve_plan(spark.createDataFrame(rows, SCHEMA), drafts=drafts, chunk=chunk)
    got = {r.id: r.merged_from_sources for r in got.collect()}
    assert got == slow_resolve(rows, canon_of(spark, rows), drafts == "merge")


def slow_clean(rows):
    blocks = defaultdict(list)
    for r in rows:
        low = r[1].lower().strip()
        if len(low) < 3 or low in {"música", "teatro"} or "entradas" in low:
            continue
        blocks[(r[3], r[4] or "", fold(r[2]))].append(r)
    dead, fused = set(), {}
    prio = {"CICCA": 3, "Tickety": 7}
    for group in blocks.values():
        done = set()
        for i, a in enumerate(group):
            if a[0] in done:
                continue
            cluster = [a] + [b for b in group[i + 1:] if b[0] not in done and title_score(a[1].lower(), b[1].lower(), False) >= 90]
            if len(cluster) < 2:
                continue
            done |= {r[0] for r in cluster}
            cluster.sort(key=lambda r: (prio.get(r[5], 99), -len(r[7] or ""), r[0]))
            desc, image = cluster[0][7], cluster[0][8]
            for d in cluster[1:]:
                if len(d[7] or "") > len(desc or ""):
                    desc = d[7]
                if not image and d[8]:
                    image = d[8]
                dead.add(d[0])
            fused[cluster[0][0]] = (desc, image)
    return {r[0]: fused.get(r[0], (r[7], r[8])) for r in rows if r[0] not in dead}


@pytest.mark.parametrize("seed", [11, 12])
def test_clean_table_equals_sequential_pass(spark, seed):
    rows = make(seed, 200, days=1, titles=8)
    got = {r.id: (r.descripcion, r.imagen_url) for r in resolve.clean_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow_clean(rows)


def test_texts_stay_out_of_the_clusters(spark, monkeypatch):
    """What is written between the steps holds sizes, not descriptions; the counters agree with the cleaned rows."""
    written = []
    monkeypatch.setattr(resolve, "settle", lambda df, keep=resolve.settle: written.append(df.schema.simpleString()) or keep(df))
    rows = make(14, 200, days=1, titles=8) + [(None, "rock noche live", "Telde", None, "", "Otra", "u", "z" * 900, None, None)]
    rows += [(1000, "rock noche live", "Telde", None, "", "Tickety", "u", "y" * 10, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    cleaned = {r.id: (r.descripcion, r.imagen_url) for r in resolve.clean_table(df).filter("id IS NOT NULL").collect()}
    assert written and not any("descripcion" in columns for columns in written)
    assert cleaned.pop(1000) == ("z" * 900, None)
    want = slow_clean(rows[:-2])
    assert cleaned == want
    old = {r[0]: (r[7], r[8]) for r in rows}
    counters = clean_counters(resolve.table_masters(df.filter("id < 1000"))).first()
    assert counters.duplicados_eliminados == 200 - len(want)
    assert counters.maestros_enriquecidos == sum(old[k] != x for k, x in want.items())


def test_large_table_blocks_use_rounds(spark):
    rows = make(13, 150, days=1, titles=10)
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r.id: r.cluster for r in resolve.table_clusters(df).select("id", "cluster").collect()}
    b = {r.id: r.cluster for r in resolve.table_clusters(df, chunk=2, slice_size=3).select("id", "cluster").collect()}
    assert a == b


def test_number_rows_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.n for r in resolve.number_rows(df, ["k"], "n").collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_fingerprint_keeps_first_owner(spark):
    rows = [("a", 1, "x" * 300), ("a", 2, "x" * 250), ("b", 3, "x" * 250), ("a", 4, None), ("a", 5, "y")]
    df = resolve.fingerprint_text(spark.createDataFrame(rows, "run string, n int, t string"), run="run", text="t", order=["n"])
    assert {r.n: r.t and len(r.t) for r in df.collect()} == {1: 300, 2: None, 3: 250, 4: None, 5: 1}
