"""SimHash groups against a direct computation of the same definition."""

import random
import re

import numpy as np
import xxhash

from listingflow.llm import simhash
from listingflow.llm.queries import QUERIES
from tests.oracle import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute(docs, k=3, radius=2):
    fps = {d: brute_fingerprint(t, k) for d, t in docs}
    group = brute_groups(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for d, f in fps.items():
        g = group[f]
        least[g] = min(least.get(g, d), d)
    return sorted((d, f"{f:016x}", least[group[f]]) for d, f in fps.items())


def test_registered_query(spark):
    sf = f"{DATA}/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_simhash"](spark, sf).collect())) == brute(docs)


def test_groups_of_dense_and_spread_points():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([
        c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
        for c in centres
    ] + [rng.integers(0, 2**64, 800, dtype=np.uint64)]))[:, None]
    for radius in (1, 2, 3, 4):
        root = simhash.groups_of(x, lambda d, i, j: d <= radius, -(-radius // 2))
        values = [int(v) for v in x[:, 0]]
        want = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= radius)
        seen = {}
        for v, r in zip(values, root):
            assert seen.setdefault(want[v], r) == r
        assert len(set(root.tolist())) == len(set(want.values()))


def test_routing_loses_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)}
    rows = spark.createDataFrame([(f.to_bytes(8, "big"), 0) for f in fps], "fp binary, n_shingles long")
    x = np.array(sorted(fps), np.uint64)[:, None]
    tree = simhash.grow_tree(x, 1, 64)
    assert tree is not None
    edges = simhash.stars(simhash.route(rows, tree, 1, 1), 1, lambda d, a, b: d <= 2, 1)
    roots = {bytes(r["u"]): bytes(r["root"]) for r in simhash.components(edges).collect()}
    want = brute_groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    got = {f: roots.get(f.to_bytes(8, "big"), f.to_bytes(8, "big")) for f in fps}
    pair = {(want[f], got[f]) for f in fps}
    assert len(pair) == len({a for a, _ in pair}) == len({b for _, b in pair})


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b C"), (5, "a B c"), (6, "one"), (6, "one"), (None, "one"), (7, "é" * 40_000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.hamming_groups(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 6), (7, 7)}
    assert simhash.hamming_groups(docs.filter("false")).collect() == []


def test_fingerprints_of_many_sets_are_those_of_each():
    draw = np.random.default_rng(2)
    sets = [draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (0, 1, 2, 5, 0, simhash.PIECE - 8, simhash.PIECE, 3 * simhash.PIECE + 7, 1, 0)]
    fps, mins = simhash.fingerprints_of(sets, 2, 3)
    for h, fp, least in zip(sets, fps, mins):
        mixed = [[int(x) for x in simhash.remix(h, i)] for i in (0, 1, 100, 101, 102)]
        bits = [[2 * sum(x >> 63 - b & 1 for x in one) > len(one) for b in range(64)] for one in mixed[:2]]
        assert fp == np.packbits(bits).tobytes()
        assert least == [int(np.uint64(min(one)).astype(np.int64)) for one in mixed[2:] if one]


def test_a_split_measures_its_vantages_at_once(monkeypatch):
    x = np.random.default_rng(3).integers(0, 1 << 63, 4000, dtype=np.uint64).reshape(-1, 1)
    calls, real = [], simhash.distances
    monkeypatch.setattr(simhash, "distances", lambda a, b: calls.append(1) or real(a, b))
    v, m, work = simhash.split_at(x, 1)
    assert len(calls) == 1 and work < 0.9 and (real(x, v) <= m).mean() > 0.2
