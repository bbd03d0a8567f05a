"""Candidate edges and ordered leaders against brute force over all pairs of titles."""

import random

import pytest

from listingflow.functions.similarity import Leaders, follow_leaders, title_score
from listingflow.operators import candidates, resolve

WORDS = ["concierto", "de", "la", "orquesta", "filarmonica", "noche", "jazz", "teatro", "el", "gran", "festival", "danza", "compania",
         "nacional", "rock", "solista", "piano", "y", "voz", "invierno", "primavera", "homenaje", "a", "los", "beatles"]


def titles_of(seed: int, n: int) -> list[str]:
    """Titles, reordered, shortened, extended and mistyped ones, repeated words, odd spaces, very long ones."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 6))]
        title = " ".join(words)
        kind = rng.randrange(8)
        if kind == 0:
            i = rng.randrange(len(title))
            title = title[:i] + rng.choice("abcxyz") + title[i + rng.randrange(2) :]
        elif kind == 1:
            title = " ".join(reversed(words)) + " " + words[0]
        elif kind == 2:
            title = title.replace(" ", "  ") + " "
        elif kind == 3:
            title += " " + "".join(rng.choice("abcdefg") for _ in range(rng.choice([3, 8, 300])))
        elif kind == 4:
            title = title.replace("o", "ó")
        out.append(title)
    return list(dict.fromkeys([*out, "", " ", "x", "日本 公演", "日本公演"]))


def frame(spark, titles, seed=0):
    rng = random.Random(seed)
    order = list(range(len(titles)))
    rng.shuffle(order)
    return spark.createDataFrame([("day", t, (r,)) for t, r in zip(titles, order)], "block string, title string, rank struct<n: int>"), order


@pytest.mark.parametrize("seed,threshold,use_ratio,tile", [(1, 82, True, 60), (2, 90, False, 60), (3, 82, True, 5000), (4, 100, True, 60)])
def test_no_edge_is_lost(spark, seed, threshold, use_ratio, tile):
    titles = titles_of(seed, 350)
    df, order = frame(spark, titles, seed)
    edges = candidates.similar_edges(df, threshold=threshold, use_ratio=use_ratio, tile=tile).collect()
    got = {(e.early.title, e.late.title) for e in edges}
    rank = dict(zip(titles, order))
    want = set()
    for i, a in enumerate(titles):
        for b in titles[:i]:
            if title_score(a, b, use_ratio) >= threshold:
                want.add((a, b) if rank[a] < rank[b] else (b, a))
    assert len(edges) == len(got) and got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_leaders_equal_the_sequential_pass(spark, seed):
    titles = titles_of(seed, 300)
    df, order = frame(spark, titles, seed)
    edges = candidates.similar_edges(df, threshold=82, use_ratio=True, tile=50)
    got = {r.title: r.leader for r in candidates.ordered_leaders(df, edges).collect()}
    ranked = [t for _, t in sorted(zip(order, titles))]
    assert got == dict(zip(ranked, follow_leaders(ranked, Leaders(82, True))))
    large = {r.title: r.leader for r in resolve.assign_leaders(df, threshold=82, chunk=20, slice_size=50).collect()}
    assert large == got
