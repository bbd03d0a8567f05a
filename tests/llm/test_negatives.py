"""Hard negatives against a brute-force pass; Strassen products against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingflow.llm import negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (0, 3, 4), (5, 0, 3), (33, 64, 70), (65, 33, 129), (100, 64, 257), (200, 200, 200)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(m + k + n)
    for bound in (300, 1 << 62):  # the second one wraps around, as int64 products do
        a, b = rng.integers(-bound, bound, (m, k)), rng.integers(-bound, bound, (k, n))
        assert (hn.strassen(a, b, leaf=8) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 20, 500), rng.permutation(500)
    parts, whole = hn.Heaps(7), hn.Heaps(7)
    whole.add(0, scores, ids)
    for at in range(0, 500, 37):
        parts.add(0, scores[at : at + 37], ids[at : at + 37])
    assert list(parts.rows()) == list(whole.rows())
    order = sorted(zip(-scores, ids))[:7]
    assert [(0, int(i), int(-s)) for s, i in order] == list(whole.rows())


def brute(rows, every, label_of):
    items = {}
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        item = (label_of(vec_id, label), [math.floor(256 * x) for x in v])
        items[vec_id] = min(items.get(vec_id, item), item)
    out = set()
    for a, (label, v) in items.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in items.items() if b != a}
        order = lambda some: sorted(some, key=lambda b: (-score[b], b))
        for p in order(b for b in score if items[b][0] == label)[:5]:
            fits = [b for b in score if items[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out |= {(a, p, k, b, score[p], score[b]) for k, b in enumerate(order(fits)[:3], 1)}
    return out


@pytest.mark.parametrize("block,tile", [(hn.BLOCK, hn.TILE), (4, 16)])
def test_against_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "ANCHOR_TILE", 3)
    rng = random.Random(5)
    near = [[rng.gauss(0, 1) for _ in range(70)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.8))) for x in near[rng.randrange(6)]], rng.choice([0, 1, 2, 2, 2, 77])) for i in range(300)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(40)]  # ties
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 70, 1), (403, [float("inf")] * 70, 1), (404, [1.0] * 70, None),
             (None, [1.0] * 70, 1), (405, [], 1), (406, [3.0] * 9, 2), (410, [2.0] * 80, 0), rows[20], rows[20], (20, rows[21][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(4)
    want = brute(rows, 10, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    got = hn.mine_negatives(df, F.col("vec_id") % 10 == 0, relabel=label, block=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 100
    assert hn.mine_negatives(df.filter("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.mine_negatives(df, F.col("vec_id") < 0).collect() == []
