"""Deleted interpolation against dictionaries of counts and a plain expectation-maximisation."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from listingflow.llm import interpolation as lm

BEGIN = "<begin>"


def tokens_of(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + ["<end>"]


def tables(docs, order):
    """Counts of n-grams and of their contexts, each with begin marks."""
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for words in docs:
        for i in range(len(words)):
            for n in range(order):
                gram = tuple(words[max(i - n, 0) : i + 1])
                gram = gram if i >= n else (BEGIN,) + gram
                grams[n][gram] += 1
                contexts[n][gram[:-1]] += 1
    return grams, contexts


def steps(words, i, model, order):
    grams, contexts = model
    for n in range(order):
        gram = tuple(words[max(i - n, 0) : i + 1])
        gram = gram if i >= n else (BEGIN,) + gram
        c = contexts[n][gram[:-1]]
        yield c.bit_length(), grams[n][gram] / c if c else 0.0


def brute(rows, order):
    parts = [lm.part_of(i) for i, _ in rows]
    texts = [tokens_of(t) for _, t in rows]
    main = tables([t for t, p in zip(texts, parts) if p == lm.MAIN], order)
    every = tables([t for t, p in zip(texts, parts) if p != lm.HELD], order)
    weights = [[0.0] + [0.5] * 64 for _ in range(order)]
    before = None
    for _ in range(lm.ROUNDS):
        got, able = np.zeros((order, 65)), np.zeros((order, 65))
        total, n_all = 0.0, 0
        for words in (t for t, p in zip(texts, parts) if p == lm.DELETED):
            for i in range(len(words)):
                p, shares = 1 / (len(main[0][0]) + 1), []
                for n, (b, f) in enumerate(steps(words, i, main, order)):
                    own = weights[n][b] * f
                    p = own + (1 - weights[n][b]) * p
                    shares.append((b, own / p))
                rest = 1.0
                for n in range(order - 1, -1, -1):
                    b, s = shares[n]
                    got[n, b] += rest * s
                    able[n, b] += rest
                    rest *= 1 - s
                total, n_all = total + math.log(p), n_all + 1
        if not n_all:
            break
        for n in range(order):
            for b in range(1, 65):
                weights[n][b] = (got[n, b] + 0.5) / (able[n, b] + 1) if b == 1 or able[n, b] else weights[n][b - 1]
        if before is not None and total / n_all - before < lm.GAIN:
            break
        before = total / n_all
    n, v = sum(every[0][0].values()), len(every[0][0])
    out = []
    for (doc_id, _), words, part in zip(rows, texts, parts):
        base = sum(math.log10((every[0][0][(w,)] + 1) / (n + v + 1)) for w in words)
        score = 0.0
        for i in range(len(words)):
            p = 1 / (v + 1)
            for k, (b, f) in enumerate(steps(words, i, every, order)):
                p = weights[k][b] * f + (1 - weights[k][b]) * p
            score += math.log10(p)
        out.append((doc_id, part == lm.HELD, len(words), sum((w,) in every[0][0] for w in words), n, base, score))
    return out


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "WORLD", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(80)]
    rows += [(100 + i, "the same text again and AGAIN") for i in range(30)]
    return rows + [(200, None), (201, ""), (202, " \n\t "), (203, "never seen words"), (None, "no id"), (5, rows[5][1]), (204, "a " * 5000)]


@pytest.mark.parametrize("order,bytes_a_chunk", [(3, lm.CHUNK_BYTES), (2, 500), (1, 500)])
def test_scores(spark, monkeypatch, order, bytes_a_chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", bytes_a_chunk)
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 300)  # several buckets
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in lm.score_documents(docs, order=order).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_held_out_is_never_counted(spark):
    rows = corpus()
    held = [i for i, _ in rows if i is not None and lm.part_of(i) == lm.HELD]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    others = docs.filter(~docs.doc_id.isin(held) | docs.doc_id.isNull())
    a = {(r["doc_id"], round(r["score"], 9)) for r in lm.score_documents(docs).collect() if r["doc_id"] not in held}
    b = {(r["doc_id"], round(r["score"], 9)) for r in lm.score_documents(others).collect()}
    assert a == b and held


def test_tables_without_rows_or_training(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm.score_documents(docs.filter("false")).collect() == []
    held = next(i for i, _ in corpus() if i is not None and lm.part_of(i) == lm.HELD)
    for r in lm.score_documents(docs.filter(docs.doc_id == held)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_learned_weights_beat_even_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm.count_all(docs, 3)
    types, n_docs, tokens = rows.selectExpr("sum(main_types)", "sum(main_docs)", "sum(main_tokens)").first()
    learned = lm.learn(rows, 3, n_docs, tokens, types)
    total = {"learned": 0.0, "even": 0.0}
    for r in rows.collect():
        counts, sizes = lm.unsqueeze(r["deleted_counts"]).reshape(3, -1), lm.unsqueeze(r["deleted_sizes"])
        for name, w in (("learned", learned), ("even", lm.blank(3))):
            total[name] += np.log(lm.mixed(w, counts, sizes, n_docs, tokens, types)).sum()
    assert total["learned"] > total["even"]


def test_arrays_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70_000, 1 << 40):
        x = rng.integers(0, top, 1000)
        assert (lm.unsqueeze(lm.squeeze(x)).astype(np.int64) == x).all()
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unsqueeze_sorted(lm.squeeze_sorted(keys)) == keys).all()
    assert len(lm.unsqueeze(lm.squeeze(np.zeros(0, np.int64)))) == 0
