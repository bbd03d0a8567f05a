"""Forward-backward against enumeration, held-out accuracy, odd inputs."""

import itertools
import random

import numpy as np

from listingflow.llm import classifier as c
from listingflow.llm.queries import QUERIES
from tests.oracle import DATA


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6, 1, 3]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    good = rng.normal(size=sum(sizes)) * 2
    chain = c.Chain(np.zeros(1), rng.normal(size=(2, 2)), np.zeros(1), np.ones(1))
    p, pair, total = chain.marginals(good, first)
    want, want_pair, want_total = np.zeros(len(good)), np.zeros((2, 2)), 0.0
    for a, n in zip(first, sizes):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(good[a + i] * y for i, y in enumerate(path))
                                  + sum(chain.step[x, y] for x, y in zip(path, path[1:]))) for path in paths])
        want_total += np.log(weight.sum())
        for w, path in zip(weight / weight.sum(), paths):
            for i, y in enumerate(path):
                want[a + i] += w * y
            for x, y in zip(path, path[1:]):
                want_pair[x, y] += w
    assert np.allclose(p, want) and np.allclose(pair, want_pair) and np.isclose(total, want_total)


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice("aB .!|#é1") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts += ["", "\n", " ", "word word word\nword word word"]
    maker = c.LineFeatures()
    whole = maker.of(texts)[0]
    assert np.allclose(whole, np.concatenate([maker.of([t])[0] for t in texts]))
    assert not np.isnan(whole).any()


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op6_line_field"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels)
    assert right >= 0.95 * len(labels) and all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_inputs(spark):
    junk, fine = "Ab### cd$$$ ef%%% gh&&&\n" * 4, "The harbour was built long ago. It is still in use.\nShips come and go.\n"
    rows = [(i, junk if i % 2 else fine + str(i), 9) for i in range(60)] + [(97, None, 9), (98, "", 9), (None, "x" * 200_000, 9), (0, fine, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    chain = c.train(docs, labels)
    got = c.score_documents(docs, chain).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "score", "predicted"}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["predicted"] == 1 - r["doc_id"] % 2
    assert c.train(docs, labels.filter("false")) is None
    assert {r["score"] for r in c.score_documents(docs, None).collect()} == {1.0}
    assert c.score_documents(docs.filter("false"), chain).collect() == []
