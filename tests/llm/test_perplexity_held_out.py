"""Scores without a document's own counts, against a model of the other documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from listingflow.llm import perplexity as p
from listingflow.llm.common import shared_folder


def levels_of(texts):
    levels = {5: Counter()}
    for t in texts:
        t = "\x01" * 4 + t
        levels[5].update(t[i - 4 : i + 1] for i in range(4, len(t)))
    for order in (4, 3, 2, 1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    return levels


def discounts(levels):
    out = {}
    for order, counts in levels.items():
        n = [0, *(sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        cut = [0]
        for i in (1, 2, 3):
            d = None if y is None or not n[i] else i - (i + 1) * y * n[i + 1] / n[i]
            cut.append(i / 2 if d is None or d <= 0 or d >= i else d)
        out[order] = cut
    return out


def log_p(text, levels, cuts):
    contexts = {order: defaultdict(list) for order in levels}
    for order, counts in levels.items():
        for g, c in counts.items():
            contexts[order][g[:-1]].append(c)

    def probability(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        seen, cut = contexts[len(g)].get(g[:-1]), cuts[len(g)]
        if not seen:
            return probability(g[1:])
        c = levels[len(g)].get(g, 0)
        spare = sum(cut[min(x, 3)] for x in seen)
        return (c - cut[min(c, 3)] + spare * probability(g[1:])) / sum(seen)

    marked = "\x01" * 4 + text
    return sum(math.log(probability(marked[i - 4 : i + 1])) for i in range(4, len(marked)))


def test_own_counts_are_taken_out(spark):
    rng = random.Random(4)
    texts = {"a": ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))) for _ in range(15)] + ["zqzqzqzqxx", "", "twice é長", "twice é長"],
             None: ["".join(rng.choice("xyz\n") for _ in range(80)) for _ in range(3)], "one": ["alone here"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folder = shared_folder(spark, "held-out-test")
    model = p.HashArrays(folder, p.write_arrays(p.count_model(p.count_grams(docs)).unionByName(p.copied_texts(docs)), folder))
    for lang, ts in texts.items():
        cuts = discounts(levels_of(ts))
        got = p.held_out_sums(model, lang or "", *p.grams_of(ts), p.copies_of(model, lang or "", ts))
        want = [log_p(t, levels_of([o for o in ts if o != t]), cuts) for i, t in enumerate(ts)]
        assert np.allclose(got, want, atol=1e-6)
        new = ["abcabc xyz Q", "zzzzz", *ts[:2]]
        got = p.held_out_sums(model, lang or "", *p.grams_of(new), np.zeros(len(new)))
        assert np.allclose(got, [log_p(t, levels_of(ts), cuts) for t in new], atol=1e-6)


def test_junk_does_not_vouch_for_itself(spark):
    rng = random.Random(7)
    words = [rng.choice("bdfglmnprst") + rng.choice("aeiou") + rng.choice("lnrst") + rng.choice(["", "a", "o"]) for _ in range(120)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 400))) for _ in range(150)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(size)) for size in (300, 1500, 6000)]
    junk += ["".join(chr(rng.randint(33, 126)) if rng.random() > 0.2 else " " for _ in range(size)) for size in (300, 1500, 6000)]
    rows = [(i, t, "en") for i, t in enumerate(prose + junk)]
    got = {r["doc_id"]: r["perplexity"] for r in p.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert min(got[i] for i in range(len(prose), len(rows))) > 2 * max(got[i] for i in range(len(prose)))
