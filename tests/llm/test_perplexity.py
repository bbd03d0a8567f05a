"""The Kneser-Ney model against a direct computation, base counts against their definition."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from listingflow.llm import perplexity as p
from listingflow.llm.common import shared_folder
from listingflow.llm.queries import QUERIES
from tests.oracle import DATA


def brute_model(texts):
    """Interpolated modified Kneser-Ney of order 5 over characters with begin marks."""
    levels = {5: Counter()}
    for t in texts:
        t = "\x01" * 4 + t
        levels[5].update(t[i - 4 : i + 1] for i in range(4, len(t)))
    for order in (4, 3, 2, 1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    below = lambda g: None
    probability, weight = {}, {}
    for order in range(1, 6):
        counts = levels[order]
        n = [0, *(sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        cut = []
        for i in (1, 2, 3):
            d = None if y is None or not n[i] else i - (i + 1) * y * n[i + 1] / n[i]
            cut.append(i / 2 if d is None or d <= 0 or d >= i else d)
        contexts = defaultdict(list)
        for g, c in counts.items():
            contexts[g[:-1]].append(c)
        for h, cs in contexts.items():
            weight[order, h] = sum(cut[min(c, 3) - 1] for c in cs) / sum(cs)
        for g, c in counts.items():
            low = probability[g[1:]] if order > 1 else 1 / (len(counts) + 1)
            probability[g] = (c - cut[min(c, 3) - 1]) / sum(contexts[g[:-1]]) + weight[order, g[:-1]] * low
        if order == 1:
            rest = weight[1, ""] / (len(counts) + 1)
    def log_p(g):
        if g in probability:
            return math.log(probability[g])
        if len(g) == 1:
            return math.log(rest)
        return math.log(weight.get((len(g), g[:-1]), 1)) + log_p(g[1:])
    return log_p


def test_model_and_back_off(spark):
    rng = random.Random(4)
    texts = {"a": ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 300))) for _ in range(20)],
             None: ["".join(rng.choice("xyz\n") for _ in range(80)) for _ in range(5)]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folder = shared_folder(spark, "grams-test")
    shards = p.write_arrays(p.kneser_ney(p.count_grams(docs)), folder)
    model = p.HashArrays(folder, shards)
    for lang, ts in texts.items():
        log_p = brute_model(ts)
        for text in [*ts, "abcabc xyz Q", "zzzzz", "Ω"]:
            marked = "\x01" * 4 + text
            want = [log_p(marked[i - 4 : i + 1]) for i in range(4, len(marked))]
            got = p.log_probabilities(model, lang or "", p.grams_of([text])[0])
            if text != "Ω":
                assert np.allclose(got, want, atol=1e-4)
            assert len(got) == len(text)


def test_several_shards_and_flushes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i * j) % 26) for j in range(200)), "x") for i in range(60)], "doc_id long, text string, lang string")
    whole = sorted(p.judge_documents(docs).select("doc_id", "perplexity").collect())
    monkeypatch.setattr(p, "SHARD_ENTRIES", 300)
    monkeypatch.setattr(p, "HELD", 100)
    monkeypatch.setattr(p, "CHUNK_CHARS", 500)
    parts = sorted(p.judge_documents(docs).select("doc_id", "perplexity").collect())
    assert [r[0] for r in whole] == [r[0] for r in parts]
    assert np.allclose([r[1] for r in whole], [r[1] for r in parts])


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(5)})
    lines, dup = (text or "").split("\n"), 0
    for i, x in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat


def test_registered_query(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_perplexity"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in rows) > 0.8 * len(rows)


def test_base_counts_of_odd_texts():
    rng = random.Random(6)
    texts = ["", "\n", " \n \n", "a a a a a a", "x\nx\n\n \n \nx", "#|<>" * 5]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert p.base_rules(t) == brute_base(t)


def test_odd_inputs(spark):
    rows = [(1, None, "en", 1), (2, "", None, 1), (None, "word " * 30, "en", 1), (3, "長い文" * 30_000, "ja", 1), (3, "長い文" * 30_000, "ja", 1),
            (4, "one two three four five six seven eight nine ten", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = p.judge_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_failed"] and by[1]["perplexity"] is None and not by[1]["kept"]
    assert by[None]["base_failed"] and not by[4]["base_failed"]
    assert p.judge_documents(docs.filter("false")).collect() == []
