"""Planted junk of every kind goes, clean documents of every length stay."""

import random
from collections import Counter

from listingflow.llm import perplexity as p

LENGTHS = (300, 1500, 6000)


def language(seed, letters, size=400):
    """A generator of texts: each word has few successors."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(size)]
    after = {w: rng.sample(words, 6) for w in words}

    def text(length):
        out = [rng.choice(words)]
        while sum(map(len, out)) + len(out) < length:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    return text


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(11)
    prose, foreign = language(1, "aeiouthnsrdl"), language(2, "aeioumzkvptgw")
    rows, kinds = [], []

    def put(kind, text, lang="en"):
        rows.append((len(rows), text, lang))
        kinds.append(kind)

    for length in LENGTHS:
        for _ in range(200):
            put(("clean", length), prose(rng.randint(length * 2 // 3, length * 4 // 3)))
    for _ in range(200):
        put(("clean fr", 0), foreign(rng.randint(300, 6000)), "fr")
    for length in LENGTHS:
        for _ in range(3):
            words = prose(length).split()
            rng.shuffle(words)
            put(("random order", length), " ".join(words))
            put(("other language", length), foreign(length))
            put(("letters", length), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(length)))
            put(("printable", length), "".join(chr(rng.randint(33, 126)) if rng.random() > 0.2 else " " for _ in range(length)))
            put(("suffixes", length), " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in prose(length).split()))
            put(("table", length), " | ".join(prose(length).split()))
        copy = prose(length)
        for _ in range(30):
            put(("copies", length), copy)
    for i in range(5):
        put(("few", 0), foreign(600 + i), "xx")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept, all_of = Counter(), Counter(kinds)
    for r in p.judge_documents(docs).collect():
        kept[kinds[r["doc_id"]]] += r["kept"]
    for kind, n in all_of.items():
        if kind[0].startswith("clean"):
            assert kept[kind] >= 0.98 * n, (kind, kept[kind])
        elif kind[0] in ("copies", "few"):
            assert kept[kind] == n, kind
        else:
            assert kept[kind] == 0, (kind, kept[kind])
