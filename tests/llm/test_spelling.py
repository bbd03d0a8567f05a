"""Spelling variants against a brute-force pass over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from listingflow.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def edit_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in words if edit_one(w, x)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def corpus(seed: int):
    """Families of words with a common half, edits of edits, repeated letters and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "abcdeéñÿ"
    roots = ["aaaaaaaa", "station", "nación" + "es", "überprüfung", "x" * 300]
    roots += ["".join(rng.choice("abc") for _ in range(4)) + "tion" for _ in range(40)]
    bag = []
    for w in roots:
        bag += [w] * rng.choice([2, 5, 400])
        for _ in range(6):
            x = w
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice(letters) + x[i:], x[:i] + rng.choice(letters) + x[i + 1 :]])
            bag += [rng.choice([x, x.capitalize()])] * rng.choice([1, 2, 3, 30])
    rng.shuffle(bag)
    rows = [(i, rng.choice([" ", "\n", "1", "_"]).join(bag[i * 50 : (i + 1) * 50])) for i in range(len(bag) // 50 + 1)]
    return rows + [(9001, None), (9002, ""), (9003, "7 + 8"), (None, "station Station"), (7, rows[7][1])]


def test_words_and_forms(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n long, key string")
    want = brute(rows)
    assert any(f for _, f, *_ in want) and any(f != r for _, f, r, *_ in want if f)
    for limit in (spelling.LIMIT, 1):
        got = spelling.group_variants(docs, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "to be or not")], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == []
    assert spelling.group_variants(docs.filter("false")).collect() == []
