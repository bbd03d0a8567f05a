"""Pigeonhole matching against plain edit distance."""

import random

from listingflow.llm import decontaminate as d
from listingflow.llm.queries import QUERIES
from tests.oracle import DATA


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[at] = rng.choice("abc ")
        elif what == 1:
            out.insert(at, rng.choice("abc "))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))
        assert d.Pattern(item).search(text)[0] == best_distance(item, text)


def test_every_item_within_its_budget_is_found():
    rng = random.Random(2)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 120))).strip() or "a" for _ in range(40)]
    budgets = [int(len(t) * 0.1) for t in items]
    matcher = d.Matcher(items, budgets)
    for _ in range(120):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)
            at = rng.randint(0, len(text))
            text = text[:at] + edited(rng, item, rng.randint(0, 14)) + text[at:]
        want = {i: best_distance(t, text) for i, t in enumerate(items)}
        got = {n: (dist, a, b) for n, dist, a, b in matcher.find(text)}
        assert {n: x[0] for n, x in got.items()} == {i: x for i, x in want.items() if x <= budgets[i]}
        for n, (dist, a, b) in got.items():
            exact = best_distance(items[n], text[a:b])
            assert exact == dist and 0 <= a <= b <= len(text)


def test_registered_query_finds_all_exact_passages(spark):
    sf = f"{DATA}/sf0.001"
    docs = {r["doc_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = QUERIES["op8_edit_matches"](spark, sf).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    for doc, text in docs.items():
        for item, passage in items.items():
            if passage in text:
                assert got.pop((doc, item)) == 0
    for (doc, item), distance in got.items():
        assert 0 < distance <= len(items[item]) * 0.1


def test_odd_inputs(spark):
    item = "What is the capital of the small island, and who built its harbour?"
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, f"x {item.upper()} y", 5), (3, f"x {item.upper()} y", 5),
         (None, "what is teh capital of the small island and who built its harbor", 5), (4, "the capital of the island", 5),
         (5, "lorem ipsum " * 50_000 + item, 5)],
        "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " .,! "), (7, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in d.find_items(docs, bench).collect()), key=str)
    assert got == sorted([(3, 7)] * 4 + [(None, 7)] * 2 + [(5, 7)] * 2, key=str)
    assert {r["doc_id"] for r in d.find_items(docs, bench, block_chars=10).collect()} == {3, None, 5}
    assert {r["doc_id"] for r in d.drop_contaminated(docs, bench).collect()} == {1, 2, 4}
    assert d.find_items(docs, bench.filter("false")).collect() == []
    assert d.find_items(docs.filter("false"), bench).collect() == []
