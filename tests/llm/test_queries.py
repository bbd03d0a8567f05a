"""Queries with SQL match it; URL filter, line dedup and pipeline on odd tables; the pipeline against brute force."""

import hashlib
import re

import pytest

import corpus_pipeline
from listingflow.llm import decontaminate, linededup, urlfilter
from listingflow.llm.queries import ORACLES, QUERIES
from tests.llm.test_nearcopies import brute as near_groups
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    report = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert report.startswith("ok"), report


def test_url_rules(spark):
    urls = {
        None: ("", "", None, "allow"), "no scheme.com/": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://Example.COM/en/x?q#f": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.b.net/es/1": ("a.b.net", "/es/1", "net/es/", "block"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://x.com": ("x.com", "", None, "allow"), "http://x.com/": ("x.com", "/", "com/", "allow"),
        "http://notnet/es/": ("notnet", "/es/", None, "allow"), "http://x.org?a.com/b": ("x.org", "", None, "allow"),
        "http://evil.org/a.com/x": ("evil.org", "/a.com/x", None, "allow"), "http://my-casino.org/x": ("my-casino.org", "/x", None, "block"),
        "http://x.org/get.exe": ("x.org", "/get.exe", None, "block"), "http://x.org/" + "a" * 100_000 + ".exe": ("x.org", "/" + "a" * 100_000 + ".exe", None, "block"),
        "a://b\n/c": ("b\n", "/c", None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {(r["url"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in urlfilter.judge_urls(df).collect()}
    assert got == set(urls.items())
    assert urlfilter.judge_urls(df.filter("false")).collect() == []


def test_line_dedup(spark):
    long = "this line is certainly longer than forty code points"
    rows = [(i, f"own {i}\n  {long.upper()}\t\n{long}\n", 9, "m") for i in range(6)] + [
        (8, None, 9, "m"), (9, "", 9, "m"), (5, long, 9, "m"), (5, long, 9, "m"), (None, long, 9, "m"), (7, "\n".join(["é" * 39] * 200), 9, "m"),
        (10, "\n".join(f"{k} {'w' * 50}" for k in range(200)), 9, "m")]
    rows += [(20 + i, "\n".join(f"{k} {'w' * 50}" for k in range(200)), 9, "m") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, line_keep string")
    got = linededup.drop_repeated_lines(docs.select("doc_id", "text", "n_chars")).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    for i in range(5):
        assert texts[i] == [(f"own {i}\n", len(f"own {i}\n"))]
    assert sorted(t for t, _ in texts[5]) == sorted([long, long, rows[5][1]])
    assert texts[8] == [(None, 9)] and texts[9] == [("", 9)] and texts[None] == [("", 0)]
    assert texts[7] == [(rows[11][1], 9)] and texts[24] == [(rows[-1][1], 9)] and texts[10] == [("", 0)]
    maps = {r["doc_id"]: r for r in linededup.keep_bitmaps(docs).collect()}
    assert maps[10]["n_dropped"] == 200 and sorted(maps[10]["keep"]) == [0, 1, 2, 3] and maps[10]["keep"][0] == 0
    assert linededup.drop_repeated_lines(docs.select("doc_id", "text").filter("false")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        assert set(after) <= set(before)
        if name == "quality classifier":
            scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_line_field"](spark, SF).collect()}
            assert set(after) == {d for d in before if scored[d]}
        elif name == "line dedup":
            keys = {}
            for d, t in before.items():
                for line in (t or "").split("\n"):
                    keys.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")), set()).add(d)
            bad = {k: max(v) for k, v in keys.items() if len(k) >= 40 and len(v) >= 5}
            for d, t in before.items():
                kept = [x for x in t.split("\n") if bad.get(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")), d) == d]
                assert after[d] == "\n".join(kept)
        elif name == "near dedup":
            assert set(after) == {d for d, first in near_groups(list(before.items())) if d == first}
        else:
            passages = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for d, t in before.items():
                if any(p in decontaminate.normal(t) for p in passages):
                    assert d not in after
        docs = spark.createDataFrame(rows, out.schema)


def test_pipeline_on_odd_rows(spark, tmp_path):
    fine = "The harbour was built long ago. It is still in use today by many ships.\nShips come and go."
    rows = [(1, fine, "en", "s", 5), (1, fine, "en", "s", 5), (None, fine, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, fine + " x" * 30_000, "en", "s", 1)]
    for n, some in enumerate((rows, [])):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
        assert got == ({1, 2, 4} if some else set())


def test_digest_of_an_empty_document(spark):
    row = next(r for r in QUERIES["op10_line_dedup"](spark, SF).collect() if r["n_dropped"] == 0)
    text = spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
