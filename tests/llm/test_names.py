"""Stages on tables whose extra columns have the names that operators use themselves."""

import pytest

from listingflow.llm import classifier, decontaminate, linededup, nearcopies, urlfilter

NAMES = [
    "line_keep", "line_dropped", "map_doc", "map_text", "n_dropped", "keep", "key", "pos", "line", "h1", "salt", "text_hash", "bad_id", "item_id",
    "distance", "begin", "end", "gone_id", "node", "fp", "mark", "root", "component_id", "shard", "anchors", "stays", "quality", "lines", "features",
]
ROWS = [(1, "a first line that is longer than forty code points\nown"), (2, None), (2, "same same"), (None, ""), (3, "The quick brown fox jumps over the lazy dog")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), *range(len(NAMES))) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES))


def kept(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in rows)
    return sorted((tuple(r)[:2] for r in rows), key=str)


def test_line_dedup(docs):
    assert kept(linededup.drop_repeated_lines(docs), docs) == sorted(ROWS, key=str)


def test_near_copies(docs):
    # The null and the empty text are copies of each other, the group's first id is 2.
    assert kept(nearcopies.keep_first_of_groups(docs), docs) == sorted([ROWS[0], ROWS[1], ROWS[2], ROWS[4]], key=str)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(9, "quick brown fox jumps over the lazy", "x")], "item_id long, text string, doc_id string")
    assert kept(decontaminate.drop_contaminated(docs, items), docs) == sorted(ROWS[:4], key=str)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for chain in (None, classifier.train(docs, labels)):
        scored = classifier.score_documents(docs, chain)
        assert scored.columns == [*docs.columns, "score", "predicted"] and scored.count() == len(ROWS)


def test_labels_without_documents_do_not_use_up_the_sample(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 400)] + [(5000 + i, 0, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert classifier.train(docs, labels, max_docs=2) is not None


def test_portions():
    texts = ["a" * 5, "b" * 9, "", "c" * 3, "d" * 3]
    assert list(classifier.portions(texts, rows=2, chars=8)) == [["a" * 5], ["b" * 9], ["", "c" * 3], ["d" * 3]]


@pytest.mark.parametrize("name", ["url_judged", "rule", "host", "query", "own"])
def test_url_rules(spark, name):
    df = spark.createDataFrame([(1, "http://a.net/es/x", "mine")], f"page_id long, url string, {name} string")
    row = urlfilter.judge_urls(df).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == ("a.net", "/es/x", "net/es/", "block")
    assert name in ("rule", "host") or row[name] == "mine"
