"""Stored indexes: rows of a plain search, and how little of the table a search reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listingflow.operators import postings

WORDS = ["concierto", "conciertos", "gala", "noche", "noches", "teatro", "sala", "rock", "jazz", "fado", "luna", "sol"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8))), rng.choice([None, "Teatro Cuyás", "Sala"])) for i in range(3000)]
    return spark.createDataFrame(data, "id long, title string, place string")


def files_read(df) -> set:
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_words_and_best(spark, rows, tmp_path):
    path = str(tmp_path / "words")
    assert postings.write_word_index(rows, path, key="id", fields={"title": "A", "place": "B"}, block_keys=100) > 20
    stems = {"concierto": "conciert", "conciertos": "conciert", "noche": "noch", "noches": "noch"}
    want = {}
    for r in rows.collect():
        found = {}
        for text, weight in ((r["title"], postings.v.SEARCH_WEIGHTS["A"]), (r["place"], postings.v.SEARCH_WEIGHTS["B"])):
            for w in re.findall(r"\w+", (text or "").lower()):
                found[stems.get(w, w)] = found.get(stems.get(w, w), 0) + weight
        if "conciert" in found and "noch" in found:
            want[r["id"]] = round(found["conciert"] + found["noch"], 6)
    got = {r["key"]: r["rank"] for r in postings.search_words(spark, path, "Noches de conciertos").collect()}
    assert got == want and len(want) > 100
    order = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for n in (1, 7, 5000):
        best = [(r["key"], r["rank"]) for r in postings.search_words(spark, path, "noche concierto", n).collect()]
        assert best == order[:n]
    assert postings.search_words(spark, path, "concierto zarzuela").collect() == []
    assert postings.search_words(spark, path, "de la").collect() == []
    # A search opens the folders of its words alone.
    every = files_read(spark.read.parquet(f"{path}/postings"))
    assert len(files_read(postings.read_postings(spark, path, ["conciert", "noch"]))) <= 2 < len(every)


def test_substrings(spark, rows, tmp_path):
    path = str(tmp_path / "grams")
    more = spark.createDataFrame([(9001, "İstanbul ñandú", None), (9002, "", ""), (9003, "ab", "x")], "id long, title string, place string")
    table = rows.unionByName(more)
    postings.write_substring_index(table, path, key="id", columns=["title", "place"], block_keys=50)
    texts = {r["id"]: [(t or "").lower() for t in (r["title"], r["place"])] for r in table.collect()}
    for needle in ("ierto no", "TEATRO", "cuy", "ñandú", "ab", "zzzz", "rock luna"):
        got = postings.search_substring(spark, path, needle, key="id", columns=["title", "place"])
        assert {r["id"] for r in got.collect()} == {i for i, t in texts.items() if any(needle.lower() in x for x in t)}
        assert got.columns == table.columns
