"""What an index keeps and costs, texts chosen without broadcasts, settled copies."""

from pyspark.sql import functions as F

from listingflow.operators import postings, resolve, serving
from listingflow.session import settle


def test_index_keeps_words_of_texts(spark):
    df = spark.createDataFrame([(1, "Nosotros durante la gala", None)], "id long, a string, b string")
    rows = {r.token: (r.n, r.weight) for r in serving.search_index(df, key="id", fields={"a": "A", "b": "C"}).collect()}
    assert rows == {w: (1, 1.0) for w in ("nosotros", "durante", "gala")}


def test_first_new_text_sends_no_table_to_the_driver(spark):
    rows = [("a", 1, 0, "x"), ("a", 2, 0, "x"), ("a", 2, 1, "y"), ("a", 3, 0, "y"), ("a", 3, 1, "x"), ("b", 4, 0, "x")]
    df = resolve.first_new_text(
        spark.createDataFrame(rows, "run string, id long, ord int, t string"), run="run", order=["id"], place="ord", text="t")
    assert {(r.id, r.t) for r in df.collect()} == {(1, "x"), (2, "y"), (4, "x")}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_trigrams_lower_a_text_once(spark):
    df = spark.createDataFrame([(1, "AbcÑ b"), (2, "ab"), (3, None), (4, "aaaa"), (5, "abc")], "id long, t string")
    out = df.select("id", postings.trigrams(F.col("t")).alias("g"))
    assert {r.id: list(r.g) for r in out.collect()} == {1: ["abc", "bcñ", "cñ ", "ñ b"], 2: [], 3: [], 4: ["aaa"], 5: ["abc"]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_keys_are_counted_before_the_terms(spark, tmp_path):
    df = spark.createDataFrame([(i, f"title {i}", "x") for i in range(50)], "id long, t string, p string")
    rows = df.select("id", F.explode(postings.trigrams(F.col("t"))).alias("term"), F.lit(1.0).alias("weight"))
    assert postings.write_postings(rows, str(tmp_path / "a"), key="id", block_keys=10, keyed=df) == postings.write_postings(rows, str(tmp_path / "b"), key="id", block_keys=10)


def test_settled_copies_are_compressed_hard(spark):
    assert all(f.endswith(".zstd.parquet") for f in settle(spark.range(10)).inputFiles())
