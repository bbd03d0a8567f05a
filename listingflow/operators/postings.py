"""Stored search indexes: posting tables that a search reads a few blocks of.

An index is a Parquet table of (bucket, term, block, max_weight, postings).  ``bucket`` is a
folder per hash of the term, so a search opens the folders of its words; inside, rows are sorted
by term and block.  A block is a hash range of keys, so a very frequent term is spread over many
rows of bounded size, and words are intersected block by block: first on the slim columns, then
on the postings of blocks that hold all words.  Block maxima bound the ranks in a block, so that
the first ``n`` rows need only the blocks that could beat them.

Words go through a stemmer, whose forms meet in one term; trigrams of a text make the same table
an index for substrings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import vocab as v
from ..functions.stem import stem
from ..functions.text import let
from ..session import settle
from .serving import matches, search_index

BUCKETS, PARTS, BLOCK_KEYS = 64, 64, 512


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def write_postings(rows: DataFrame, path: str, *, key: str, block_keys: int = BLOCK_KEYS, keyed: DataFrame | None = None) -> int:
    """Write (term, key, weight) rows, one per term and key, as an index; returns the number of blocks.

    ``keyed`` has the keys in rows that cost less to make, if there are any: they are only counted.
    """
    keys = (rows if keyed is None else keyed).agg(F.approx_count_distinct(key)).first()[0]
    blocks = max(1, -(-keys // block_keys))
    placed = rows.select(bucket_of(F.col("term")).alias("bucket"), "term", block_of(F.col(key), blocks).alias("block"), F.struct(F.col(key).alias("key"), "weight").alias("p"))
    # A block has a bounded number of keys, so the lists are bounded whatever the term.
    table = placed.groupBy("bucket", "term", "block").agg(
        F.max("p.weight").alias("max_weight"), F.array_sort(F.collect_list("p")).alias("postings"))
    (table.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    rows.sparkSession.createDataFrame([(blocks,)], StructType([StructField("blocks", LongType())])).write.parquet(f"{path}/meta")
    return blocks


def read_postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The rows of some terms; only their folders are opened, and the terms reach the scan."""
    hashed = spark.range(1).select(F.explode(F.lit(list(terms))).alias("t")).select(bucket_of(F.col("t")).alias("b"))
    buckets = sorted({r["b"] for r in hashed.collect()})  # one per word of a query
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))


def ranked(rows: DataFrame, n_terms: int) -> DataFrame:
    """(key, block, rank) of keys that all terms have."""
    flat = rows.select("block", F.inline("postings"))
    return flat.groupBy("key", "block").agg(F.round(F.sum("weight"), 6).alias("rank"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == n_terms)


def search_postings(spark: SparkSession, path: str, terms: Sequence[str], n: int | None = None) -> DataFrame:
    """(key, block, rank) of the keys that have all terms; with ``n`` the first ones by rank, then key."""
    terms = sorted(set(terms))
    rows = read_postings(spark, path, terms)
    bounds = rows.groupBy("block").agg(F.round(F.sum("max_weight"), 6).alias("bound"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == len(terms))
    if n is None:
        return ranked(rows.join(bounds.select("block"), "block", "left_semi"), len(terms)).drop("found")
    # The n blocks with the highest bounds set the rank to beat; then all blocks that could.
    heads = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(n).collect()]
    best = ranked(rows.filter(F.col("block").isin(*heads)), len(terms)).orderBy(F.desc("rank"), "key").limit(n).collect() if heads else []
    least = min(r["rank"] for r in best) if len(best) == n else float("-inf")
    able = bounds.filter(F.col("bound") >= least).select("block")
    return ranked(rows.join(able, "block", "left_semi"), len(terms)).orderBy(F.desc("rank"), "key").limit(n).drop("found")


# ------------------------------------------------------------------ words
def write_word_index(df: DataFrame, path: str, *, key: str, fields: dict[str, str], block_keys: int = BLOCK_KEYS, **options) -> int:
    """Index of the stems of all words; ``fields`` maps columns to weight classes."""
    words = settle(search_index(df, key=key, fields=fields, **options))
    # Each word is stemmed once, however many rows have it.
    terms = settle(words.select("token").distinct().withColumn("term", stem(F.col("token"))))
    stems = words.join(terms, "token").groupBy("term", key).agg(F.round(F.sum("weight"), 6).alias("weight"))
    return write_postings(stems, path, key=key, block_keys=block_keys, keyed=words)


def search_words(spark: SparkSession, path: str, query: str, n: int | None = None, *, stop_words=v.QUERY_STOP_WORDS) -> DataFrame:
    """(key, rank) of the rows that hold a form of every word of the query, whatever form it has there."""
    words = sorted({w for w in query.lower().split() if w not in stop_words})
    if not words:
        return spark.createDataFrame([], "key long, rank double")
    stems = [r["s"] for r in spark.range(1).select(F.explode(F.lit(words)).alias("w")).select(stem(F.col("w")).alias("s")).collect()]
    return search_postings(spark, path, stems, n).select("key", "rank")


# ------------------------------------------------------------------ substrings
def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text."""
    def runs(low: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
        return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    return let(F.lower(F.coalesce(text, F.lit(""))), runs)


def write_substring_index(df: DataFrame, path: str, *, key: str, columns: Sequence[str], block_keys: int = BLOCK_KEYS) -> int:
    """Index of the trigrams of some columns, and the rows themselves in folders by block."""
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))
    rows = df.select(key, F.explode(grams).alias("term"), F.lit(1.0).alias("weight"))
    blocks = write_postings(rows, path, key=key, block_keys=block_keys, keyed=df)
    part = F.pmod(block_of(F.col(key), blocks), F.lit(PARTS)).cast("int")
    df.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", key).write.partitionBy("part").parquet(f"{path}/rows")
    return blocks


def search_substring(spark: SparkSession, path: str, needle: str, *, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows with ``needle`` in one of the columns, in any case.

    Keys that have all its trigrams come from the index; only the folders they lie in are
    opened and their texts checked.  A needle of one or two characters is looked for in all rows.
    """
    rows, low = spark.read.parquet(f"{path}/rows"), needle.strip().lower()
    if len(low) >= 3:
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        keys = search_postings(spark, path, grams).select(F.col("key").alias(key), F.pmod("block", F.lit(PARTS)).cast("int").alias("part"))
        parts = [r["part"] for r in keys.select("part").distinct().collect()]  # at most PARTS
        rows = rows.filter(F.col("part").isin(*parts)).join(keys, [key, "part"], "left_semi")
    return rows.filter(matches(low, *columns)).drop("part")
