"""Spelling variants of the words of a corpus, grouped by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
The longer word of a pair (either one, of equal lengths) is cut into two disjoint chunks.  The
edit touches one of its code points, so the other chunk lives on in the shorter word: the first
one at the same place, the second one shifted by the difference of the lengths, one at most.
The shorter word therefore offers its positional grams of the chunks' lengths; those at places
no chunk within that shift can reach match nothing and are not made.  Equal chunks are joined
and every candidate is verified.

A chunk that very many words share (a common ending) would make a square of candidates.  Such
a group is cut again: the half that holds the edit is split into two chunks of its own, one of
which is whole as well, and so on down to one code point, where what is whole pins the word but
for one letter.  Groups are split as long as they hold more than ``limit`` pairs; nothing is
capped.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, LIMIT, EVERY = 7, 2, 10, 4096, 31


def count_words(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of all runs of letters, one of ``every`` of them with a code point deleted.

    A null text has no runs; a null doc_id counts as an empty one in the hash.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    # Runs that are too short for a word, whole or not, are left before they are hashed.
    runs = runs.filter(F.char_length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def cells(words: DataFrame, extra: int) -> DataFrame:
    """Both halves of each word (as the shorter one by ``extra``) as the place of the edit: (word, n, extra, a, b)."""
    size = F.char_length("word") + extra
    half = F.floor(size / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), size.cast("int").alias("b")))
    return words.select("word", "n", F.lit(extra).alias("extra"), F.inline(halves))


def keyed(rows: DataFrame) -> DataFrame:
    """With ``key``: the hash of what is whole, before and after the cell [a, b) of the longer word."""
    size = F.char_length("word")
    before = F.substring("word", F.lit(1), F.col("a"))
    after = F.substring("word", F.col("b") - F.col("extra") + 1, size)
    return rows.withColumn("key", F.xxhash64(size + F.col("extra"), "a", "b", before, after))


def split(rows: DataFrame) -> DataFrame:
    """Both halves of each cell."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
    return rows.select("word", "n", "extra", F.inline(halves))


def near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once; ``words`` has distinct (word, n)."""
    rows = settle(keyed(cells(words, 0).unionByName(cells(words, 1))))
    found = []
    while True:
        long, short = F.count_if(F.col("extra") == 0), F.count_if(F.col("extra") == 1)
        # Pairs of one length and pairs of two, of those that a group can still be split for.
        sizes = rows.groupBy("key").agg(long.alias("long"), short.alias("short"), F.max(F.col("b") - F.col("a")).alias("width"))
        hot = settle(sizes.filter((F.col("long") * (F.col("long") / 2 + F.col("short")) > limit) & (F.col("width") > 1)).select("key"))
        none = hot.isEmpty()
        cold = rows if none else rows.join(hot, "key", "left_anti")
        a = cold.filter("extra = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = cold.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "extra")
        twins = (F.col("extra") == 1) | (F.col("a") < F.col("b"))
        found.append(settle(a.join(b, "key").filter(twins & near(F.col("a"), F.col("b"))).select("a", "a_n", "b", "b_n").distinct()))
        if none:
            break
        rows = settle(keyed(split(rows.join(hot, "key", "left_semi"))))
    # A pair of two lengths can lie in several cells where a code point repeats.
    return reduce(DataFrame.unionByName, found).distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way along (word, form); each round doubles the steps.

    Along the way counts grow at least by a factor, so a way is short and has no circle.
    """
    ways = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = settle(ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            return ahead.select("word", "root")
        ways = ahead.select("word", "root")


def group_variants(
    docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES,
    every: int = EVERY, limit: int = LIMIT,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text).

    The form of a word is its near word that occurs most, among equals the first in code-point
    order, if it occurs ``times`` as often; the root is the last form of forms.  Null and empty
    texts have no words; repeated rows count again; a very long run is a word like any other;
    an empty table gives an empty result; other columns are ignored.
    """
    words = settle(count_words(docs.select("doc_id", "text"), min_length=min_length, min_count=min_count, every=every))
    pairs = settle(near_pairs(words, limit=limit))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    most = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most.alias("best"))
    enough = -F.col("best.minus") >= times * F.col("n")
    named = settle(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    ))
    roots = follow_forms(named.filter("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
