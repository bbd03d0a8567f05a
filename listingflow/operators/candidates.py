"""Similar titles of large blocks: candidate pairs by filters that lose none, then leaders by an ordered fixpoint.

A score at the threshold can come about in two ways, and each has its own candidates.

* The letters of both titles, or of both token lists in some order, agree.  Then the lengths
  differ by a bounded factor, and at least a bounded number of letter pairs is common to both
  (one insertion or deletion changes three of them).  Titles are dealt into slices by length,
  slices whose lengths could fit meet as tiles of bounded size, and inside a tile common letter
  pairs and letters are counted as matrix products before a title is scored.
* The common tokens make up most of the shorter title.  Then one of its rarest tokens, as many
  as outweigh what may be missing, is common: a join of these with all tokens of all titles.

The leaders of the sequential pass are the fixpoint of two rules over the edges: a title without
an open or leading title before it leads; a title next to a leader before it does not.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.similarity import title_score
from ..session import python_partitions, settle

# The tile kernel travels with the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE, GRAMS, LETTERS, STRIPE = 2000, 512, 64, 500


# ------------------------------------------------------------ inside a tile
def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(present letter pairs, repeats among them, letter counts) of each text; pairs and letters are hashed."""
    grams, letters = np.zeros((len(texts), GRAMS), np.float32), np.zeros((len(texts), LETTERS), np.uint8)
    for i, text in enumerate(texts):
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        grams[i, (codes[:-1] * 31 + codes[1:]) % (GRAMS - 1)] = 1
        letters[i] = np.minimum(np.bincount(codes[1:-1] % LETTERS, minlength=LETTERS), 255)
    sizes = np.array([len(t) for t in texts])
    return grams, sizes + 1 - grams.sum(axis=1).astype(np.int64), letters


def close(left: list[str], right: list[str], threshold: float):
    """(i, j) of pairs whose lengths, letter pairs and letters allow the letters to agree by ``threshold``."""
    gl, el, cl = bags(left)
    gr, er, cr = bags(right)
    nl, nr = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    for at in range(0, len(left), STRIPE):
        a = slice(at, at + STRIPE)
        total = nl[a, None] + nr[None, :]
        least = (total * (1 - 3 * (1 - threshold / 100)) + 2) / 2 - np.minimum(el[a, None], er[None, :])
        fits = (gl[a] @ gr.T + 1e-3 >= least) & (200.0 * np.minimum(nl[a, None], nr[None, :]) >= threshold * total) & (total > 0)
        i, j = np.nonzero(fits)
        i += at
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            shared = np.minimum(cl[x], cr[y]).sum(axis=1, dtype=np.int64)
            # Counts end at 255: longer texts are scored as they are.
            good = (200.0 * shared >= threshold * (nl[x] + nr[y])) | (np.maximum(nl[x], nr[y]) > 255)
            yield x[good], y[good]


def tile_udf(threshold: float, use_ratio: bool):
    """Edges (a, b) of one tile of rows (side, form, node); a tile of a slice with itself has side 0 only."""
    def solve(tile: pa.Table) -> pa.Table:
        node, side = tile.column("node").combine_chunks(), tile.column("side").to_numpy()
        titles, forms = node.field("title").to_pylist(), tile.column("form").to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        a, b, seen = [], [], set()
        for i, j in close([forms[k] for k in left], [forms[k] for k in right], threshold):
            for x, y in zip(left[i].tolist(), right[j].tolist()):
                if (same and x >= y) or titles[x] == titles[y] or (titles[x], titles[y]) in seen:
                    continue
                if title_score(titles[x], titles[y], use_ratio) >= threshold:
                    seen.add((titles[x], titles[y]))
                    a.append(x)
                    b.append(y)
        return pa.table({"block": tile.column("block").take(pa.array(a, pa.int64())), "a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return solve


# ------------------------------------------------------------ candidates
def tokens_of(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: sorted(set(t.split())))


def forms_of(titles: pd.Series) -> pd.Series:
    """The sorted tokens as one text and, where its letters or length differ, the title."""
    def forms(title: str) -> list[str]:
        parts = title.split()
        form = " ".join(sorted(set(parts)))
        return [form] if len(form) == len(title) and sorted(parts) == sorted(set(parts)) else [form, title]

    return titles.map(forms)


def lists(fn: Callable[[pd.Series], pd.Series], title: str) -> Column:
    return F.pandas_udf(fn, "array<string>")(F.col(title))


def letter_edges(nodes: DataFrame, threshold: float, use_ratio: bool, tile: int) -> DataFrame:
    """(block, a, b): pairs of titles with agreeing letters and a score at the threshold."""
    step = math.log((200 - threshold) / threshold) / 2 * 1.0001 if threshold < 100 else 1e-4
    texts = F.array(F.element_at("forms", 1)) if not use_ratio else F.col("forms")
    rows = nodes.withColumn("forms", lists(forms_of, "node.title")).select("block", "node", F.explode(texts).alias("form"))
    rows = settle(rows.filter("form <> ''").withColumn("band", F.floor(F.log(F.length("form").cast("double")) / step).cast("int")))
    sizes = rows.groupBy("block", "band").count().select("block", F.struct("band", F.ceil(F.col("count") / tile).cast("int").alias("n")).alias("s"))
    bands = settle(sizes.groupBy("block").agg(F.collect_list("s").alias("bands")))  # a few dozen lengths a block
    own = F.element_at(F.filter("bands", lambda s: s["band"] == F.col("band")), 1)["n"]
    placed = rows.join(bands, "block").withColumn("own", F.struct("band", F.pmod(F.xxhash64("form"), own).cast("int").alias("slice")))
    near = F.filter("bands", lambda s: F.abs(s["band"] - F.col("band")) <= 2)
    others = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda k: F.struct(s["band"].alias("band"), k.alias("slice")))))
    dealt = placed.select("block", "node", "form", "own", F.explode(others).alias("other")).select(
        "block", "node", "form", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    node = nodes.schema["node"].dataType
    schema = StructType([StructField("block", nodes.schema["block"].dataType), StructField("a", node), StructField("b", node)])
    parts = python_partitions(nodes.sparkSession)
    return dealt.repartition(8 * parts, "tile").groupBy("tile").applyInArrow(tile_udf(threshold, use_ratio), schema)


def token_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b): pairs whose common tokens reach the threshold against the shorter title."""
    rows = settle(nodes.withColumn("tokens", lists(tokens_of, "node.title")).withColumn("size", F.length(F.array_join("tokens", " "))).filter("size > 0"))
    each = rows.select("block", "node", "size", "tokens", F.explode("tokens").alias("token"))
    rarity = settle(each.groupBy("block", "token").agg(F.count(F.lit(1)).alias("n")))
    order = F.array_sort(F.collect_list(F.struct("n", "token")))
    listed = each.select("block", "node", "size", "token").join(rarity, ["block", "token"]).groupBy("block", "node", "size").agg(order.alias("ranked"))
    # What may be missing of the shorter title, counted with a space for each token.
    slack = F.col("size") * (1 - threshold / (200 - threshold)) + 1e-9

    def before(i):
        return F.aggregate(F.slice(F.col("ranked"), F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y["token"]) + 1)

    prefix = listed.withColumn("rare", F.filter("ranked", lambda x, i: before(i) <= slack))
    short = prefix.select("block", F.col("node").alias("a"), F.col("size").alias("a_size"), F.transform("ranked", lambda x: x["token"]).alias("a_tokens"), F.explode("rare.token").alias("token"))
    long = each.select("block", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("tokens").alias("b_tokens"), "token")
    common = F.array_intersect("a_tokens", "b_tokens")
    shared = F.length(F.array_join(common, " "))
    covers = (F.size(common) == F.least(F.size("a_tokens"), F.size("b_tokens"))) | (
        (200.0 * shared) / (shared + F.least("a_size", "b_size")) >= threshold)
    fits = short.join(long, ["block", "token"]).filter((F.col("a_size") <= F.col("b_size")) & (F.col("a") != F.col("b")) & covers)
    return fits.select("block", "a", "b")


def similar_edges(titles: DataFrame, *, threshold: float, use_ratio: bool, tile: int = TILE) -> DataFrame:
    """(block, early, late): all pairs of titles of a block with a score at the threshold.

    ``titles`` are (block, title, rank); a node is the struct (rank, title).
    """
    nodes = settle(titles.select("block", F.struct("rank", "title").alias("node")))
    both = letter_edges(nodes, threshold, use_ratio, tile).unionByName(token_edges(nodes, threshold))
    return both.select("block", F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct()


# ------------------------------------------------------------ leaders
def ordered_leaders(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, title, leader) of the sequential pass over ``titles`` with the given edges.

    The rounds follow the longest chain of titles that wait for each other, not the size.
    """
    edges = settle(edges)
    waiting, leading, open_edges = settle(titles.select("block", F.struct("rank", "title").alias("node"))), [], edges

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.withColumnRenamed("node", side)

    def ends(df: DataFrame) -> DataFrame:
        return df.select("block", F.col("late").alias("node")).distinct()

    while True:
        new = settle(waiting.join(ends(open_edges), ["block", "node"], "left_anti"))
        leading.append(new)
        next_to = ends(open_edges.join(named(new, "early"), ["block", "early"], "left_semi"))
        waiting = settle(waiting.join(new, ["block", "node"], "left_anti").join(next_to, ["block", "node"], "left_anti"))
        if waiting.isEmpty():
            break
        for side in ("early", "late"):
            open_edges = open_edges.join(named(waiting, side), ["block", side], "left_semi")
        open_edges = settle(open_edges)
    leaders = settle(reduce(DataFrame.unionByName, leading))
    joined = edges.join(named(leaders, "early"), ["block", "early"], "left_semi").groupBy("block", "late").agg(F.min("early").alias("early"))
    return leaders.select("block", F.col("node.title").alias("title"), F.col("node.title").alias("leader")).unionByName(
        joined.select("block", F.col("late.title").alias("title"), F.col("early.title").alias("leader")))
