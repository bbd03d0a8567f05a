"""Hard negatives for contrastive training: exact integer scores of anchors against all rows.

Vectors become integers, and an anchor's scores with a tile of rows come from one matrix
product.  Products are taken by Strassen's recursion on int64 tiles, padded with zeros to even
sides: seven products of halves instead of eight, and integer additions, which are exact (all
arithmetic is modulo 2 ** 64, as that of int64 is).  Two passes over the rows keep what can be
merged: first each anchor's heap of best rows of its label, then, with these scores known, a heap
of best rows of other labels for each window.  A task merges the heaps of all its tiles and
returns one per anchor; a ranked window per anchor merges those of the tasks.

Anchors go round in blocks of bounded size, each sent to the tasks that scan the rows, so no
vector of the table is shuffled for a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .common import ship, to_batch

ship(__name__)

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
BLOCK, TILE, ANCHOR_TILE, LEAF = 8192, 4096, 1024, 32
NONE = np.iinfo(np.int64).min


# ------------------------------------------------------------------ products
def padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.int64)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices; sides of ``leaf`` or less are multiplied directly."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    m2, k2, n2 = -(-m // 2), -(-k // 2), -(-n // 2)
    if (2 * m2, 2 * k2) != a.shape:
        a = padded(a, 2 * m2, 2 * k2)
    if (2 * k2, 2 * n2) != b.shape:
        b = padded(b, 2 * k2, 2 * n2)
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m2, 2 * n2), np.int64)
    out[:m2, :n2] = p1 + p4 - p5 + p7
    out[:m2, n2:] = p3 + p5
    out[m2:, :n2] = p2 + p4
    out[m2:, n2:] = p1 - p2 + p3 + p6
    return out[:m, :n]


# ------------------------------------------------------------------ heaps
def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in order, ties by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Heaps:
    """The k best (score, id) of each of many keys; heaps of parts merge to those of the whole."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def least(self, key: int) -> int:
        """A score below this one has no place any more."""
        scores = self.held[key][0] if key in self.held else ()
        return int(scores[-1]) if len(scores) == self.k else NONE

    def add(self, key: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.held:
            scores, ids = np.concatenate([self.held[key][0], scores]), np.concatenate([self.held[key][1], ids])
        at = best(scores, ids, self.k)
        self.held[key] = scores[at], ids[at]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for key, (scores, ids) in self.held.items():
            yield from zip([key] * len(scores), ids.tolist(), scores.tolist())


# ------------------------------------------------------------------ rows
def usable(rows: DataFrame, *, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): ids, labels and integer vectors of the rows that take part, one per vec_id.

    Rows with a null id, label or vector or any null or non-finite component don't; of several
    rows of one vec_id that with the smallest label, then vector, does.
    """
    finite = F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    some = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", whole.alias("v"))
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as int64 rows; shorter ones go on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    flat = vectors.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def scan(rows: DataFrame, anchors: list, fill: Callable, k: int) -> DataFrame:
    """(key, id, score): heaps of all tasks.  ``fill(heaps, anchor numbers, scores, ids, labels)`` sees every tile."""
    width = max((len(a["v"]) for a in anchors), default=0)
    block = np.zeros((len(anchors), width), np.int64)
    for i, a in enumerate(anchors):
        block[i, : len(a["v"])] = a["v"]
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, block = Heaps(k), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = matrix(part.column(2), block.shape[1])[:, : block.shape[1]]
                for top in range(0, len(block), ANCHOR_TILE):
                    fill(heaps, top, block[top : top + ANCHOR_TILE], x, ids, labels)
        out = list(heaps.rows())
        for at in range(0, len(out), 1 << 16):
            yield to_batch(out[at : at + (1 << 16)], schema)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "key long, id long, score long")


def ranked(heaps: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of each key, with ``rank`` from 1; cut below the shuffle too."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives_of(rows: DataFrame, anchors: list, k: int) -> DataFrame:
    """(anchor, id, score, rank): the best other rows of each anchor's label."""
    own, names = np.array([a["label"] for a in anchors]), np.array([a["vec_id"] for a in anchors])

    def fill(heaps: Heaps, top: int, block, x, ids, labels) -> None:
        mine = own[top : top + len(block)]
        for label in np.intersect1d(mine, labels):
            a, c = np.flatnonzero(mine == label), np.flatnonzero(labels == label)
            scores = strassen(block[a], np.ascontiguousarray(x[c].T))
            for i, row in zip(a + top, scores):
                some = np.flatnonzero((row >= heaps.least(i)) & (ids[c] != names[i]))
                if len(some):
                    heaps.add(int(i), row[some], ids[c][some])

    return ranked(scan(rows, anchors, fill, k), k, "key")


def negatives_of(rows: DataFrame, anchors: list, windows: list[tuple[int, int, int]], k: int) -> DataFrame:
    """(key, id, score, rank): the best rows of other labels in each window (anchor number, least, most); key is its number."""
    own = np.array([a["label"] for a in anchors])
    of_anchor: dict[int, list[tuple[int, int, int]]] = {}
    for key, (i, least, most) in enumerate(windows):
        if least <= most:
            of_anchor.setdefault(i, []).append((key, least, most))

    def fill(heaps: Heaps, top: int, block, x, ids, labels) -> None:
        scores = strassen(block, np.ascontiguousarray(x.T))
        for i, row in enumerate(scores, top):
            mine = of_anchor.get(i)
            if not mine:
                continue
            low = min(max(least, heaps.least(key)) for key, least, _ in mine)
            some = np.flatnonzero((row >= low) & (row <= max(most for _, _, most in mine)) & (labels != own[i]))
            if not len(some):
                continue
            value, name = row[some], ids[some]
            for key, least, most in mine:
                inside = (value >= max(least, heaps.least(key))) & (value <= most)
                if inside.any():
                    heaps.add(key, value[inside], name[inside])

    return ranked(scan(rows, anchors, fill, k), k, "key")


def mine_negatives(
    embeddings: DataFrame, anchor: Column, *, relabel: Column | None = None, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``embeddings`` has (vec_id, label, embedding); ``anchor`` says which rows are anchors and
    ``relabel`` (by default the label) which label a row has.  Higher scores come first, ties go
    by the smaller vec_id.  A negative's score lies between ``low`` and ``high`` percent of the
    positive's; a negative positive score leaves no room.  Vectors of unequal lengths go on with
    zeros.  Components beyond int64 end at its bounds.  An empty table gives an empty result;
    other columns are ignored.  ``block`` bounds the anchors a task holds.
    """
    spark = embeddings.sparkSession
    slim = embeddings.select("vec_id", (F.col("label") if relabel is None else relabel).alias("label"), "embedding")
    rows = settle(usable(slim, scale=scale))
    chosen = rows.filter(anchor)
    blocks = max(1, -(-2 * chosen.count() // block))
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks))
    if blocks > 1:
        dealt = settle(dealt)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = []
    for number in range(blocks):
        anchors = dealt.filter(F.col("block") == number).collect()
        if not anchors:
            continue
        best_own = positives_of(rows, anchors, positives).collect()
        windows = [(int(r["key"]), -(-low * int(r["score"]) // 100), high * int(r["score"]) // 100) for r in best_own]
        names = spark.createDataFrame(
            [(key, anchors[r["key"]]["vec_id"], r["id"], r["score"]) for key, r in enumerate(best_own)],
            "key long, anchor_id long, positive_id long, positive_score long",
        )
        found = negatives_of(rows, anchors, windows, negatives)
        out.append(settle(found.join(names, "key").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
