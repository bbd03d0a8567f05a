"""Near copies by the Jaccard similarity of word shingles, every link checked on the texts.

Fingerprints only choose what to check.  Texts with one set of shingles collapse to a node.
Two steps find the links:

* The routing tree of ``simhash`` takes every node by its 64-bit fingerprint, the first word of the
  512 bits, and gives the groups within ``radius`` bits.  Inside a group the links are checked; what
  they join is a class.
* At a similarity of 0.8 fingerprints differ by more than the tree can prune, so links between
  *different* classes are sought by min-wise anchors (texts with a similarity of 0.8 share none of
  8 anchors with probability 0.2 ** 8).  Pairs of one class are settled and not looked at again.

In both, the 512-bit fingerprints of a shard give an estimate, and pairs from ``least`` on, several
standard errors below the threshold, are candidates.  Only links checked by the exact similarity of
both shingle sets count.

Groups of copies would make a square of candidates, so no pair leaves a task.  A first pass over
the anchors' shards marks the nodes that have a candidate there; their sets of shingles then go to these
shards, each candidate that could still join two groups is checked on the spot, and a shard gives
a spanning forest of checked links.  Shards over ``block`` rows, or sets of so many rows of usual
size, are split into pairs of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import ship, to_batch
from .simhash import DOCS, components, distances, distinct_hashes, fingerprint, fingerprints_of, hamming_edges, shingle_hashes  # noqa: F401

ship(__name__)

WORDS, ANCHORS, BLOCK, LEAST, STRIPE, USUAL, CHECKED, RADIUS = 8, 8, 20_000, 0.65, 32, 500, 256, 2
DEALT = ["shard", "node", "home", "fp", "n_shingles"]


def nodes_of(docs: DataFrame, shingle: int, anchors: int) -> DataFrame:
    """(doc_id, mark, node, fp, n_shingles, anchors) of every row; ``node`` names the set of shingles, ``mark`` the text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.binary()), ("fp", pa.binary()), ("n_shingles", pa.int64()),
        ("anchors", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                sets = [distinct_hashes(shingle_hashes(text.as_py(), shingle)) for text in part.column(2).cast(pa.binary())]
                names = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
                fps, mins = fingerprints_of(sets, WORDS, anchors)
                yield to_batch(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), names, fps, map(len, sets), mins)), schema)

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        compute, "doc_id long, mark long, node binary, fp binary, n_shingles long, anchors array<long>")


def deal(keyed: DataFrame, block: int) -> DataFrame:
    """(shard, node, home, fp, n_shingles): nodes in the shards of their keys (way, anchor); a hot key is cut into pairs of slices."""
    sizes = keyed.groupBy("way", "anchor").agg(F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("shingles"))
    load = F.greatest(F.col("count"), F.ceil(F.col("shingles") / USUAL))
    # Keys of a single node make no pair.
    several = settle(sizes.filter(F.col("count") > 1).withColumn("n", F.when(load > block, F.ceil(load * 2 / block)).otherwise(1).cast("int")))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, own).alias("a"), F.greatest(k, own).alias("b")))
    return keyed.join(several.select("way", "anchor", "n"), ["way", "anchor"]).select(
        "node", "home", "fp", "n_shingles", F.explode(pairs).alias("pair"), F.xxhash64("way", "anchor", "pair").alias("shard")
    ).select(*DEALT)


def by_tree(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` keyed by the group of their 64-bit fingerprints that the routing tree finds; all are of no class yet."""
    points = nodes.select("node", "fp", "n_shingles", F.substring("fp", 1, 8).alias("point"))
    unique = settle(points.select(F.col("point").alias("fp"), F.lit(0).cast("long").alias("n_shingles")).distinct())
    roots = settle(components(hamming_edges(unique, radius=radius)))
    # The groups grow with the corpus, so they are not broadcast.
    grouped = points.join(roots.withColumnRenamed("u", "point").hint("merge"), "point", "left")
    return grouped.select("node", F.lit(None).cast("binary").alias("home"), "fp", "n_shingles", F.lit(-1).alias("way"),
                          F.xxhash64(F.coalesce("root", "point")).alias("anchor"))


def by_anchors(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``nodes`` keyed by each of their anchors; ``home`` is the least node of a class, null for that node itself and without a class."""
    own = nodes.join(classes.select(F.col("u").alias("node"), F.col("root").alias("home")).hint("merge"), "node", "left")
    return own.select("node", "home", "fp", "n_shingles", F.posexplode("anchors").alias("way", "anchor"))


def ranks_of(x: np.ndarray, sizes: np.ndarray, homes: np.ndarray, similarity: float, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, candidates of other classes among the rows before it, most similar first) of one shard."""
    bits = 64 * WORDS
    for at in range(0, len(x), STRIPE):
        top = slice(at, min(at + STRIPE, len(x)))
        a, b = sizes[top][:, None], sizes[None, : top.stop]
        shared = np.cos(np.pi * distances(x[top][:, None], x[None, : top.stop]) / bits) * np.sqrt(a * b)
        guess = shared / np.maximum(a + b - shared, 1e-9)
        # No similarity is above that of the sizes.
        fits = (guess >= least) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
        fits &= np.arange(top.stop)[None, :] < np.arange(at, top.stop)[:, None]
        fits &= homes[None, : top.stop] != homes[top][:, None]
        for i in np.flatnonzero(fits.any(axis=1)):
            some = np.flatnonzero(fits[i])
            yield at + int(i), some[np.argsort(-guess[i, some], kind="stable")]


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard, from batches sorted by shard."""
    shard, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a < b:
                if keys[a] != shard and held:
                    yield shard, pa.Table.from_batches(held)
                    held = []
                shard = int(keys[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield shard, pa.Table.from_batches(held)


def points_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints as words, the sizes of the sets, and a number for each class."""
    x = np.frombuffer(b"".join(rows.column("fp").to_pylist()), ">u8").reshape(-1, WORDS).astype(np.uint64)
    number: dict[bytes, int] = {}
    names = (h or n for h, n in zip(rows.column("home").to_pylist(), rows.column("node").to_pylist()))
    homes = np.fromiter((number.setdefault(name, len(number)) for name in names), np.int64, rows.num_rows)
    return x, rows.column("n_shingles").to_numpy().astype(np.int64), homes


def in_shards(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "node")


def touched(dealt: DataFrame, similarity: float, least: float, parts: int) -> DataFrame:
    """The rows that have a candidate of another class in their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_shard(batches):
            hit = np.zeros(rows.num_rows, bool)
            for i, some in ranks_of(*points_of(rows), similarity, least):
                hit[i] = True
                hit[some] = True
            yield from rows.filter(pa.array(hit)).to_batches(4096)

    return in_shards(dealt.select(*DEALT), parts).mapInArrow(run, "shard long, node binary, home binary, fp binary, n_shingles long")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): sorted 64-bit hashes of the shingles of each text."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [distinct_hashes(shingle_hashes(t.as_py(), shingle)).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles binary")


def links(rows: DataFrame, similarity: float, least: float, parts: int) -> DataFrame:
    """(u, v): a spanning forest of the checked links between the classes of each shard; ``rows`` have ``shingles`` too."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def solve(rows: pa.Table):
        x, sizes, homes = points_of(rows)
        node = rows.column("node").to_pylist()
        ends = np.append(0, np.cumsum(sizes))
        known, codes = np.unique(np.frombuffer(b"".join(rows.column("shingles").to_pylist()), np.uint64), return_inverse=True)
        own = np.zeros(len(known), bool)
        # Rows of one class are one group from the start.
        root = np.unique(homes, return_index=True)[1][homes].tolist()

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, some in ranks_of(x, sizes, homes, similarity, least):
            mine = codes[ends[i] : ends[i + 1]]
            own[mine] = True
            for at in range(0, len(some), CHECKED):
                home = find(i)
                open_ = [j for j in some[at : at + CHECKED].tolist() if find(j) != home]
                if not open_:
                    continue
                theirs = np.concatenate([codes[ends[j] : ends[j + 1]] for j in open_])
                size = sizes[open_]
                shared = np.add.reduceat(own[theirs], np.cumsum(size) - size, dtype=np.int64)
                for j in np.asarray(open_)[shared >= similarity * (len(mine) + size - shared)].tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield max(node[i], node[j]), min(node[i], node[j])
            own[mine] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_shard(batches):
            yield to_batch(list(solve(rows)), schema)

    return in_shards(rows.select(*DEALT, "shingles"), parts).mapInArrow(run, "u binary, v binary")


def similar_groups(
    docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, least: float = LEAST, anchors: int = ANCHORS, block: int = BLOCK,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of shingle sets of ``similarity`` or more.

    Blank and null texts are copies of each other; a text with fewer words is one shingle;
    repeated rows and rows with a null doc_id stay (a group of null ids alone has none); an
    empty table gives an empty result; other columns are ignored.
    """
    rows = settle(nodes_of(docs, shingle, anchors))
    first = F.min(F.struct(F.col("doc_id"), F.col("mark"))).alias("first")
    nodes = settle(rows.groupBy("node").agg(first, F.min("doc_id").alias("least_doc"), *(F.first(c).alias(c) for c in ("fp", "n_shingles", "anchors"))))
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def checked(marked: DataFrame, parts: int) -> DataFrame:
        texts = texts_of(docs, nodes, marked.select("node").distinct())
        # Sets grow with the corpus, so they are not broadcast.
        return links(marked.join(settle(sets_of(texts, shingle)).hint("merge"), "node"), similarity, least, parts)

    grouped = settle(deal(by_tree(nodes, radius), block))
    classes = settle(components(checked(grouped, max(2 * cores, grouped.count() // (2 * block)))))
    dealt = settle(deal(by_anchors(nodes, classes), block))
    parts = max(2 * cores, dealt.count() // (2 * block))
    between = checked(settle(touched(dealt, similarity, least, parts)), parts)
    roots = settle(components(between.union(classes.select("u", F.col("root").alias("v")))))
    named = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    firsts = settle(named.join(firsts, "root").select("node", "component_id"))
    return rows.select("doc_id", "node").join(firsts, "node").select("doc_id", "component_id")


def texts_of(docs: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """(node, text) of the nodes used, one text each."""
    wanted = settle(nodes.join(used, "node", "left_semi").select("node", F.col("first.doc_id").alias("of_doc"), F.col("first.mark").alias("of_mark")))
    own = docs.select(F.col("doc_id").alias("of_doc"), F.xxhash64("text").alias("of_mark"), "text")
    hit = own["of_doc"].eqNullSafe(wanted["of_doc"]) & (own["of_mark"] == wanted["of_mark"])
    # The nodes grow with the corpus, so they are not broadcast.  Repeated rows have the same text; each gives the node once.
    return settle(own.join(wanted.hint("merge"), hit).select("node", "text").groupBy("node").agg(F.first("text").alias("text")))


def keep_first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest doc_id of each similar group; the same columns.

    A document is its doc_id: repeated rows stay or go together, and rows with a null doc_id
    stay unless each of them has a copy with an id.
    """
    groups = settle(similar_groups(docs, **options))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = settle(
        groups.groupBy(F.col("doc_id").alias("gone_id")).agg(F.bool_or(stays).alias("stays")).filter(~F.col("stays")).select("gone_id"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
