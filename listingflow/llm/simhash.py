"""SimHash near-duplicates: exact Hamming neighbours by vantage-point trees, then components.

Copies collapse to one row per fingerprint first.  A vantage-point tree grown on a bounded
sample cuts the fingerprint space into shards; *every* fingerprint is routed down it.  At a
node with vantage ``v`` and median ``m`` the triangle inequality leaves out the side a link
cannot lie on: two fingerprints within ``r`` bits have a midpoint within ``s = ceil(r / 2)`` of
both, the midpoint is on one side, and so both are within ``s`` of that side.  A fingerprint
near the boundary goes to both sides, and no pair is lost.  Inside a shard the same tree goes
on down to small leaves, which are compared as numpy blocks.  A shard gives a spanning star for
each group it finds, never pairs, and the stars are joined by large-star / small-star rounds.

Wide radii leave nothing to prune in a space where unrelated texts are half the bits apart; see
``nearcopies`` for these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import ship, to_batch

ship(__name__)

SEED, SAMPLE, SHARD_ROWS, LEAF = 42, 8192, 20_000, 128
FLUSH, PIECE, DOCS = 1 << 20, 1 << 12, 256
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)  # constants of the splitmix64 generator


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a shorter text is one shingle."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[min(size, len(words)) :])], np.uint64)


def distinct_hashes(h: np.ndarray) -> np.ndarray:
    """Sorted, each once; sorting in place of ``np.unique``'s own table takes a fifth of the time."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def remix(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash derived from a hash; the 0th is the hash itself."""
    if not i:
        return h
    x = h + np.uint64(MIX[2] * i & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def fingerprints_of(sets: Sequence[np.ndarray], words: int = 1, anchors: int = 0) -> tuple[list[bytes], list[list[int]]]:
    """Fingerprint and least derived hashes of each set of hashes.

    A fingerprint is big-endian words whose bits are 1 if set in over half of the hashes; zero for
    none.  A set has ``anchors`` least hashes, none if it is empty.  All sets are taken together,
    in pieces that fit the cache.
    """
    full = np.flatnonzero([len(h) for h in sets])
    sizes = np.array([len(sets[k]) for k in full], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, np.uint64)
    count = np.zeros((len(full), words * 64), np.int64)
    least = np.full((len(full), anchors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(flat), PIECE):
        piece = flat[at : at + PIECE]
        own = range(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(piece), "left") + 1)
        starts = np.maximum(ends[own] - sizes[own] - at, 0)
        bits = np.unpackbits(np.stack([remix(piece, i) for i in range(words)], axis=1).astype(">u8").view(np.uint8), axis=1)
        for k, a, b in zip(own, starts.tolist(), [*starts[1:].tolist(), len(piece)]):
            count[k] += bits[a:b].sum(axis=0, dtype=np.uint16)  # a piece has fewer rows than that holds
        for i in range(anchors):
            least[own, i] = np.minimum(least[own, i], np.minimum.reduceat(remix(piece, 100 + i), starts))
    ones = np.packbits(count * 2 > sizes[:, None], axis=1)
    found, mins = [bytes(8 * words)] * len(sets), [[] for _ in sets]
    for k, fp, some in zip(full.tolist(), ones, least.astype(np.int64).tolist()):
        found[k], mins[k] = fp.tobytes(), some
    return found, mins


def fingerprint(h: np.ndarray, words: int = 1) -> bytes:
    """Fingerprint of one set of hashes."""
    return fingerprints_of([h], words)[0][0]


def fingerprints(
    docs: DataFrame, *, shingle: int = 3, words: int = 1, distinct: bool = False, anchors: int = 0,
) -> DataFrame:
    """(doc_id, fp, n_shingles, anchors) of every row; null and blank texts have fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("n_shingles", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                sets = [shingle_hashes(text.as_py(), shingle) for text in part.column(1).cast(pa.binary())]
                if distinct:
                    sets = [distinct_hashes(h) for h in sets]
                fps, mins = fingerprints_of(sets, words, anchors)
                yield to_batch(list(zip(part.column(0).to_pylist(), fps, map(len, sets), mins)), schema)

    return docs.select("doc_id", "text").mapInArrow(
        compute, "doc_id long, fp binary, n_shingles long, anchors array<long>"
    )


# ------------------------------------------------------------------ inside one task
def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words, broadcast; added word by word, which needs no sum over a short axis."""
    total = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for w in range(1, x.shape[-1]):
        total += np.bitwise_count(x[..., w] ^ y[..., w])
    return total


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; ``root`` points at the smallest member of each group."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def split_at(x: np.ndarray, slack: int) -> tuple[np.ndarray, int, float]:
    """(vantage, radius, work left of 1): the best of a few vantages and of radii near the median."""
    some = x[:: max(1, len(x) // 512)]
    vantages = some[:: max(1, len(some) // 8)]
    d = np.sort(distances(vantages[:, None], some[None]), axis=1)
    radii = d[:, [int(q * (len(some) - 1)) for q in (0.3, 0.4, 0.5, 0.6, 0.7)]]
    inner = (d[:, None] <= radii[..., None] + slack).mean(axis=2)
    outer = (d[:, None] > radii[..., None] - slack).mean(axis=2)
    work = inner**2 + outer**2
    v, q = np.unravel_index(work.argmin(), work.shape)
    return vantages[v], int(radii[v, q]), float(work[v, q])


def groups_of(x: np.ndarray, linked: Callable, slack: int | None) -> np.ndarray:
    """Group (position of its smallest member) of each row of ``x``.

    ``linked(d, i, j)`` says which pairs link.  With a ``slack`` only pairs within twice that
    distance can, and a vantage-point tree leaves out the others.
    """
    root = np.arange(len(x))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        if found:
            unite(root, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            found.clear()

    held = 0
    stack = [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) > LEAF and slack is not None:
            v, m, work = split_at(x[rows], slack)
            if work < 0.9:
                d = distances(x[rows], v)
                stack += [rows[d <= m + slack], rows[d > m - slack]]
                continue
        for at in range(0, len(rows), LEAF):
            top = rows[at : at + LEAF]
            for to in range(at, len(rows), 8 * LEAF):
                side = rows[to : to + 8 * LEAF]
                hit = linked(distances(x[top, None], x[None, side]), top[:, None], side[None, :])
                i, j = np.nonzero(hit & (root[top][:, None] != root[side][None, :]))
                if len(i):
                    found.append((top[i], side[j]))
                    held += len(i)
                    if held > FLUSH:
                        flush()
                        held = 0
    flush()
    return root


def stars(rows: DataFrame, words: int, linked: Callable, slack: int | None, parts: int = 0) -> DataFrame:
    """(u, v) edges that span the groups of each shard; ``rows`` are (shard, fp, n_shingles).

    The cost of a shard is its pairs, not its bytes, so the caller says into how many
    ``parts`` they are dealt (one per core at least).
    """
    parts = max(parts, rows.sparkSession.sparkContext.defaultParallelism * 2)
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def solve(fps: list[bytes], sizes: np.ndarray):
        x = np.frombuffer(b"".join(fps), ">u8").reshape(-1, words).astype(np.uint64)
        root = groups_of(x, lambda d, i, j: linked(d, sizes[i], sizes[j]), slack)
        for i in np.flatnonzero(root != np.arange(len(root))):
            yield fps[i], fps[root[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fps, sizes = None, [], []
        for batch in batches:
            out = []
            keys = batch.column(0).to_pylist()
            values, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[a] != shard:
                    if len(fps) > 1:
                        out += solve(fps, np.asarray(sizes))
                    shard, fps, sizes = keys[a], [], []
                fps += values[a:b]
                sizes += counts[a:b]
            yield to_batch(out, schema)
        if len(fps) > 1:
            yield to_batch(list(solve(fps, np.asarray(sizes))), schema)

    dealt = rows.select("shard", "fp", "n_shingles").repartition(parts, "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, "u binary, v binary")


# ------------------------------------------------------------------ across tasks
def grow_tree(sample: np.ndarray, slack: int, leaf: int):
    """Nested (vantage, radius, inside, outside) over a sample; None where it stops."""
    if len(sample) <= leaf:
        return None
    v, m, work = split_at(sample, slack)
    if work >= 0.9:
        return None
    d = distances(sample, v)
    inner, outer = sample[d <= m + slack], sample[d > m - slack]
    return v, m, grow_tree(inner, slack, leaf), grow_tree(outer, slack, leaf)


def route(fps: DataFrame, tree, words: int, slack: int) -> DataFrame:
    """(shard, fp, n_shingles): every fingerprint in each shard that one of its links may lie in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
            stack = [(tree, np.arange(len(x)), 1)]
            while stack:
                node, rows, name = stack.pop()
                if node is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), name), pa.int64()), *(c.take(pa.array(rows)) for c in batch.columns)],
                        ["shard", "fp", "n_shingles"],
                    )
                elif len(rows):
                    d = distances(x[rows], node[0])
                    stack += [(node[2], rows[d <= node[1] + slack], 2 * name), (node[3], rows[d > node[1] - slack], 2 * name + 1)]

    return fps.select("fp", "n_shingles").mapInArrow(run, "shard long, fp binary, n_shingles long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that is not the smallest of its component.

    Alternating large-star and small-star rounds until the edges stand still; each round is
    written to the shared folder.  Aggregates are partial, and the written edges are joined by
    plain exchanges, so a node with very many edges can be split.
    """
    edges = settle(edges.filter(~F.col("u").eqNullSafe(F.col("v"))).distinct())
    state = None
    while True:
        sums = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sums) == state or not sums[0]:
            return edges.select("u", F.col("v").alias("root"))
        state = tuple(sums)
        both = edges.union(edges.select("v", "u"))
        # Both sides of the joins are written: plain exchanges, which AQE can split at a hot node.
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(rest.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def with_components(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, …) with ``component_id``, the smallest doc_id of the component."""
    roots = components(edges)
    lead = distinct.select("fp", "first_doc")
    named = lead.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    firsts = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # Written, so that the joins below have plain exchanges and known sizes.
    firsts = settle(named.join(firsts, "root").select("fp", "component_id"))
    return rows.join(firsts, "fp")


def distinct_fingerprints(rows: DataFrame, *extra: Column) -> DataFrame:
    return rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), *extra)


def hamming_edges(unique: DataFrame, *, radius: int = 2, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) edges that span the groups of the 64-bit fingerprints ``unique`` (fp, n_shingles), written, that link within ``radius`` bits.

    ``sample`` fingerprints shape the routing tree; all are routed and compared, exactly.
    """
    slack = -(-radius // 2)
    n = unique.count()
    picked = unique.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()
    x = np.frombuffer(b"".join(bytes(r["fp"]) for r in picked), ">u8").reshape(-1, 1).astype(np.uint64)
    leaf = max(16, int(len(x) * shard_rows / max(n, 1)))
    routed = route(unique, grow_tree(x, slack, leaf), 1, slack)
    return stars(routed, 1, lambda d, a, b: d <= radius, slack, parts=4 * n // shard_rows)


def hamming_groups(
    docs: DataFrame, *, shingle: int = 3, radius: int = 2, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link within ``radius`` bits.

    ``sample`` fingerprints shape the routing tree; all are indexed and compared, exactly.
    Repeated rows and rows with a null doc_id stay (a component of null ids alone has none);
    other columns are ignored; an empty table gives an empty result.
    """
    rows = settle(fingerprints(docs, shingle=shingle).select("doc_id", "fp"))
    unique = settle(distinct_fingerprints(rows).withColumn("n_shingles", F.lit(0).cast("long")))
    edges = hamming_edges(unique, radius=radius, sample=sample, shard_rows=shard_rows)
    return with_components(rows, unique, edges).select("doc_id", "fp", "component_id")
