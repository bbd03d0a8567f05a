"""Language-model scores by deleted interpolation (Jelinek and Mercer).

The model mixes maximum-likelihood estimates of word n-grams, from ``order`` words down to one
and the uniform distribution.  How much each order counts depends on how often its context was
seen: contexts fall into buckets of doubling frequency, and each bucket of each order has a
weight of its own.  A part of the training documents is deleted from the counts, and the weights
are learned on that part by expectation-maximisation; the deleted documents are then counted in.

No table of n-grams is sent to the tasks, for it grows with the corpus.  Documents are packed
into chunks; a chunk asks for the counts of its distinct n-grams in sorted arrays of 64-bit
hashes, cut by their leading bits into buckets, and with what it asks it tells its own counts.
So one exchange both counts the corpus and finds out who wants to know: a bucket adds up the
arrays of all chunks and answers each in its own order.  A very frequent n-gram is one entry per
chunk.  With the answers each chunk writes the counts of its words; learning reads those of the
deleted part, scoring those of all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import ship

ship(__name__)

ORDER, CHUNK_BYTES, BUCKET_ENTRIES, BYTES_A_WORD = 2, 12 << 20, 1 << 21, 6
HELD, MAIN, DELETED = 0, 1, 2
MODULUS, HELD_OUT, DELETED_PART = 7, 2, 3
ROUNDS, GAIN, CLASSES = 25, 1e-5, 65
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # constants of the splitmix64 generator
END, BEGIN = b" end", b" begin"  # no word has a space


# ------------------------------------------------------------------ arrays as bytes
def squeeze(x: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
    planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.compress(planes.tobytes(), 1)


def unsqueeze(raw: bytes) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64 if size < 8 else np.uint64)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unsqueeze_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw).astype(np.uint64), dtype=np.uint64)


# ------------------------------------------------------------------ chunks of documents
def squeeze_texts(texts: list[bytes]) -> bytes:
    """Copies in one chunk lie far apart, so they are looked for in all of it."""
    asked = zstandard.ZstdCompressionParameters.from_level(6, enable_ldm=True, window_log=24)
    return zstandard.ZstdCompressor(compression_params=asked).compress(b"".join(texts))


def part_of(doc_id: int | None) -> int:
    """Held out, deleted from the counts while the weights are learned, or the rest; by the hash of the id."""
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS
    return HELD if rest == HELD_OUT else DELETED if rest == DELETED_PART else MAIN


def pack(docs: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, texts, n_bytes): documents in chunks; a longer one is a chunk of its own."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("texts", pa.binary()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            row = ((task << 32) + number, ids, squeeze(np.array([len(t) for t in texts])), squeeze_texts(texts), size)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if ids and size + len(text) > CHUNK_BYTES:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, ids array<long>, sizes binary, texts binary, n_bytes long")


def combine(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(MIX[0]) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word and end mark, number of tokens of each text)."""
    known: dict[bytes, int] = {END: 0}
    codes, sizes = [], []
    for text in texts:
        words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        codes.append(np.zeros(1, np.int64))
        sizes.append(len(words) + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return hashes[np.concatenate(codes)], np.array(sizes)


def grams_of(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The hash of the n-gram that ends at each token, for n = 1 to ``order``, and the tokens of each text."""
    word, sizes = words_of(texts)
    first = np.cumsum(sizes) - sizes
    grams = [word]
    for n in range(2, order + 1):
        before = np.roll(grams[-1], 1)
        before[first] = xxhash.xxh64_intdigest(BEGIN, seed=n)
        grams.append(combine(before, word))
    return grams, sizes


def texts_of(sizes: bytes, texts: bytes) -> list[bytes]:
    whole, ends = zstandard.decompress(texts), np.cumsum(unsqueeze(sizes)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


# ------------------------------------------------------------------ counts
def ask(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, chunk, keys, main, deleted): distinct n-grams of each chunk and how often its training documents have them."""
    schema = pa.schema([
        ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("main", pa.binary()), ("deleted", pa.binary())])
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, sizes = grams_of(texts_of(row["sizes"], row["texts"]), order)
                part = np.repeat([part_of(i) for i in row["ids"]], sizes)
                for n, gram in enumerate(grams):
                    keys, at = np.unique(gram, return_inverse=True)
                    counts = [np.bincount(at[part == p], minlength=len(keys)) for p in (MAIN, DELETED)]
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    rows = [
                        ((n << bits) + b, row["chunk"], squeeze_sorted(keys[x:y]), squeeze(counts[0][x:y]), squeeze(counts[1][x:y]))
                        for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return chunks.select("chunk", "ids", "sizes", "texts").mapInArrow(
        run, "bucket long, chunk long, keys binary, main binary, deleted binary")


ANSWER = "chunk long, bucket long, counts binary, main binary, types long, main_types long"


def answer(asked: pa.Table) -> pa.Table:
    """Summed counts of one bucket, for each chunk in the order of its keys, and those without the deleted part
    for its deleted keys; the numbers of distinct n-grams go to one chunk."""
    columns = [asked.column(c).to_pylist() for c in ("chunk", "keys", "main", "deleted")]
    keys = [unsqueeze_sorted(x) for x in columns[1]]
    some, at = np.unique(np.concatenate(keys), return_inverse=True)
    main = np.bincount(at, np.concatenate([unsqueeze(x) for x in columns[2]]), len(some)).astype(np.int64)
    both = main + np.bincount(at, np.concatenate([unsqueeze(x) for x in columns[3]]), len(some)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys]).tolist()
    bucket, rows = asked.column("bucket")[0].as_py(), []
    for i, (chunk, x, y) in enumerate(zip(columns[0], [0, *ends], ends)):
        types = (int((both > 0).sum()), int((main > 0).sum())) if i == 0 else (0, 0)
        own = at[x:y]
        rows.append((chunk, bucket, squeeze(both[own]), squeeze(main[own[unsqueeze(columns[3][i]) > 0]]), *types))
    names = [c.split()[0] for c in ANSWER.split(", ")]
    return pa.table({n: pa.array(c, pa.binary() if n in ("counts", "main") else pa.int64()) for n, c in zip(names, zip(*rows))})


COUNTED = (
    "chunk long, ids array<long>, sizes binary, counts binary, deleted_sizes binary, deleted_counts binary, "
    "types long, main_types long, docs long, main_docs long, tokens long, main_tokens long"
)


def counted(order: int, bits: int):
    """The counts of all n-grams that end at each token of a chunk, and those without the deleted part at its deleted tokens."""
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        out = []
        for chunk in chunks.to_pylist():
            grams, sizes = grams_of(texts_of(chunk["sizes"], chunk["texts"]), order)
            parts = np.array([part_of(i) for i in chunk["ids"]])
            part = np.repeat(parts, sizes)
            every, main = [], []
            for n, gram in enumerate(grams):
                mine = [r for r in rows if r["bucket"] >> bits == n]
                at = np.unique(gram, return_inverse=True)[1]
                every.append(np.concatenate([unsqueeze(r["counts"]) for r in mine])[at])
                some, where = np.unique(at[part == DELETED], return_inverse=True)
                found = np.concatenate([unsqueeze(r["main"]) for r in mine])
                assert len(found) == len(some), "a chunk and the answer to it differ"
                main.append(found[where])
            first = [r for r in rows if r["bucket"] >> bits == 0]
            out.append((
                chunk["chunk"], chunk["ids"], squeeze(sizes), squeeze(np.concatenate(every)),
                squeeze(sizes[parts == DELETED]), squeeze(np.concatenate(main)),
                sum(r["types"] for r in first), sum(r["main_types"] for r in first),
                int((parts != HELD).sum()), int((parts == MAIN).sum()), int((part != HELD).sum()), int((part == MAIN).sum()),
            ))
        names = [c.split()[0] for c in COUNTED.split(", ")]
        kinds = {"ids": pa.list_(pa.int64()), **{n: pa.binary() for n in ("sizes", "counts", "deleted_sizes", "deleted_counts")}}
        columns = zip(*out) if out else [[] for _ in names]
        return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)})

    return run


def count_all(docs: DataFrame, order: int) -> DataFrame:
    """One row per chunk with the counts its words have in the whole corpus (``COUNTED``)."""
    chunks = settle(pack(docs))
    n_chunks, n_bytes = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / BYTES_A_WORD / BUCKET_ENTRIES))))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    asked = ask(chunks, order, bits)
    answers = asked.repartition(max(cores, order << bits), "bucket").groupBy("bucket").applyInArrow(answer, ANSWER)
    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return settle(both.applyInArrow(counted(order, bits), COUNTED))


# ------------------------------------------------------------------ the mixture
def estimates(counts: np.ndarray, sizes: np.ndarray, docs: int, tokens: int):
    """For each order: (bucket of the context, maximum-likelihood estimate) of every token."""
    first = np.cumsum(sizes) - sizes
    for n, count in enumerate(counts):
        if n:
            context = np.roll(counts[n - 1], 1)
            context[first] = docs
        else:
            context = np.full(len(count), tokens)
        bucket = np.frexp(context.astype(float))[1]  # 0 where the context is new
        yield bucket, np.divide(count, context, out=np.zeros(len(count)), where=context > 0)


def mixed(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, docs: int, tokens: int, types: int) -> np.ndarray:
    """The probability of every token."""
    p = np.full(counts.shape[1], 1 / (types + 1))
    for weight, (bucket, f) in zip(weights, estimates(counts, sizes, docs, tokens)):
        w = weight[bucket]
        p = w * f + (1 - w) * p
    return p


def expect(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, docs: int, tokens: int, types: int):
    """(what each weight got, what it could get, log likelihood) over the tokens given."""
    p, levels = np.full(counts.shape[1], 1 / (types + 1)), []
    for weight, (bucket, f) in zip(weights, estimates(counts, sizes, docs, tokens)):
        w = weight[bucket]
        own = w * f
        p = own + (1 - w) * p
        levels.append((bucket, own / p))
    got, able, rest = np.zeros_like(weights), np.zeros_like(weights), np.ones(len(p))
    for n in range(len(weights) - 1, -1, -1):
        bucket, share = levels[n]
        got[n] = np.bincount(bucket, rest * share, CLASSES)
        able[n] = np.bincount(bucket, rest, CLASSES)
        rest = rest * (1 - share)
    return got, able, float(np.log(p).sum())


def blank(order: int) -> np.ndarray:
    """Even weights; a context never seen has none."""
    weights = np.full((order, CLASSES), 0.5)
    weights[:, 0] = 0
    return weights


def learn(rows: DataFrame, order: int, docs: int, tokens: int, types: int) -> np.ndarray:
    """Weights by expectation-maximisation over all deleted documents; each round is a pass of partial sums."""
    schema = pa.schema([("place", pa.int32()), ("got", pa.float64()), ("able", pa.float64()), ("log_p", pa.float64()), ("n", pa.int64())])
    weights, before = blank(order), None
    for _ in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            got, able, log_p, n = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0
            for batch in batches:
                for sizes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sizes, counts = unsqueeze(sizes), unsqueeze(counts).reshape(order, -1)
                    if len(sizes):
                        g, a, lp = expect(weights, counts, sizes, docs, tokens, types)
                        got, able, log_p, n = got + g, able + a, log_p + lp, n + counts.shape[1]
            used = np.flatnonzero(able)
            once = [log_p, *[0.0] * len(used)], [n, *[0] * len(used)]
            columns = [np.append(-1, used), np.append(0.0, got.ravel()[used]), np.append(0.0, able.ravel()[used]), *once]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        parts = rows.select("deleted_sizes", "deleted_counts").mapInArrow(run, "place int, got double, able double, log_p double, n long")
        # At most one row for each weight comes back; the sums of all tokens stand at place -1.
        sums = {r["place"]: r for r in parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("got", "able", "log_p", "n"))).collect()}
        total = sums.pop(-1, None)
        if total is None or not total["n"]:
            return weights
        got, able = np.zeros(weights.size), np.zeros(weights.size)
        for place, r in sums.items():
            got[place], able[place] = r["got"], r["able"]
        got, able = got.reshape(weights.shape), able.reshape(weights.shape)
        weights = (got + 0.5) / (able + 1)  # half a success and half a failure more, so that none is 0 or 1
        for b in range(2, CLASSES):  # a bucket the deleted part doesn't have is like the one below
            weights[:, b] = np.where(able[:, b] > 0, weights[:, b], weights[:, b - 1])
        weights[:, 0] = 0
        mean = total["log_p"] / total["n"]
        if before is not None and mean - before < GAIN:
            break
        before = mean
    return weights


def score_documents(docs: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Documents whose crc32(doc_id) mod 7 is 2 are held out and never counted.  Null texts are
    empty, and an empty text is its end mark alone; a null doc_id hashes as an empty text;
    repeated rows count and are scored each for itself; an empty table gives an empty result;
    other columns are ignored.  Without deleted documents all weights are even.
    """
    rows = count_all(docs, order)
    names = ("types", "main_types", "docs", "main_docs", "tokens", "main_tokens")
    types, main_types, n_docs, main_docs, tokens, main_tokens = (int(x or 0) for x in rows.agg(*(F.sum(n) for n in names)).first())
    weights = learn(rows, order, main_docs, main_tokens, main_types)
    if not tokens:
        weights = np.zeros_like(weights)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, counts = unsqueeze(sizes), unsqueeze(counts).reshape(order, -1)
                first = np.cumsum(sizes) - sizes
                p = mixed(weights, counts, sizes, n_docs, tokens, types)
                known = np.add.reduceat(counts[0] > 0, first, dtype=np.int64)
                base = np.add.reduceat(np.log10((counts[0] + 1) / (tokens + types + 1)), first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([part_of(i) == HELD for i in ids]), pa.array(sizes), pa.array(known),
                    pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), first)),
                ], schema=schema)

    return rows.select("ids", "sizes", "counts").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
