"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad.  Features are character classes, words, shape and
repeats of the line and of its two neighbours; two transition weights per label tie adjacent
lines.  Forward-backward gives the probability that a line is good, and a document's score is
the mean of these weighted by line length.

Fitting uses a bounded sample of labelled documents (``max_docs``, ``max_lines`` each) and
plain numpy on the driver; scoring is a map over all rows, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, to_batch

ship(__name__)

MAX_DOCS, MAX_LINES, STEPS, RATE, RIDGE, THRESHOLD = 4000, 512, 300, 0.1, 1e-3, 0.7
CHARS = 4_000_000  # scored at a time

(SPACE, LOWER, UPPER, DIGIT, SYMBOL, BANG, PIPE, STOP, OTHER) = range(9)
KINDS = 9


def _classes() -> np.ndarray:
    """Class of every code point of the first plane."""
    out = np.full(0x10000, OTHER, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            out[c] = SPACE
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch.isupper():
            out[c] = UPPER
        elif ch.isalpha():
            out[c] = LOWER
    for ch in "#*$%&<>@^~_=+\\/{}[]":
        out[ord(ch)] = SYMBOL
    out[ord("!")], out[ord("|")] = BANG, PIPE
    for ch in ".,;:?":
        out[ord(ch)] = STOP
    return out


class LineFeatures:
    """``of(texts)``: (feature matrix of all lines, first line of each text, length of each line)."""

    NEIGHBOUR = 8

    def __init__(self):
        self.classes = _classes()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes[np.minimum(codes, 0xFFFF)]
        ends = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts
        line = np.repeat(np.arange(len(ends)), size + 1)
        counts = np.bincount(line * KINDS + kind, minlength=len(ends) * KINDS).reshape(-1, KINDS).astype(float)
        counts[:, SPACE] -= 1  # the line feed itself
        solid = kind != SPACE
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        words = np.bincount(line[opens], minlength=len(ends)).astype(float)
        n_lines = np.array([t.count("\n") + 1 for t in texts])
        first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
        repeated = self._repeated(texts)
        some, letters = np.maximum(size, 1), np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
        last = kind[np.maximum(ends - 1, starts)]
        shares = counts / some[:, None]
        own = np.stack([
            shares[:, SYMBOL], counts[:, UPPER] / letters, shares[:, BANG], shares[:, PIPE], repeated,
            self._stutter(codes, solid, opens, line, len(ends)) / np.maximum(words, 1),
            np.minimum(counts[:, SYMBOL] / np.maximum(words, 1), 4), np.minimum(counts[:, PIPE] / np.maximum(words, 1), 1),
            shares[:, STOP], shares[:, DIGIT], shares[:, SPACE], shares[:, OTHER], np.log1p(size) / 6, np.log1p(words) / 5,
            np.minimum((size - counts[:, SPACE]) / np.maximum(words, 1), 30) / 10,
            (last == STOP) | (last == BANG), kind[starts] == UPPER, size == 0,
            shares[:, SYMBOL] > 0.02, shares[:, BANG] > 0.02, shares[:, PIPE] > 0.02, counts[:, UPPER] / letters > 0.5,
        ], axis=1).astype(float)
        near = own[:, : self.NEIGHBOUR]
        before, after = np.zeros_like(near), np.zeros_like(near)
        before[1:], after[:-1] = near[:-1], near[1:]
        last_line = first + n_lines - 1
        before[first], after[last_line] = 0, 0
        edge = np.zeros((len(ends), 3))
        edge[:, 0] = 1
        edge[first, 1] = 1
        edge[last_line, 2] = 1
        return np.concatenate([own, before, after, edge], axis=1), first, size

    def _stutter(self, codes, solid, opens, line, n_lines: int) -> np.ndarray:
        """Words of each line that equal the word before, by a hash of their letters."""
        at = np.flatnonzero(opens)
        if len(at) < 2:
            return np.zeros(n_lines)
        runs = at if at[0] == 0 else np.append(0, at)
        place = np.arange(len(codes)) - np.repeat(runs, np.diff(np.append(runs, len(codes))))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        name = np.add.reduceat(np.where(solid, mixed, np.uint64(0)), at)
        same = (name[1:] == name[:-1]) & (line[at[1:]] == line[at[:-1]])
        return np.bincount(line[at[1:][same]], minlength=n_lines).astype(float)

    def _repeated(self, texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            lines = text.split("\n")
            if len(lines) == 1 or len(set(lines)) == len(lines):
                out.append(np.zeros(len(lines)))
            else:
                seen: set[str] = set()
                out.append(np.array([bool(x.strip()) and (x in seen or seen.add(x) is not None) for x in lines], float))
        return np.concatenate(out) if out else np.zeros(0)


class Chain:
    """Weights of the field: ``node`` for the label good (bad has none), ``step[i, j]`` from i to j."""

    def __init__(self, node: np.ndarray, step: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.node, self.step, self.mean, self.scale = node, step, mean, scale

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.node

    def marginals(self, good: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(line is good), summed pair probabilities, summed log partition) of chains that begin at ``first``.

        All chains move on together, the longest first, one line a step.
        """
        n = len(good)
        sizes = np.diff(np.append(first, n))
        order = np.argsort(-sizes, kind="stable")
        begin, falling = first[order], -sizes[order]
        score = np.stack([np.zeros(n), good], axis=1)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[begin] = score[begin]
        top = int(sizes.max(initial=0))
        live = [int(np.searchsorted(falling, -t, side="left")) for t in range(top + 1)]  # chains longer than t
        for t in range(1, top):
            at = begin[: live[t]] + t
            into = ahead[at - 1][:, :, None] + self.step
            ahead[at] = np.logaddexp(into[:, 0], into[:, 1]) + score[at]
        for t in range(top - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            out = self.step + (score[at + 1] + back[at + 1])[:, None, :]
            back[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        final = begin - falling - 1
        total = np.logaddexp(ahead[final, 0], ahead[final, 1])
        chain_total = np.empty(len(first))
        chain_total[order] = total
        per_line = np.repeat(chain_total, sizes)
        p = np.exp(ahead + back - per_line[:, None])
        inner = np.ones(n, bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        pair = np.exp(ahead[j - 1][:, :, None] + self.step + (score[j] + back[j])[:, None, :] - per_line[j][:, None, None])
        return np.clip(p[:, 1] / np.maximum(p.sum(axis=1), 1e-300), 0, 1), pair.sum(axis=0), float(total.sum())


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, *, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Chain:
    """Maximum likelihood by Adam; every line of a document has the document's label."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1
    mean = np.where(features.std(axis=0) < 1e-9, 0, mean)  # the constant stays 1
    x = (features - mean) / scale
    n = len(x)
    inner = np.ones(n, bool)
    inner[first] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[j - 1], label[j]), 1)
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale)
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, steps + 1):
        p, pair, _ = chain.marginals(x @ chain.node, first)
        slope = np.concatenate([x.T @ (label - p), (seen - pair).ravel()]) / n
        slope -= ridge * np.concatenate([chain.node, chain.step.ravel()])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        chain.node += move[:-4]
        chain.step += move[-4:].reshape(2, 2)
    return chain


def portions(texts: list[str], rows: int = 512, chars: int = CHARS) -> Iterator[list[str]]:
    """Runs of texts, bounded in rows and characters; a longer text is a run of its own."""
    held, size = [], 0
    for text in texts:
        if held and (len(held) == rows or size + len(text) > chars):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Chain | None:
    """The field fitted to at most ``max_docs`` labelled documents that are not held out.

    The sample is the labelled ids of ``docs`` with the smallest hashes; of a training document
    with more than ``max_lines`` lines a run of so many counts, which begins at a line picked by
    the id's hash.  Null labels and ids are left out, labels without a document do not count,
    conflicting labels of one id count as the lower one.  Without any labelled document there
    is no model.
    """
    wanted = (
        labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.int32()), ("features", pa.binary())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = LineFeatures()
        for batch in batches:
            rows = []
            for doc_id, text, quality in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = (text or "").split("\n")
                begin = zlib.crc32(str(doc_id).encode()) % (max(len(own) - max_lines, 0) + 1)
                f, _, _ = maker.of(["\n".join(own[begin : begin + max_lines])])
                rows.append((doc_id, int(quality > 0), len(f), f.astype("<f4").tobytes()))
            yield to_batch(rows, schema)

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most max_docs pairs of numbers
        .select("doc_id", "text", "quality")
        .mapInArrow(lines, "doc_id long, quality int, lines int, features binary")
        .dropDuplicates(["doc_id"]).collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    counts = np.array([r["lines"] for r in rows])
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), "<f4").reshape(counts.sum(), -1).astype(float)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return fit(features, first, np.repeat([r["quality"] for r in rows], counts))


def score_documents(docs: DataFrame, chain: Chain | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (columns of these names are replaced).

    Null and empty texts are one empty line and scored as such.  Without a model nothing speaks
    against a document: its score is 1.
    """
    if chain is None:
        return docs.withColumn("score", F.lit(1.0)).withColumn("predicted", F.lit(1))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        maker = LineFeatures()
        for texts in batches:
            parts = []
            for some in portions([t or "" for t in texts]):
                f, first, size = maker.of(some)
                p, _, _ = chain.marginals(chain.potentials(f), first)
                weight = size + 1.0
                parts.append(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
