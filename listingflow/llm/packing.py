"""Vector bin packing of training examples into sequences of fixed length.

Each example asks for tokens, segments and loss-bearing tokens, and each sequence has a limit
for all three.  The dot-product heuristic fills one sequence at a time: of the waiting examples
that fit, the one whose demand (as shares of the limits) has the largest dot product with what
is left goes in, so an example that uses up a scarce dimension is not put where that dimension
is nearly gone.

A task packs what its partition holds, in one pass, with ``pool`` waiting examples in memory;
there is no shuffle.  Input splits are fixed, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_batch, ship
from .tokenizing import Tokenize, default_tokenizer

ship(__name__)

MAX_TOKENS, MAX_SEGMENTS, POOL, END_ID = 2048, 256, 512, 1

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padding", pa.int64()),
])
PLACED = pa.schema([
    ("example_id", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("segment", pa.int64()), ("fits", pa.bool_()),
])


class Pool:
    """Waiting examples; ``best`` is the fitting one with the largest dot product."""

    def __init__(self, limits: Iterable[int], size: int):
        self.limits = np.asarray(list(limits), float)
        self.size = size
        self.demand = np.zeros((size, len(self.limits)))
        self.items: list = [None] * size
        self.free = list(range(size))
        heapq.heapify(self.free)  # slots in a fixed order: the same input gives the same result

    def __len__(self) -> int:
        return self.size - len(self.free)

    def add(self, item, demand) -> None:
        slot = heapq.heappop(self.free)
        self.items[slot] = item
        self.demand[slot] = demand

    def take(self, slot: int):
        item, self.items[slot] = self.items[slot], None
        self.demand[slot] = 0
        heapq.heappush(self.free, slot)
        return item

    def best(self, left: np.ndarray) -> int:
        """Slot of the example to place, or -1.  Ties: the lowest slot."""
        fits = (self.demand <= left).all(axis=1) & (self.demand[:, 0] > 0)
        if not fits.any():
            return -1
        score = (self.demand / self.limits) @ (left / self.limits)
        return int(np.where(fits, score, -1.0).argmax())

    def largest(self) -> int:
        return int(self.demand[:, 0].argmax()) if len(self) else -1


def pack_streams(streams: Iterable[tuple[int, int]], *, max_tokens: int, max_segments: int, pool: int) -> Iterator[list]:
    """Sequences as lists of (key, start, length) from (key, number of tokens), cut where that saves padding.

    Every token of a document bears loss, so its token and loss demands are equal.  Whole
    sequences are cut off long documents.  When no waiting example fits, the largest is cut to
    fill the gap.  What is left at the end is cut into powers of two, which need no padding.
    """
    waiting = Pool((max_tokens, max_segments, max_tokens), pool)
    source = iter(streams)
    more = True
    while True:
        while more and len(waiting) < pool:
            got = next(source, None)
            if got is None:
                more = False
                break
            key, size = got
            start = 0
            while size - start >= max_tokens:
                yield [(key, start, max_tokens)]
                start += max_tokens
            if size > start:
                waiting.add((key, start, size - start), (size - start, 1, size - start))
        if not len(waiting):
            return
        left = waiting.limits.copy()
        sequence: list = []
        while left[0] and left[1] and len(waiting):
            slot = waiting.best(left)
            if slot >= 0:
                key, start, size = waiting.take(slot)
            else:
                slot = waiting.largest()
                key, start, whole = waiting.take(slot)
                size = int(left[0])
                rest = whole - size
                waiting.add((key, start + size, rest), (rest, 1, rest))
            sequence.append((key, start, size))
            left -= (size, 1, size)
        if left[0] and not more and not len(waiting):
            yield from powers_of_two(sequence)
        else:
            yield sequence


def powers_of_two(sequence: list) -> Iterator[list]:
    """The pieces of one sequence as sequences whose lengths are the powers of two in its length."""
    total = sum(size for _, _, size in sequence)
    pieces = list(sequence)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            key, start, size = pieces.pop(0)
            now = min(size, room)
            out.append((key, start, now))
            if now < size:
                pieces.insert(0, (key, start + now, size - now))
            room -= now
        yield out


def pack_documents(
    docs: DataFrame, *, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS, pool: int = POOL, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text), placed in sequences.

    A document is its ids and ``end_id``; a null text has that id alone.  Rows: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, padding (of the whole sequence).
    Repeated rows are packed each for itself; a null doc_id stays null; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenize(path)
        held: dict[int, list] = {}  # ordinal -> [doc_id, ids, ids not yet placed]

        def streams():
            at = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    ids = np.append(encode.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                    held[at] = [doc_id.as_py(), ids, len(ids)]
                    yield at, len(ids)
                    at += 1

        def rows():
            number = TaskContext.get().partitionId() << 40
            for sequence in pack_streams(streams(), max_tokens=max_tokens, max_segments=max_segments, pool=pool):
                used = sum(size for _, _, size in sequence)
                padding = 0 if used & (used - 1) == 0 else max_tokens - used
                offset = 0
                for key, start, size in sequence:
                    doc = held[key]
                    crc = zlib.crc32(doc[1][start : start + size].tobytes())
                    yield doc[0], start, size, crc, len(doc[1]), number, offset, padding
                    offset += size
                    doc[2] -= size
                    if not doc[2]:
                        del held[key]
                number += 1

        yield from by_batch(rows(), PIECES)

    return docs.select("doc_id", "text").mapInArrow(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
    )


def pack_examples(
    examples: DataFrame, *, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None, pool: int = POOL,
) -> DataFrame:
    """Uncut instruction examples (example_id, tokens, loss_tokens) placed under all three limits.

    An example over a limit by itself is returned with ``fits`` false and no place; nulls count
    as 0 tokens; an example without tokens takes a segment only.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        def rows():
            waiting, items, more = Pool(limits, pool), source(), True
            number = TaskContext.get().partitionId() << 40
            while more or len(waiting):
                while more and len(waiting) < pool:
                    got = next(items, None)
                    if got is None:
                        more = False
                        break
                    key, tokens, loss = got[0], int(got[1] or 0), int(got[2] or 0)
                    if tokens > limits[0] or loss > limits[2]:
                        yield key, tokens, loss, None, None, None, False
                    else:
                        waiting.add((key, tokens, loss), (max(tokens, 1e-9), 1, loss))
                left, offset, segment = waiting.limits.copy(), 0, 0
                while len(waiting):
                    slot = waiting.best(left)
                    if slot < 0:
                        break
                    key, tokens, loss = waiting.take(slot)
                    yield key, tokens, loss, number, offset, segment, True
                    left -= (tokens, 1, loss)
                    offset, segment = offset + tokens, segment + 1
                number += 1

        yield from by_batch(rows(), PLACED)

    return examples.select(*(examples[c].cast("long") for c in ("example_id", "tokens", "loss_tokens"))).mapInArrow(
        pack, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long, segment long, fits boolean"
    )
