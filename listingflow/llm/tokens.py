"""Best-fit-decreasing packing of documents into rows of an id matrix.

Overlong documents are split into whole rows and a rest, without loss.  The rests of a window
are placed in decreasing order; a segment tree over the capacities 0..row length finds the
fullest open row that still has room in log steps.  Each row is written as packed ids,
cumulative segment lengths and the places where positions restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_batch, ship
from .tokenizing import Tokenize, default_tokenizer

ship(__name__)

ROW_TOKENS, WINDOW_TOKENS, END_ID, PAD_ID = 2048, 1 << 22, 1, 0

ROWS = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("id_bytes", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())),
])
ROWS_DDL = (
    "sequence_id long, n_tokens int, input_ids binary, id_bytes int, doc_ids array<long>, doc_starts array<long>, "
    "cu_seqlens array<int>, position_resets array<int>"
)


class Capacities:
    """Open rows by free capacity; ``fit(size)`` is the row with the least capacity of at least ``size``."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64).tolist()
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """(capacity, row), taken out of the tree; None if no open row has the room."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            # Up to the first ancestor with something to the right, then down its left edge.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        self._change(capacity, -1)
        return capacity, row


def best_fit_decreasing(sizes: list[int], row_tokens: int) -> list[list[int]]:
    """Rows as lists of item numbers; every size is at most ``row_tokens``."""
    tree, rows = Capacities(row_tokens), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.fit(sizes[item])
        if found is None:
            rows.append([])
            found = row_tokens, len(rows) - 1
        capacity, row = found
        rows[row].append(item)
        tree.add(capacity - sizes[item], row)
    return rows


def pack_rows(
    docs: DataFrame, *, tokenizer: str | None = None, row_tokens: int = ROW_TOKENS,
    window_tokens: int = WINDOW_TOKENS, end_id: int = END_ID, pad_id: int = PAD_ID,
) -> DataFrame:
    """Rows of the id matrix: ids as little-endian bytes of ``id_bytes`` each, padded to ``row_tokens``.

    A document is its ids and ``end_id`` (a null or empty text: that id alone).  ``doc_ids`` and
    ``doc_starts`` name the segments, ``cu_seqlens`` their bounds (from 0, without padding), and
    ``position_resets`` the places where the position ids restart, the padding's included.  Ids
    are written with 2 bytes where the vocabulary allows.  Repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenize(path)
        wide = max(encode.exact.get_vocab_size(), end_id + 1, pad_id + 1) > 1 << 16
        kind = "<u4" if wide else "<u2"
        number = TaskContext.get().partitionId() << 40

        def row(pieces):
            nonlocal number
            ids = np.full(row_tokens, pad_id, kind)
            bounds = [0]
            for _, _, part in pieces:
                ids[bounds[-1] : bounds[-1] + len(part)] = part
                bounds.append(bounds[-1] + len(part))
            resets = bounds if bounds[-1] < row_tokens else bounds[:-1]
            out = (number, bounds[-1], ids.tobytes(), ids.itemsize, [p[0] for p in pieces], [p[1] for p in pieces], bounds, resets)
            number += 1
            return out

        def flush(rests):
            for items in best_fit_decreasing([len(r[2]) for r in rests], row_tokens):
                yield row([rests[i] for i in items])

        def rows():
            rests, held = [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    ids = np.append(encode.ids(text.as_py()), np.uint32(end_id)).astype(kind)
                    key, whole = doc_id.as_py(), len(ids) // row_tokens * row_tokens
                    for at in range(0, whole, row_tokens):
                        yield row([(key, at, ids[at : at + row_tokens])])
                    if whole < len(ids):
                        rests.append((key, whole, ids[whole:].copy()))
                        held += len(ids) - whole
                    if held >= window_tokens:
                        yield from flush(rests)
                        rests, held = [], 0
            yield from flush(rests)

        yield from by_batch(rows(), ROWS, 512)

    return docs.select("doc_id", "text").mapInArrow(pack, ROWS_DDL)


def write_rows(packed: DataFrame, path: str) -> DataFrame:
    """Write the matrix rows as Parquet (the output committer keeps lost attempts out) and read them back."""
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def matrix(rows: list, row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Id matrix of collected rows."""
    return np.stack([np.frombuffer(r["input_ids"], f"<u{r['id_bytes']}") for r in rows]) if rows else np.zeros((0, row_tokens), np.uint16)
