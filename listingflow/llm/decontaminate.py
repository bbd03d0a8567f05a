"""Benchmark items inside documents, with edits: pigeonhole pieces, then Myers' bit-parallel distance.

An item with an error budget of ``k`` edits is cut into ``k + 1`` pieces; at most ``k`` edits
leave one piece whole, so a document that holds the item within the budget holds a piece exactly.
One pass of an Aho-Corasick automaton over a document finds the pieces, and the bit-parallel
distance verifies each hit.  Pieces come from halving the item and its budget again and again
(of ``b`` errors in two halves, one has at most ``(b - 1) / 2``), so a hit is verified from the
smallest enclosing part up to the whole item, and most chance hits end after a few characters.

The benchmark is the query set.  It goes to the tasks in blocks of ``block_chars`` characters,
one pass over the documents each, so its size is bounded whatever the benchmark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import by_batch, ship

ship(__name__)

ERROR_RATE, BLOCK_CHARS = 0.1, 1_000_000
APART = re.compile(r"[\W_]+")
HITS = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()),
])
HITS_DDL = "doc_id long, item_id long, distance long, begin long, end long"


def normal(text: str | None) -> str:
    """Lower-case words with single spaces; positions in results count in this form."""
    return APART.sub(" ", (text or "").lower()).strip()


def cut(text: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` slices with their places, of which ``budget`` edits leave one whole."""
    n = budget + 1
    return [(i * len(text) // n, text[i * len(text) // n : (i + 1) * len(text) // n]) for i in range(n)]


class Part:
    """A range of an item with its error budget; ``above`` is the part it was halved from.

    ``beside`` are slices of the other half with the item ranges to look for them: where this
    half is whole and ``above`` is within its budget, one of them is there.
    """

    def __init__(self, item: str, low: int, high: int, budget: int, above: Part | None = None):
        self.low, self.high, self.budget, self.above = low, high, budget, above
        self.text = item[low:high]
        self.halves: list[Part] = []
        self.beside: list[tuple[str, int, int]] = []
        if budget:
            left = (budget - 1) // 2
            middle = low + (high - low) * (left + 1) // (budget + 1)
            self.halves = [Part(item, low, middle, left, self), Part(item, middle, high, budget - 1 - left, self)]
            for one, other in (self.halves, self.halves[::-1]):
                one.beside = [(t, other.low + at - budget, other.low + at + len(t) + budget) for at, t in cut(other.text, budget)]

    @cached_property
    def pattern(self) -> Pattern:
        """Made at the first hit: most parts of a benchmark never have one."""
        return Pattern(self.text)

    def pieces(self) -> list[Part]:
        """The ``budget + 1`` parts that must match exactly, one of them at least."""
        return [p for h in self.halves for p in h.pieces()] if self.halves else [self]


class Pattern:
    """Myers' algorithm with one arbitrarily long word."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for i, ch in enumerate(text):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i

    def search(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(distance, end) of the best match, the first of equals; it may begin anywhere, or at 0 if anchored."""
        up, down, score = self.full, 0, self.size
        best, end = score, 0
        full, top, masks, carry = self.full, self.top, self.masks, 1 if anchored else 0
        for j, ch in enumerate(text, 1):
            eq = masks.get(ch, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & full
            hp = down | (full & ~(d0 | up))
            hn = up & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | carry) & full
            hn = hn << 1 & full
            up = hn | (full & ~(d0 | hp))
            down = hp & d0
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """Items by their pieces; ``find(text)`` gives (item number, distance, begin, end) for each item found."""

    def __init__(self, items: list[str], budgets: list[int]):
        import ahocorasick

        self.items, self.budgets = items, budgets
        self.ahead = cache(lambda number: Pattern(items[number]))
        self.behind = cache(lambda number: Pattern(items[number][::-1]))
        pieces: dict[str, list[tuple[int, Part]]] = {}
        for number, (item, budget) in enumerate(zip(items, budgets)):
            for piece in Part(item, 0, len(item), budget).pieces():
                pieces.setdefault(piece.text, []).append((number, piece))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, uses in self.automaton.iter(text):
            for number, piece in uses:
                zero = last + 1 - piece.high  # where the item would begin
                budget = self.budgets[number]
                begin, end = zero - budget, zero + len(self.items[number]) + budget
                known = windows.get(number)
                if known and any(a <= begin and end <= b for a, b in known):
                    continue
                if piece.beside and not any(t in text[max(zero + a, 0) : max(zero + b, 0)] for t, a, b in piece.beside):
                    continue
                part = piece.above
                while part is not None:
                    low = max(zero + part.low - part.budget, 0)
                    if part.pattern.search(text[low : max(zero + part.high + part.budget, 0)])[0] > part.budget:
                        break
                    part = part.above
                else:
                    windows.setdefault(number, []).append((begin, end))
        out = []
        for number in sorted(windows):
            best = None
            for begin, end in windows[number]:
                begin = max(begin, 0)
                distance, stop = self.ahead(number).search(text[begin : max(end, 0)])
                if distance <= self.budgets[number] and (best is None or distance < best[0]):
                    best = (distance, begin, begin + stop)
            if best:
                distance, low, stop = best
                _, back = self.behind(number).search(text[low:stop][::-1], anchored=True)
                out.append((number, distance, stop - back, stop))
        return out


def find_items(
    docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): every document and benchmark item (item_id, text)
    it holds within ``error_rate`` edits per character, with the best place, the first of equals.

    Texts are compared in ``normal`` form.  Items without a letter or digit and null texts match
    nothing; repeated items and repeated rows are each reported; null ids stay null; other columns
    are ignored; an empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // block_chars) + 1

    def one(block: int) -> DataFrame:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        known = [(r["item_id"], normal(r["text"])) for r in mine.collect()]
        known = sorted(((i, t) for i, t in known if t), key=lambda x: (x[0] is not None, x))
        spread = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = spread.value
            matcher = Matcher([t for _, t in found], [int(len(t) * error_rate) for _, t in found]) if found else None

            def rows():
                for batch in batches:
                    for doc_id, text in zip(batch.column(0), batch.column(1)):
                        for number, distance, begin, end in matcher.find(normal(text.as_py())) if matcher else ():
                            yield doc_id.as_py(), found[number][0], distance, begin, end

            yield from by_batch(rows(), HITS)

        return docs.select("doc_id", "text").mapInArrow(run, HITS_DDL)

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null doc_id are judged as one."""
    # Written, so that the planner knows the size of this side.
    bad = settle(find_items(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
