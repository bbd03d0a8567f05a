"""Quality rules with an n-gram perplexity band per language.

The model is a modified Kneser-Ney model of characters, order 5, one per language.  Spark
counts the 5-grams of all documents (each task sums its own first), derives the continuation
counts of the lower orders, the three discounts of each order and the interpolated
probabilities by aggregates and joins, and the result is stored as sorted arrays of 63-bit
hashes with their log values, range-partitioned into files in the shared folder.  Tasks map
these files into memory, so the model may outgrow a worker.

A document is scored by the counts of all other documents, so that what only it holds is as
unlikely as it is elsewhere.  Its log perplexity is compared with the band of its language and
length class: the median, less and plus ``down`` and ``up`` robust standard deviations as measured
among the documents of that class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import SPACE, WORD, shared_folder, ship, store, to_batch

ship(__name__)

ORDER, BITS, BEGIN = 5, 12, 1
MULTIPLIER = 0x9E3779B97F4A7C15
HELD, SHARD_ENTRIES, CHUNK_CHARS = 1 << 21, 1 << 23, 1 << 20
UP, DOWN, LEAST_DOCS, WHOLE = 3.5, 3.5, 30, -1
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20
SYMBOLS = "#*$%&|<>"


# ------------------------------------------------------------------ grams of texts
def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codes of all texts, ``ORDER - 1`` begin marks before each, and the text number of each code.

    Code points from 4096 on are folded to 12 bits; marks have the text number -1.
    """
    mark = chr(BEGIN) * (ORDER - 1)
    raw = np.frombuffer("".join(mark + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(raw < 4096, raw, 2048 + (raw * 2654435761 >> 16) % 2048)
    size = np.array([len(t) + ORDER - 1 for t in texts])
    number = np.repeat(np.arange(len(texts)), size)
    ends = np.cumsum(size)
    for i in range(ORDER - 1):
        number[ends - size + i] = -1
    return codes, number


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed 5-gram that ends at each character, text number)."""
    codes, number = codes_of(texts)
    gram = codes.copy()
    for i in range(1, ORDER):
        gram[i:] |= codes[:-i] << (BITS * i)
    real = number >= 0
    return gram[real], number[real]


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[str]]]:
    """(language, row numbers, texts) in chunks of bounded size; a long text is a chunk of its own."""
    rows: dict[str, list[int]] = {}
    texts = batch.column("text").to_pylist()
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        rows.setdefault(lang or "", []).append(i)
    for lang, numbers in rows.items():
        at, size = 0, 0
        for k, i in enumerate(numbers):
            size += len(texts[i] or "")
            if size >= CHUNK_CHARS or k == len(numbers) - 1:
                mine = numbers[at : k + 1]
                yield lang, mine, [texts[j] or "" for j in mine]
                at, size = k + 1, 0


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 5-gram occurs in the documents of each language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            return keys[first], np.add.reduceat(counts, first) if len(keys) else counts

        def flush():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                for at in range(0, len(keys), 1 << 18):
                    part = keys[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part), pa.array(counts[at : at + (1 << 18)])], schema=schema)
            held.clear()

        for batch in batches:
            for lang, _, texts in by_language(batch):
                keys = np.sort(grams_of(texts)[0])
                if not len(keys):
                    continue
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                held.setdefault(lang, []).append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
                if size > 2 * HELD:
                    held = {name: [merged(parts)] for name, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ the model
def suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 per language from the counts of counts."""
    n = {i: F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)}
    y = "try_divide(n1, n1 + 2 * n2)"

    def held(rule: str, most: int) -> Column:
        """Within (0, most); the middle where the counts of counts do not give it."""
        value = F.expr(rule)
        return F.when(value.isNull() | (value <= 0) | (value >= most), most / 2).otherwise(value)

    return counts.groupBy("lang").agg(*n.values()).select(
        "lang", held(f"1 - 2 * {y} * try_divide(n2, n1)", 1).alias("d1"),
        held(f"2 - 3 * {y} * try_divide(n3, n2)", 2).alias("d2"), held(f"3 - 4 * {y} * try_divide(n4, n3)", 3).alias("d3"),
    )


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): log probabilities (kind = order) and log back-off weights (kind = order + 8)."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = settle(
            levels[order + 1].groupBy("lang", suffix("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        )
    out, lower = [], None
    for order in range(1, ORDER + 1):
        rows = levels[order].join(discounts(levels[order]), "lang")
        cut = F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")
        rows = rows.select("lang", "gram", "n", cut.alias("cut"), F.shiftright("gram", BITS).alias("context"))
        contexts = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"), F.count(F.lit(1)).alias("types")
        )
        if order == 1:
            # Below the single characters: all seen ones and one for the rest, equally likely.
            near = rows.join(contexts, ["lang", "context"]).withColumn("low", 1 / (F.col("types") + 1))
            out.append(contexts.select("lang", F.lit(8).alias("kind"), F.lit(0).cast("long").alias("gram"), F.log(F.col("weight") / (F.col("types") + 1)).alias("value")))
        else:
            near = rows.join(contexts, ["lang", "context"]).withColumn("below", suffix("gram", order - 1))
            near = near.join(lower, ["lang", "below"])
            out.append(contexts.select("lang", F.lit(8 + order).alias("kind"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        p = settle(near.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("low")).alias("p")))
        out.append(p.select("lang", F.lit(order).alias("kind"), "gram", F.log("p").alias("value")))
        lower = p.select("lang", F.col("gram").alias("below"), F.col("p").alias("low"))
    return reduce(DataFrame.unionByName, out)


def hashed(lang: str, kind: int, gram: np.ndarray) -> np.ndarray:
    """63-bit hash of grams of one language and kind."""
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=kind))
    return (((gram.astype(np.uint64) ^ salt) * np.uint64(MULTIPLIER)) >> np.uint64(1)).astype(np.int64)


def write_arrays(model: DataFrame, folder: str) -> list[tuple]:
    """Sorted hash arrays as files; returns (first key, entries, file name) of each, in order.

    A lost task leaves a file under a name that no row of the result has.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, kinds = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            gram, key = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for lang in set(langs.tolist()):
                for kind in set(kinds.tolist()):
                    mine = (langs == lang) & (kinds == kind)
                    key[mine] = hashed(lang, int(kind), gram[mine])
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(3)], ["key", "value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name, first, n = uuid.uuid4().hex, None, 0
        with fs.open_output_stream(f"{root}/{name}.keys") as k, fs.open_output_stream(f"{root}/{name}.values") as v:
            for batch in batches:
                key = batch.column(0).to_numpy()
                if len(key):
                    first = int(key[0]) if first is None else first
                    n += len(key)
                    k.write(key.astype("<i8").tobytes())
                    v.write(batch.column(1).to_numpy().astype("<f8").tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n]), pa.array([name])], ["first", "n", "name"])

    rows = settle(model.select("lang", "kind", "gram", "value").mapInArrow(keys, "key long, value double"))
    shards = -(-rows.count() // SHARD_ENTRIES)
    ordered = rows.repartitionByRange(max(shards, 1), "key").sortWithinPartitions("key")
    return sorted(map(tuple, ordered.mapInArrow(write, "first long, n long, name string").collect()))


class HashArrays:
    """``get(keys)``: the values of the keys, nan where there is none.  Files are mapped, not read, where they are local."""

    def __init__(self, folder: str, shards: list[tuple]):
        fs, root = store(folder)
        self.first = np.array([s[0] for s in shards], np.int64)
        self.parts = []
        for _, n, name in shards:
            if fs.type_name == "local":
                keys = np.memmap(f"{root}/{name}.keys", "<i8", "r")
                values = np.memmap(f"{root}/{name}.values", "<f8", "r")
            else:
                keys, values = (np.frombuffer(fs.open_input_stream(f"{root}/{name}.{k}").read(), d) for k, d in (("keys", "<i8"), ("values", "<f8")))
            low, high = int(keys[0]), int(keys[-1])
            shift = max((high - low).bit_length() - int(n).bit_length(), 0)
            # Where each slot of equal leading bits begins: hashes spread evenly, so a slot has a key or two.
            slots = np.zeros(((high - low) >> shift) + 2, np.int32)
            for at in range(0, n, 1 << 20):
                slots[: -1] += np.bincount((keys[at : at + (1 << 20)] - low) >> shift, minlength=len(slots) - 1).astype(np.int32)
            slots = np.concatenate([[0], np.cumsum(slots[:-1])]).astype(np.int32)
            self.parts.append((keys, values, low, high, shift, slots))

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        if len(self.parts) == 1:
            self._from(self.parts[0], keys, np.arange(len(keys)), out)
        elif self.parts:
            which = np.searchsorted(self.first, keys, "right") - 1
            for i, part in enumerate(self.parts):
                rows = np.flatnonzero(which == i)
                self._from(part, keys[rows], rows, out)
        return out

    @staticmethod
    def _from(part, keys, rows, out) -> None:
        known, values, low, high, shift, slots = part
        inside = (keys >= low) & (keys <= high)
        if not inside.all():
            keys, rows = keys[inside], rows[inside]
        slot = (keys - low) >> shift
        at, end = slots[slot], slots[slot + 1]
        while len(keys):
            live = at < end
            if not live.all():
                keys, rows, at, end = keys[live], rows[live], at[live], end[live]
            hit = known[at] == keys
            out[rows[hit]] = values[at[hit]]
            miss = ~hit
            keys, rows, at, end = keys[miss], rows[miss], at[miss] + 1, end[miss]


def log_probabilities(model: HashArrays, lang: str, grams: np.ndarray) -> np.ndarray:
    """Natural log probability of the last character of each 5-gram given the four before it.

    Seen grams have theirs stored; others back off, with the weight of each seen context.
    """
    out = model.get(hashed(lang, ORDER, grams)).astype(float)
    todo = np.flatnonzero(np.isnan(out))
    back = np.zeros(len(todo))
    for order in range(ORDER, 0, -1):
        if not len(todo):
            return out
        mine = grams[todo] & ((1 << BITS * order) - 1)
        if order < ORDER:
            value = model.get(hashed(lang, order, mine)).astype(float)
            hit = ~np.isnan(value)
            out[todo[hit]] = back[hit] + value[hit]
            todo, back, mine = todo[~hit], back[~hit], mine[~hit]
        if order > 1:
            back = back + np.nan_to_num(model.get(hashed(lang, 8 + order, mine >> BITS)).astype(float))
    if len(todo):
        rest = model.get(hashed(lang, 8, np.zeros(1, np.int64)))[0]
        out[todo] = back + (np.log(1 / 4096) if np.isnan(rest) else rest)  # a language without any model
    return out


# ------------------------------------------------------------------ without a document's own counts
def count_model(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): what the probabilities are computed from, so that a document's own part can be taken out.

    Kinds: order (count of a gram), 8 + order (total of a context), 16 + order (its sum of
    discounts), 24 + order (the discounts d1, d2, d3), 32 (number of characters seen).  ``copied_texts`` adds
    33 (rows of a text).
    """
    rows = counts
    out = []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            rows = settle(rows.groupBy("lang", suffix("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        cuts = settle(discounts(rows))
        cut = F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")
        contexts = settle(
            rows.join(F.broadcast(cuts), "lang").groupBy("lang", F.shiftright("gram", BITS).alias("gram"))
            .agg(F.sum("n").alias("total"), F.sum(cut).alias("cuts"), F.count(F.lit(1)).alias("types"))
        )
        parts = [(order, rows, "gram", "n"), (8 + order, contexts, "gram", "total"), (16 + order, contexts, "gram", "cuts")]
        parts += [(24 + order, cuts, F.lit(i), f"d{i}") for i in (1, 2, 3)]
        if order == 1:
            parts.append((32, contexts, "gram", "types"))
        for kind, table, gram, value in parts:
            gram = F.col(gram) if isinstance(gram, str) else gram
            out.append(table.select("lang", F.lit(kind).alias("kind"), gram.cast("long").alias("gram"), F.col(value).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, out)


def copied_texts(docs: DataFrame) -> DataFrame:
    """(lang, kind 33, hash of the text, number of rows) of the texts that several rows have."""
    hashes = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.lit(33).alias("kind"), F.xxhash64("text").alias("gram"))
    return hashes.groupBy("lang", "kind", "gram").agg(F.count(F.lit(1)).cast("double").alias("value")).filter("value > 1")


def copies_of(model: HashArrays, lang: str, texts: list[str]) -> np.ndarray:
    keys = np.array([xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts], np.uint64).view(np.int64)
    return np.fmax(model.get(hashed(lang, 33, keys)), 1)


def held_out_sums(model: HashArrays, lang: str, grams: np.ndarray, number: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Summed log probability of each text under the counts of all *other* documents.

    A text's own 5-grams and those of its exact copies are taken off.  Grams that no other text
    has are gone, and with each of them one continuation of its suffix, down to single characters.
    ``copies`` says how often each text was counted, zero for a new one.  Discounts stay those of
    the language.
    """
    def known(kind: int, keys: np.ndarray) -> np.ndarray:
        return np.nan_to_num(model.get(hashed(lang, kind, keys)))

    def pairs(text: np.ndarray, value: np.ndarray):
        """Distinct values, and of the distinct (text, value) pairs: text, place of the value, place of each row's pair."""
        some, code = np.unique(value, return_inverse=True)
        both, at = np.unique(text * max(len(some), 1) + code, return_inverse=True)
        return some, both // max(len(some), 1), both % max(len(some), 1), at

    some, text, code, at = pairs(number, grams)
    times, owner = np.bincount(at, minlength=len(text)), text
    minus, texts = times * copies[text], len(copies)
    levels, up = [], None
    for order in range(ORDER, 0, -1):
        n, cut = known(order, some)[code], np.append(0, known(24 + order, np.arange(1, 4)))
        left = np.maximum(n - minus, 0)
        top = left - cut[np.minimum(left, 3).astype(int)]
        less = n - cut[np.minimum(n, 3).astype(int)] - top
        contexts, _, place, at = pairs(text, some[code] >> BITS)
        total = (known(8 + order, contexts)[place] - np.bincount(at, n - left, len(place)))[at]
        cuts = (known(16 + order, contexts)[place] - np.bincount(at, n - left - less, len(place)))[at]
        levels.append((up, top, total, cuts))
        gone = (n > 0) & (left == 0)
        if order > 1:
            some, text, code, up = pairs(text, some[code] & ((1 << BITS * (order - 1)) - 1))
            minus = np.bincount(up, gone, len(text))
    types = known(32, np.zeros(1, np.int64))[0]
    # A language without any model has 4096 equally likely characters.
    p = 1 / (types - np.bincount(text, gone, texts) + 1 if types else np.full(texts, 4096.0))[text]
    for place, (_, top, total, cuts) in zip([None, *(x[0] for x in levels[:0:-1])], levels[::-1]):
        low = p if place is None else p[place]
        p = np.where(total > 0.5, (top + np.maximum(cuts, 0) * low) / np.maximum(total, 1), low)
    return np.bincount(owner, np.log(p) * times, texts)


# ------------------------------------------------------------------ rules
def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    spans = list(zip(*(words[i:] for i in range(window))))
    distinct = set(spans)
    if len(distinct) == len(spans):
        return 0
    seen: set = set()
    twice = {s for s in spans if s in seen or seen.add(s) is not None}
    total, covered = 0, 0
    for i, s in enumerate(spans):
        if s in twice:
            total += i + window - max(covered, i)
            covered = i + window
    return total


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORD.findall(text)
    lines = text.split("\n")
    dups = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        dups = sum(1 for x in lines if x.strip(SPACE) and (x in seen or seen.add(x) is not None))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dups, repeated_words(words)


def score_documents(docs: DataFrame, folder: str, shards: list[tuple]) -> DataFrame:
    """The base counts of every document and the summed log probability of its characters."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in names), ("n_scored", pa.int64()), ("log_p", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HashArrays(folder, shards)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lang, numbers, texts in by_language(batch):
                grams, number = grams_of(texts)
                log_p = held_out_sums(model, lang, grams, number, copies_of(model, lang, texts))
                rows = [(ids[i], lang, *base_rules(t), len(t), float(p)) for i, t, p in zip(numbers, texts, log_p)]
                yield to_batch(rows, schema)

    return docs.select("doc_id", "lang", "text").mapInArrow(
        score, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", n_scored long, log_p double"
    )


def bands(scored: DataFrame, *, up: float = UP, down: float = DOWN, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, size_class, middle, below, above): bounds of ``(log_perplexity - middle) * sqrt(n_scored)``.

    ``size_class`` is the power of two of the text's length.  A class with ``least_docs`` or more
    documents that the base rules leave has its own median and spread, another one those of its
    language; a language with fewer documents has no bounds.
    """
    some = scored.filter(F.col("log_perplexity").isNotNull() & ~F.col("base_failed"))
    grouping = lambda rows: rows.groupBy("lang", "size_class")
    each = settle(some.select("lang", F.explode(F.array("size_class", F.lit(WHOLE))).alias("size_class"), "log_perplexity", "n_scored"))
    middle = settle(grouping(each).agg(F.count(F.lit(1)).alias("docs"), F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")))
    away = F.abs(F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_scored")
    spread = grouping(each.join(F.broadcast(middle), ["lang", "size_class"])).agg(
        F.first("docs").alias("docs"), F.first("middle").alias("middle"), (1.4826 * F.percentile_approx(away, 0.5, 10_000)).alias("spread")
    )
    spread = settle(spread)
    whole = spread.filter((F.col("size_class") == WHOLE) & (F.col("docs") >= least_docs)).select(
        "lang", F.col("middle").alias("middle_of_all"), F.col("spread").alias("spread_of_all")
    )
    own = F.col("docs") >= least_docs
    fitted = spread.join(whole, "lang", "left").select(
        "lang", "size_class", F.when(own, F.col("middle")).otherwise(F.col("middle_of_all")).alias("middle"),
        F.when(own, F.col("spread")).otherwise(F.col("spread_of_all")).alias("spread"),
    )
    return fitted.select("lang", "size_class", "middle", (-down * F.col("spread")).alias("below"), (up * F.col("spread")).alias("above"))


def judge_documents(
    docs: DataFrame, *, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, **widths: float,
) -> DataFrame:
    """Base counts, ``perplexity``, ``base_failed`` and ``kept`` of every row of ``docs`` (doc_id, text, lang).

    A text with fewer than ``min_words`` words, or with more than ``max_repeat`` percent of its
    words in repeated windows, fails; of the others those stay whose log perplexity lies in the
    band of their language.  Null texts have no words; a null language is one of its own;
    repeated rows are judged each for itself; other columns are ignored.
    """
    counts = settle(count_grams(docs))
    folder = shared_folder(docs.sparkSession, "grams")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scored = score_documents(docs, folder, write_arrays(count_model(counts).unionByName(copied_texts(docs)), folder)).withColumns({
        "log_perplexity": F.when(F.col("n_scored") > 0, -F.col("log_p") / F.greatest("n_scored", F.lit(1))),
        "size_class": F.floor(F.log2(F.greatest("n_scored", F.lit(1)))).cast("int"), "base_failed": failed,
    })
    scored = settle(scored)
    limits = F.broadcast(settle(bands(scored, **widths)))
    root = F.sqrt(F.greatest("n_scored", F.lit(1)))
    # A language without bounds is judged by the base rules alone.
    inside = F.coalesce(((F.col("log_perplexity") - F.col("middle")) * root).between(F.col("below"), F.col("above")), F.lit(True))
    return scored.join(limits, ["lang", "size_class"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"), "lang",
        (F.col("middle") + F.col("below") / root).alias("lower"), (F.col("middle") + F.col("above") / root).alias("upper"),
    )
