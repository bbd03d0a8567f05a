"""Text clean-up as Catalyst expressions.

Every function takes and returns a :class:`Column`; but for :func:`strip_marks_all` nothing here
leaves the JVM, so the expressions stay inside whole-stage code generation and next to the scan.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from . import vocab as v

SPACES = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_contains(text: Column, parts: Sequence[str]) -> Column:
    """True when ``text`` contains one of the literal ``parts``; null stays null.

    One alternation instead of a chain of tests, so ``text`` is computed once.
    """
    return text.rlike("|".join(re.escape(p) for p in parts))


def count_contains(text: Column, parts: Sequence[str]) -> Column:
    """How many of the literal ``parts`` occur in ``text``."""
    hits = [F.contains(text, F.lit(p)).cast("int") for p in parts]
    return reduce(operator.add, hits)


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Translate table built from the Unicode decomposition rule.

    Characters whose compatibility decomposition is one base character (plus
    combining marks) map to that base; combining marks themselves are dropped,
    which ``translate`` does for source characters beyond the target's length.
    """
    src, dst = [], []
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)):
        for code in block:
            ch = chr(code)
            base = "".join(
                x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)
            )
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(src + marks), "".join(dst)


def strip_marks(c: Column) -> Column:
    """Remove diacritics (canonical and compatibility forms of Latin letters)."""
    src, dst = _fold_table()

    def fold_one(x: Column) -> Column:
        plain = F.length(x) == F.octet_length(x)  # ASCII needs no table
        return F.when(plain, x).otherwise(F.translate(x, src, dst))

    return let(c, fold_one)


def clean_text(c: Column) -> Column:
    """null -> "", runs of white space -> one space, trimmed, zero-width space dropped."""
    one_line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))
    return F.replace(one_line, F.lit("\u200b"), F.lit(""))


def strip_marks_all(c: Column) -> Column:
    """Remove diacritics and compatibility forms of every script, by full decomposition in Arrow batches."""
    @F.pandas_udf("string")
    def decompose(texts: pd.Series) -> pd.Series:
        import unicodedata as u

        return texts.map(lambda x: x if x is None or x.isascii() else "".join(
            ch for ch in u.normalize("NFKD", x) if not u.combining(ch)))

    return decompose(c)


def fold(c: Column, every_script: bool = False) -> Column:
    """Lower case, trimmed, without diacritics; punctuation is kept.

    Latin letters fold in the JVM; ``every_script`` decomposes all others too (й, ά, ﬁ).
    """
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    return strip_marks_all(low) if every_script else strip_marks(low)


def ascii_only(c: Column) -> Column:
    """Drop diacritics, then every character outside ASCII."""
    return F.regexp_replace(strip_marks(c), r"[^\x00-\x7F]", "")


def strip_place_suffix(c: Column, suffixes: Sequence[str] = v.REGION_SUFFIXES) -> Column:
    """Drop one trailing region name with its separator, then a dangling separator."""
    names = "|".join(suffixes)
    cut = F.regexp_replace(
        strip(F.coalesce(c, F.lit(""))),
        rf"(?iU)\s*[-|/,]*\s*(?:en\s+)?(?:{names})\b\s*$",
        "",
    )
    return strip(F.regexp_replace(cut, r"(?U)\s+[-|/,]\s*$", ""))


def strip_suffixes(c: Column, suffixes: Sequence[str] = v.TITLE_SUFFIXES) -> Column:
    """Remove literal suffixes in order, each tested on what the one before left."""
    cut = F.aggregate(
        F.array(*[F.lit(s) for s in suffixes]),
        strip(c),
        lambda acc, s: F.when(
            F.endswith(F.lower(acc), s),
            strip(F.substring(acc, F.lit(1), F.length(acc) - F.length(s))),
        ).otherwise(acc),
    )
    return F.regexp_replace(cut, "[ \\-–—]+$", "")


def canonical_venue(
    c: Column,
    aliases=v.VENUE_ALIASES,
    leaks: Sequence[str] = v.PLACE_LEAK_PHRASES,
    max_length: int = 150,
) -> Column:
    """Known venue names from free place text; narrative text becomes null."""
    def alias(folded: Column) -> Column:
        named = F.lit(None).cast("string")
        for alternatives, name in reversed(aliases):
            hit = F.lit(False)
            for parts in alternatives:
                every = F.lit(True)
                for part in parts:
                    every = every & F.contains(folded, F.lit(part))
                hit = hit | every
            named = F.when(hit, F.lit(name)).otherwise(named)
        return named

    def resolve(place: Column) -> Column:
        low = F.lower(place)
        rejected = (place == "") | (F.length(place) > max_length) | any_contains(low, leaks)
        return F.when(~rejected, F.coalesce(let(ascii_only(low), alias), place))

    return let(strip(F.coalesce(c, F.lit(""))), resolve)


def canonical_title(c: Column, stop_phrases: Sequence[str] = v.TITLE_STOP_PHRASES) -> Column:
    """Comparison form of a title: folded, ``&`` as ``y``, stop phrases out, [a-z0-9 ] only."""
    out = F.replace(fold(c), F.lit("&"), F.lit("y"))
    for phrase in sorted(stop_phrases, key=len, reverse=True):
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = F.regexp_replace(out, r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def occurrence_title(c: Column, noise: Sequence[str] = v.OCCURRENCE_NOISE) -> Column:
    out = F.lower(strip_place_suffix(c))
    for phrase in noise:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    return F.regexp_replace(ascii_only(out), r"[^a-z0-9]", "")


def occurrence_place(c: Column) -> Column:
    place = F.coalesce(canonical_venue(c), c, F.lit(""))
    return F.regexp_replace(F.lower(ascii_only(place)), r"[^a-z0-9]", "")


def occurrence_key(title: Column, day: Column, place: Column) -> Column:
    """Key shared by all copies of one occurrence: title | date | venue."""
    return F.concat_ws(
        "|",
        occurrence_title(title),
        F.coalesce(day.cast("string"), F.lit("None")),
        occurrence_place(place),
    )


def name_from_slug(url: Column, default: str = v.DEFAULT_NAME) -> Column:
    """Readable name from the last telling path part of a URL."""
    parts = F.filter(
        F.split(F.coalesce(url, F.lit("")), "/"),
        lambda p: (F.length(p) > 2) & ~p.rlike(r"^\d+$"),
    )
    slug = F.try_element_at(parts, F.lit(-1))
    decoded = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    words = F.translate(F.regexp_replace(decoded, r"^\d+-", ""), "-_", "  ")
    return F.coalesce(F.initcap(words), F.lit(default))


def null_tokens(c: Column, tokens: Sequence[str] = v.NULL_TOKENS) -> Column:
    """Text spellings of "missing" become null."""
    return F.when(~c.isin(*tokens), c)


def strip_ai_tags(c: Column) -> Column:
    out = c
    for tag in v.AI_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return strip(out)


def preview(c: Column, size: int = 200) -> Column:
    """Text without mark-up, cut at ``size`` and closed with dots; empty for no text."""
    plain = F.regexp_replace(c, r"<[^>]+>", "")
    return F.when(
        F.coalesce(c, F.lit("")) != "", F.concat(F.substring(plain, 1, size), F.lit("..."))
    ).otherwise(F.lit(""))


def price_label(c: Column) -> Column:
    amount = F.concat(F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(",")), F.lit(" €"))
    return (
        F.when(c.isNull(), v.PRICE_UNKNOWN).when(c == 0, v.PRICE_FREE).otherwise(amount)
    )


def urgency(day: Column, as_of: Column) -> Column:
    """How soon: ``today``, ``tomorrow``, ``days_n``, ``weekend`` or null."""
    ahead = F.datediff(day, as_of)
    weekend = F.dayofweek(day).isin(1, 7)
    return (
        F.when(ahead == 0, F.lit("today"))
        .when(ahead == 1, F.lit("tomorrow"))
        .when(ahead.between(2, 3), F.concat(F.lit("days_"), ahead.cast("string")))
        .when(ahead.between(4, 7) & weekend, F.lit("weekend"))
    )


def xml_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def ics_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, text in (("\\", "\\\\"), (";", "\\;"), (",", "\\,")):
        out = F.replace(out, F.lit(raw), F.lit(text))
    return F.regexp_replace(out, r"\r?\n", r"\\n")
