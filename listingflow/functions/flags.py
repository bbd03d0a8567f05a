"""Boolean Columns: what is generic, boilerplate, junk, in scope, future."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import vocab as v
from .text import any_contains, count_contains, fold, let, strip


def is_generic_title(title: Column, phrases: Sequence[str] = v.GENERIC_TITLE_PHRASES,
                     words: Sequence[str] = v.CATEGORY_WORDS) -> Column:
    """A portal phrase or a bare category word instead of an event title.

    One pattern, so the title is computed and walked once: between white space under three characters
    or a category word and nothing else, or anywhere a phrase (those that contain another one add nothing).
    """
    whole = "|".join([".{0,2}", *map(re.escape, words)])
    parts = [re.escape(p) for p in phrases if not any(o != p and o in p for o in phrases)]
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join([rf"(?Us)\A\s*(?:{whole})\s*\z", *parts]))


def is_boilerplate(text: Column, phrases: Sequence[str] = v.BOILERPLATE_PHRASES) -> Column:
    """At least two legal or footer phrases."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: count_contains(low, phrases) >= 2)


def is_junk_title(title: Column) -> Column:
    """Title that should not be published; its row becomes a draft."""
    return let(
        strip(F.coalesce(title, F.lit(""))),
        lambda t: F.lower(t).isin(*v.JUNK_TITLES)
        | (F.length(t) < 2)
        | (F.length(t) >= 110)
        | t.rlike("(?U)" + v.TWO_NUMBER_GROUPS)
        | F.endswith(t, F.lit("...")),
    )


def is_garbage_row(title: Column, place: Column) -> Column:
    """Row to delete: hardly a title, only digits, or the title repeats the place."""
    return let(
        strip(F.coalesce(title, F.lit(""))),
        lambda t: (F.length(t) < 3)
        | t.rlike("(?U)" + v.DIGITS_ONLY_NAME)
        | let(fold(t), lambda folded: (folded != "") & (folded == fold(place))),
    )


def is_generic_place(place: Column, places: Sequence[str] = v.GENERIC_PLACES) -> Column:
    return fold(place).isin(*places)


def is_social(title: Column, url: Column) -> Column:
    in_title = title.rlike("(?i)" + "|".join(v.SOCIAL_IN_TITLE))
    in_url = url.rlike("(?i)" + "|".join(v.SOCIAL_IN_URL))
    return F.coalesce(in_title, F.lit(False)) | F.coalesce(in_url, F.lit(False))


def is_blank_hour(hour: Column) -> Column:
    h = F.lower(strip(hour))
    return hour.isNull() | (h == "") | h.isin(*v.BLANK_HOUR_TOKENS)


def future_or_draft(day: Column, as_of: Column) -> Column:
    return day.isNull() | (day >= as_of)


def in_geo_scope(*texts: Column, include: Sequence[str] = v.ISLAND_WORDS,
                 exclude: Sequence[str] | None = v.OTHER_PLACES) -> Column:
    """Any text in scope; in one text an excluded word beats an included one."""
    def one(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        inside = any_contains(low, include)
        return inside & ~any_contains(low, exclude) if exclude else inside

    out = one(texts[0])
    for text in texts[1:]:
        out = out | one(text)
    return out


def slug_verdict(slug: Column, accept: Sequence[str] = v.SLUG_ACCEPT,
                 reject: Sequence[str] = v.SLUG_REJECT) -> Column:
    """false = elsewhere, true = in scope, null = undecided."""
    low = F.lower(slug)
    return F.when(any_contains(low, reject), F.lit(False)).when(
        any_contains(low, accept), F.lit(True)
    )


def venue_allowed(venue: Column, reject: Sequence[str] = v.VENUE_REJECT) -> Column:
    """An unknown venue passes; only a venue that names another place fails."""
    return ~any_contains(F.lower(F.coalesce(venue, F.lit(""))), reject)


def is_link_noise(href: Column, text: Column) -> Column:
    """Category, tag, author and page links, "read more" anchors, digits-only names."""
    return (
        any_contains(href, v.LINK_NOISE_PARTS)
        | F.contains(F.lower(text), F.lit("leer"))
        | text.rlike(r"^\d[\d\s]+$")
    )
