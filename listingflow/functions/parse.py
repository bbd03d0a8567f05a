"""Field extraction from free text: price, date, hour, image, link, place.

``as_of`` is always a Column (usually a date literal); nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import vocab as v
from .text import any_contains, blank_to_null, let, strip


def _group(text: Column, pattern: str, index: int) -> Column:
    """Regex group as null when the pattern or the group does not match."""
    return let(F.regexp_extract(text, pattern, index), blank_to_null)


def _int_group(text: Column, pattern: str, index: int) -> Column:
    """Regex group as a number; no match is no number.

    The blank is tested first: a failing ``try_cast`` costs an exception per row.
    """
    return let(F.regexp_extract(text, pattern, index), lambda x: F.when(x != "", x.try_cast("int")))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for item in v.MONTHS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), name)


def _day(year: Column, month: Column, day: Column) -> Column:
    """Date from three integers; null when it does not exist.

    Integer arithmetic only: the first of the month is safe to build, and the day
    is checked against the length of the month.
    """
    def build(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        usable = y.between(1, 9999) & m.between(1, 12) & (d >= 1)
        first = F.when(usable, F.make_date(y, m, F.lit(1)))
        return let(first, lambda f: F.when(d <= F.day(F.last_day(f)), F.date_add(f, d - 1)))

    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), build)


# ---------------------------------------------------------------- price
def extract_price(text: Column, limit: float = v.PRICE_LIMIT_PARSE) -> Column:
    """First bound of a range, else "from" price, else an amount; free words give 0."""
    found = F.coalesce(
        _group(text, "(?iu)" + v.PRICE_RANGE, 1),
        _group(text, "(?iu)" + v.PRICE_FROM, 1),
        _group(text, "(?iu)" + v.PRICE_AMOUNT, 1),
        _group(text, "(?iu)" + v.PRICE_AMOUNT, 2),
    )
    below = let(_number(found), lambda x: F.when(x < limit, x))
    free = F.when(any_contains(F.lower(text), v.FREE_WORDS), F.lit(0.0))
    return F.coalesce(below, free)


def card_price(text: Column) -> Column:
    """Amount directly before a euro sign, without limit."""
    return _number(_group(text, v.PRICE_CARD, 1))


def price_cap(price: Column, limit: float = v.PRICE_LIMIT_AUDIT) -> Column:
    return F.when(~(price > limit), price)


def map_link(lat: Column, lon: Column) -> Column:
    low, high = v.MAP_LATITUDES
    link = F.concat(
        F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lon.cast("string")
    )
    return F.when((lat > low) & (lat < high) & lon.isNotNull(), link).otherwise(F.lit(""))


def coords_from_link(link: Column) -> tuple[Column, Column]:
    return (
        _group(link, v.MAP_LINK_COORDS, 1).try_cast("double"),
        _group(link, v.MAP_LINK_COORDS, 2).try_cast("double"),
    )


# ---------------------------------------------------------------- dates
def infer_year(month: Column, day: Column, as_of: Column) -> Column:
    """Year of a date without one: next year when it passed over 30 days ago.

    Null when the day does not exist in the current year.
    """
    this_year = F.year(as_of)
    return let(
        _day(this_year, month, day),
        lambda d: F.when(d < F.date_sub(as_of, 30), this_year + 1).when(d.isNotNull(), this_year),
    )


def yearless_date(month: Column, day: Column, as_of: Column) -> Column:
    """Date from day and month with the inferred year."""
    return let(
        F.struct(month.alias("m"), day.alias("d")),
        lambda x: _day(infer_year(x["m"], x["d"], as_of), x["m"], x["d"]),
    )


def badge_date(day: Column, month_name: Column, as_of: Column) -> Column:
    """Date from a day number and a month name of which three letters count."""
    month = _month_number(F.substring(F.lower(month_name), 1, 3))
    return yearless_date(month, F.trim(day).try_cast("int"), as_of)


def normalize_date(text: Column, as_of: Column) -> Column:
    """Date from "15 de marzo" or "15 mar"."""
    low = F.lower(text)
    month = _month_number(F.substring(F.regexp_extract(low, v.DATE_DAY_MONTH, 2), 1, 3))
    return yearless_date(month, _int_group(low, v.DATE_DAY_MONTH, 1), as_of)


def extract_date(
    text: Column, as_of: Column, year_min: int = v.YEAR_MIN, year_max: int = v.YEAR_MAX
) -> Column:
    """Date from text in four layers: ISO, d/m/y, "d al d de mes", "d de mes de año".

    Only the first match of a layer is tried; a layer whose match is no date in
    the accepted years falls through to the next.
    """
    def valid(day: Column) -> Column:
        return let(day, lambda d: F.when(F.year(d).between(year_min, year_max), d))

    iso = F.try_to_date(_group(text, v.DATE_ISO, 0), "yyyy-MM-dd")

    dmy_year = F.regexp_extract(text, v.DATE_DMY, 3)
    full_year = let(dmy_year, lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
    dmy = _day(
        F.when(dmy_year != "", full_year.try_cast("int")),
        _int_group(text, v.DATE_DMY, 2),
        _int_group(text, v.DATE_DMY, 1),
    )

    def worded(pattern: str, day_group: int, month_group: int, year_group: int, short: bool) -> Column:
        flagged = "(?iU)" + pattern

        def month_of(name: Column) -> Column:
            month = _month_number(name)
            if not short:
                return month
            return F.coalesce(
                month, F.when(F.length(name) > 3, _month_number(F.substring(name, 1, 3)))
            )

        found = F.struct(
            let(F.lower(F.regexp_extract(text, flagged, month_group)), month_of).alias("m"),
            _int_group(text, flagged, day_group).alias("d"),
            _int_group(text, flagged, year_group).alias("y"),
        )
        return let(
            found,
            lambda x: _day(F.coalesce(x["y"], infer_year(x["m"], x["d"], as_of)), x["m"], x["d"]),
        )

    return F.coalesce(
        valid(iso),
        valid(dmy),
        valid(worded(v.DATE_SPAN, 1, 3, 4, short=False)),
        valid(worded(v.DATE_TEXT, 1, 2, 3, short=True)),
    )


def extract_date_range(text: Column) -> Column:
    """Struct (start, end, is_course) from dotted dates; a course lasts over 30 days."""
    def dotted(pattern: str, first: int) -> Column:
        return F.concat_ws(
            "-",
            F.regexp_extract(text, pattern, first + 2),
            F.regexp_extract(text, pattern, first + 1),
            F.regexp_extract(text, pattern, first),
        )

    def as_day(c: Column) -> Column:
        return F.try_to_date(c, "yyyy-MM-dd")

    start, end = as_day(dotted(v.DATE_DOT_RANGE, 1)), as_day(dotted(v.DATE_DOT_RANGE, 4))
    single = as_day(dotted(v.DATE_DOT, 1))
    is_range = text.rlike(v.DATE_DOT_RANGE)
    return F.struct(
        F.when(is_range, start).otherwise(single).alias("start"),
        F.when(is_range, end).otherwise(single).alias("end"),
        F.coalesce(is_range & (F.datediff(end, start) > 30), F.lit(False)).alias("is_course"),
    )


def last_day_of_range(text: Column, as_of: Column) -> Column:
    """Closing day of "... al 23 de marzo", read with :func:`extract_date`."""
    low = F.lower(text)
    day, month = _group(low, v.DATE_LAST_DAY, 1), _group(low, v.DATE_LAST_DAY, 2)
    return extract_date(F.concat(day, F.lit(" de "), month), as_of)


def to_local(text: Column, zone: str = v.LOCAL_ZONE, naive_is_utc: bool = True) -> Column:
    """Struct (day, hour) of an ISO instant in the local zone; bad text gives nulls.

    The instant is carried as a zone-free timestamp, so the session time zone has
    no effect on the result.
    """
    trimmed = F.trim(text)
    well_formed = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    has_zone = trimmed.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")
    micros = F.unix_micros(F.concat(trimmed, F.when(has_zone, "").otherwise("Z")).try_cast("timestamp"))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros / 1000000).cast("decimal(18,6)")
    )
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    local = shifted if naive_is_utc else F.when(has_zone, shifted).otherwise(utc)
    shown = F.when(well_formed, local.cast("string"))
    return F.struct(
        F.try_to_date(F.substring(shown, 1, 10), "yyyy-MM-dd").alias("day"),
        F.substring(shown, 12, 5).alias("hour"),
    )


# ---------------------------------------------------------------- hours
def extract_hour(text: Column, improbable: Sequence[str] = v.IMPROBABLE_HOURS) -> Column:
    """HH:MM from "a las 19:30", a clock time, or "20 h"; amounts of money are not hours."""
    def clock(pattern: str, minutes: bool) -> Column:
        flagged = "(?iU)" + pattern
        m = F.regexp_extract(text, flagged, 2) if minutes else F.lit("00")
        return let(
            _int_group(text, flagged, 1),
            lambda h: F.when(h <= 23, F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), m)),
        )

    hour = F.coalesce(clock(v.HOUR_AT, True), clock(v.HOUR_CLOCK, True), clock(v.HOUR_SHORT, False))
    return let(hour, lambda h: F.when(~h.isin(*improbable), h))


def plain_hour(text: Column) -> Column:
    """First H:MM in the text, unless it says the whole day."""
    h, m = _group(text, v.HOUR_PLAIN, 1), _group(text, v.HOUR_PLAIN, 2)
    return F.when(
        ~F.contains(F.lower(text), F.lit("todo el")),
        F.concat(F.lpad(h, 2, "0"), F.lit(":"), m),
    )


def hour_to_minutes(hour: Column) -> Column:
    """Minutes since midnight; -999 for a blank or unreadable hour."""
    readable = hour.rlike(r"^\s*\d{1,6}\s*:\s*\d{1,6}\s*(:|$)")
    parts = F.split(hour, ":")
    minutes = parts[0].cast("int") * 60 + parts[1].cast("int")
    return F.when(readable, minutes).otherwise(F.lit(v.NO_HOUR))


# ---------------------------------------------------------------- urls
def valid_image(url: Column, bad_tokens: Sequence[str] = v.BAD_IMAGE_TOKENS) -> Column:
    def keep(u: Column) -> Column:
        good = F.startswith(u, F.lit("http")) & (F.length(u) >= v.MIN_IMAGE_URL)
        if bad_tokens:
            good = good & ~any_contains(F.lower(u), bad_tokens)
        return F.when(good, u)

    return let(strip(url), keep)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def _first_code(text: Column, codes, default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for part, code in reversed(codes):
        out = F.when(F.contains(text, F.lit(part)), F.lit(code)).otherwise(out)
    return out


def domain_of(url: Column, codes=v.HOST_CODES, default: str = v.DEFAULT_HOST_CODE) -> Column:
    """Source code from the host name."""
    return let(F.coalesce(host_of(url), F.lit("")), lambda host: _first_code(host, codes, default))


def page_venue_source(url: Column, codes=v.PAGE_VENUE_CODES) -> Column:
    """Source code for page venue look-up, tested on the whole URL; null if unsupported."""
    return _first_code(F.lower(url), codes, None)


def resolve_url(href: Column, base: str, *, drop_query: bool = True, slash: str = "keep") -> Column:
    """Absolute URL of a link: base added, query and ``/register`` cut.

    ``slash`` is ``keep``, ``drop`` or ``add`` for the trailing slash.
    """
    url = F.when(F.startswith(href, F.lit("http")), href).when(
        F.startswith(href, F.lit("/")), F.concat(F.lit(base.rstrip("/")), href)
    ).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
    if drop_query:
        url = F.regexp_extract(url, r"^[^?]*", 0)
    url = F.regexp_replace(url, r"/register/?$", "/")
    if slash == "drop":
        url = F.regexp_replace(url, r"/+$", "")
    elif slash == "add":
        url = F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/")))
    return url


def prefer_ticket_link(links: Column, page_url: Column, own_host: Column,
                       tokens: Sequence[str] = v.TICKET_URL_TOKENS) -> Column:
    """First link to a ticket shop, else the first link off the page's host, else the page."""
    shop = F.get(F.filter(links, lambda u: any_contains(F.lower(u), tokens)), F.lit(0))
    other = F.get(F.filter(links, lambda u: ~F.contains(u, own_host)), F.lit(0))
    return F.coalesce(shop, other, page_url)


def address_in(text: Column) -> Column:
    """Street, square, campus or hall named in the text, longer than five characters."""
    found = strip(F.regexp_extract(text, "(?iu)" + v.ADDRESS, 1))
    return F.when(F.length(found) > 5, found)
