"""SQL fragments for the checks: the text rules written as DuckDB expressions."""

from __future__ import annotations

from ..functions import vocab as v


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def in_list(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(q(p) for p in values) + ")"


SPACE = r"[\s\x0B\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean(x: str) -> str:
    return f"replace(trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g')), chr(8203), '')"


def fold(x: str) -> str:
    return f"strip_accents({strip(f'''lower(coalesce({x}, ''))''')})"


def ascii_only(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def strip_place_suffix(x: str) -> str:
    names = "|".join(v.REGION_SUFFIXES)
    base = strip(f"coalesce({x}, '')")
    cut = rf"regexp_replace({base}, '(?i)\s*[-|/,]*\s*(?:en\s+)?(?:{names})\b\s*$', '')"
    return strip(rf"regexp_replace({cut}, '\s+[-|/,]\s*$', '')")


def canonical_venue(x: str) -> str:
    place = strip(f"coalesce({x}, '')")
    folded = ascii_only(f"lower({place})")
    arms = []
    for alternatives, name in v.VENUE_ALIASES:
        test = " OR ".join("(" + " AND ".join(f"contains({folded}, {q(p)})" for p in parts) + ")" for parts in alternatives)
        arms.append(f"WHEN {test} THEN {q(name)}")
    return (
        f"CASE WHEN {place} = '' OR length({place}) > 150 OR {any_of(f'lower({place})', v.PLACE_LEAK_PHRASES)} "
        f"THEN NULL {' '.join(arms)} ELSE {place} END"
    )


def canonical_title(x: str) -> str:
    out = f"replace({fold(x)}, '&', 'y')"
    for phrase in sorted(v.TITLE_STOP_PHRASES, key=len, reverse=True):
        out = f"replace({out}, {q(phrase)}, '')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def occurrence_title(x: str) -> str:
    out = f"lower({strip_place_suffix(x)})"
    for phrase in v.OCCURRENCE_NOISE:
        out = f"replace({out}, {q(phrase)}, ' ')"
    return f"regexp_replace({ascii_only(out)}, '[^a-z0-9]', '', 'g')"


def occurrence_place(x: str) -> str:
    return f"regexp_replace(lower({ascii_only(f'''coalesce({canonical_venue(x)}, {x}, '')''')}), '[^a-z0-9]', '', 'g')"


def occurrence_key(title: str, day: str, place: str) -> str:
    return f"{occurrence_title(title)} || '|' || coalesce(CAST({day} AS VARCHAR), 'None') || '|' || {occurrence_place(place)}"


def generic_place(x: str) -> str:
    return f"({in_list(fold(x), v.GENERIC_PLACES)})"


def generic_title(x: str) -> str:
    low = strip(f"lower(coalesce({x}, ''))")
    return f"(length({low}) < 3 OR {in_list(low, v.CATEGORY_WORDS)} OR {any_of(low, v.GENERIC_TITLE_PHRASES)})"


def junk_title(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    return (
        f"({in_list(f'lower({t})', v.JUNK_TITLES)} OR length({t}) < 2 OR length({t}) >= 110 "
        rf"OR regexp_matches({t}, '\b\d{{3}}\b.*\b\d{{3}}\b') OR ends_with({t}, '...'))"
    )


def garbage_row(title: str, place: str) -> str:
    t = strip(f"coalesce({title}, '')")
    return (
        rf"(length({t}) < 3 OR regexp_matches({t}, '^[\d\s\-.,;:]+$') "
        f"OR ({fold(title)} <> '' AND {fold(title)} = {fold(place)}))"
    )


def social(title: str, url: str) -> str:
    return (
        f"(coalesce(regexp_matches({title}, '(?i)youtube|facebook|instagram'), false) "
        f"OR coalesce(regexp_matches({url}, '(?i)youtube|facebook|twitter'), false))"
    )


def blank_hour(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '' OR lower(trim({x})) IN ('nan', 'none', '<na>'))"


def valid_image(x: str, bad=v.BAD_IMAGE_TOKENS) -> str:
    u = strip(x)
    test = f"starts_with({u}, 'http') AND length({u}) >= 15"
    if bad:
        test += f" AND NOT {any_of(f'lower({u})', bad)}"
    return f"CASE WHEN {test} THEN {u} END"


def value_of(x: str, pairs, default) -> str:
    arms = " ".join(f"WHEN {q(a)} THEN {b}" for a, b in pairs)
    return f"CASE {x} {arms} ELSE {default} END"


def quality_score() -> str:
    return (
        f"({value_of('organiza', v.SOURCE_SCORES, v.DEFAULT_SOURCE_SCORE)} "
        "+ CASE WHEN trim(coalesce(hora, '')) <> '' THEN 10 ELSE 0 END "
        "+ CASE WHEN precio_num IS NOT NULL THEN 10 ELSE 0 END "
        f"+ CASE WHEN trim(coalesce(lugar, '')) = '' THEN 0 WHEN {generic_place('lugar')} THEN 2 ELSE 20 END "
        "+ least(coalesce(length(descripcion), 0) // 100, 10))"
    )


SURVIVOR_ORDER = f"{fold('nombre')}, {generic_place('lugar')}, coalesce(length(descripcion), 0) DESC, id"
MASTER_ORDER = (
    f"{value_of('organiza', v.SOURCE_PRIORITIES, v.DEFAULT_SOURCE_PRIORITY)}, "
    "coalesce(length(descripcion), 0) DESC, id"
)


def first_row(source: str, keys: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


def months(x: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {n}" for k, n in v.MONTHS.items())
    return f"CASE {x} {arms} END"


def day_of(year: str, month: str, day: str) -> str:
    return f"TRY_CAST(printf('%04d-%02d-%02d', {year}, {month}, {day}) AS DATE)"


def nullif_blank(x: str) -> str:
    return f"nullif({x}, '')"
