"""Look-ups: coordinates, venues, categories, labels, enrichment.

Dictionaries of bounded size (tens to hundreds of literal entries) are part of
the expression: no join, no shuffle, and the first entry in dictionary order
wins.  Tables of unknown size (gazetteer, labels, enrichment, page venues) are
equi-joins whose strategy is left to Catalyst and AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.flags import is_garbage_row, is_generic_place
from ..functions.parse import address_in, page_venue_source
from ..functions.text import fold, let, strip, strip_ai_tags
from ..session import no_match_key, settle
from .survivors import keep_best

KEYWORD_BLOCK = 4_000_000  # about 250 MB a worker

def _entries(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows
    ])


# ---------------------------------------------------------------- coordinates
def dictionary_coords(place: Column, table=v.PLACE_COORDS) -> Column:
    """Struct (lat, lon) of a place: exact folded key, else the first key in table
    order that contains the place or is contained in it; null without a match."""
    entries = _entries(table, ["key", "lat", "lon"])

    def find(p: Column) -> Column:
        exact = F.filter(entries, lambda e: e["key"] == p)
        partial = F.filter(entries, lambda e: F.contains(p, e["key"]) | F.contains(e["key"], p))
        hit = F.coalesce(F.get(exact, F.lit(0)), F.get(partial, F.lit(0)))
        return F.when(p != "", F.struct(hit["lat"].alias("lat"), hit["lon"].alias("lon")))

    found = let(fold(place), find)
    return F.when(found["lat"].isNotNull(), found)


def gazetteer_hits(gazetteer: DataFrame, bbox=v.BBOX) -> DataFrame:
    """Best point per place: inside the box, from the narrowest query that has one."""
    inside = (
        (F.col("lat") > bbox["lat"][0]) & (F.col("lat") < bbox["lat"][1])
        & (F.col("lon") > bbox["lon"][0]) & (F.col("lon") < bbox["lon"][1])
    )
    return gazetteer.filter(inside).groupBy("place_norm").agg(
        F.min_by(F.struct("lat", "lon"), F.struct("query_ord", "lat", "lon")).alias("gaz")
    )


def lookup_coords(df: DataFrame, gazetteer: DataFrame | None = None, *, table=v.PLACE_COORDS,
                  fallback=v.CENTRE_COORDS) -> DataFrame:
    """Fill missing coordinates and say how (``geo_method``; null when they were there)."""
    missing = F.col("latitud").isNull() | F.col("longitud").isNull()
    out = df.withColumn("_dict", F.when(missing, dictionary_coords(F.col("lugar"), table)))
    if gazetteer is not None:
        # Only rows the dictionary misses look for a place; the others are dealt to all tasks.
        wanted = F.when(missing & F.col("_dict").isNull(), fold(F.col("lugar")))
        out = out.withColumn("_place", F.coalesce(wanted, no_match_key()))
        hits = gazetteer_hits(gazetteer).withColumnRenamed("place_norm", "_place")
        out = out.join(hits, "_place", "left")
    else:
        out = out.withColumn("gaz", F.lit(None).cast("struct<lat:double,lon:double>"))
    lat = F.coalesce("_dict.lat", "gaz.lat", F.lit(float(fallback[0])))
    lon = F.coalesce("_dict.lon", "gaz.lon", F.lit(float(fallback[1])))
    method = (
        F.when(~missing, None).when(F.col("_dict").isNotNull(), "dictionary")
        .when(F.col("gaz").isNotNull(), "gazetteer").otherwise("fallback")
    )
    return out.withColumns({
        "geo_method": method,
        "latitud": F.when(missing, lat).otherwise(F.col("latitud")),
        "longitud": F.when(missing, lon).otherwise(F.col("longitud")),
    }).select(*df.columns, "geo_method")


# ---------------------------------------------------------------- venues
def first_pattern(text: Column, table=v.VENUE_PATTERNS) -> Column:
    """Venue of the first pattern, in table order, that occurs in the folded text."""
    entries = _entries(table, ["pattern", "venue"])
    return let(
        fold(text),
        lambda t: F.get(F.filter(entries, lambda e: F.contains(t, e["pattern"])), F.lit(0))["venue"],
    )


def detected_venue(title: Column, text: Column, url: Column, patterns=v.VENUE_PATTERNS,
                   domains=v.VENUE_DOMAINS) -> Column:
    """Venue named in the title, the text, the URL's domain, or an address in the text."""
    entries = _entries(domains, ["domain", "venue"])
    by_domain = let(
        F.lower(F.coalesce(url, F.lit(""))),
        lambda u: F.get(F.filter(entries, lambda e: F.contains(u, e["domain"])), F.lit(0))["venue"],
    )
    return F.coalesce(
        first_pattern(title, patterns), first_pattern(text, patterns), by_domain, address_in(text)
    )


def _set_place(df: DataFrame, place: Column) -> DataFrame:
    """Replace the place where a new one is known; its coordinates are then void."""
    changed = place.isNotNull()
    return df.withColumns({
        "lugar": F.coalesce(place, F.col("lugar")),
        "latitud": F.when(~changed, F.col("latitud")),
        "longitud": F.when(~changed, F.col("longitud")),
    })


def detect_venue(df: DataFrame) -> DataFrame:
    """Give generic places the venue found in title, text or URL."""
    found = detected_venue(F.col("nombre"), F.col("descripcion"), F.col("url_venta"))
    return _set_place(
        df.withColumn("_venue", F.when(is_generic_place(F.col("lugar")), found)), F.col("_venue")
    ).drop("_venue")


def apply_page_venue(df: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue read from the listing's own page, for places that are still generic.

    ``venues`` has (url_venta, ord, venue); the first usable text counts.
    """
    usable = venues.withColumn("venue", strip(F.col("venue"))).filter(
        (F.length("venue") > 2) & ~is_generic_place(F.col("venue"))
    )
    best = usable.groupBy("url_venta").agg(F.min_by("venue", F.struct("ord", "venue")).alias("_venue"))
    wanted = is_generic_place(F.col("lugar")) & page_venue_source(F.col("url_venta")).isNotNull()
    joined = df.join(best, "url_venta", "left").withColumn("_venue", F.when(wanted, F.col("_venue")))
    return _set_place(joined, F.col("_venue")).select(*df.columns)


# ---------------------------------------------------------------- categories
def keyword_category(title: Column, text: Column, keywords=v.STARTER_KEYWORDS) -> Column:
    """Category with the highest keyword score; null without any hit.

    A keyword counts 3 in the title, else 1 in the text.  Ties go to the first
    category in list order.
    """
    def scores(low: Column) -> Column:
        per_category = []
        for i, (category, words) in enumerate(keywords):
            points = F.lit(0)
            for word in words:
                points = points + F.when(F.contains(low["title"], F.lit(word)), 3).when(
                    F.contains(low["text"], F.lit(word)), 1
                ).otherwise(0)
            per_category.append(F.struct(
                points.alias("score"), F.lit(-i).alias("ord"), F.lit(category).alias("name")
            ))
        return F.array_max(F.array(*per_category))

    low = F.struct(
        F.lower(F.coalesce(title, F.lit(""))).alias("title"),
        F.lower(F.concat_ws(" ", title, text)).alias("text"),
    )
    best = let(low, scores)
    return F.when(best["score"] > 0, best["name"])


def classify_keywords(df: DataFrame, keywords=v.STARTER_KEYWORDS) -> DataFrame:
    """Category from keywords; rows without a hit keep theirs.  No join, no shuffle."""
    found = keyword_category(F.col("nombre"), F.col("descripcion"), keywords)
    return df.withColumn("estilo", F.coalesce(found, F.col("estilo")))


def classify_by_table(df: DataFrame, keywords: DataFrame, *, block_chars: int = KEYWORD_BLOCK) -> DataFrame:
    """:func:`classify_keywords` with a keyword table (ord, category, keyword) of any size.

    The table is a query set held against all rows: it goes to the tasks in blocks of about
    ``block_chars`` characters, each an automaton that reads every text once, and the points
    per category are carried from block to block.  One block needs neither a join nor a
    shuffle nor a written copy.  ``ord`` orders the categories (the smallest of a category
    counts); null and empty keywords match nothing; repeated keywords count each.
    """
    spark = df.sparkSession
    words = keywords.filter("keyword <> ''").select("ord", "category", "keyword")
    firsts = words.groupBy("category").agg(F.min("ord").alias("first"))
    # The name of a category begins with its place in the order, so that ties can be told from the name alone.
    name = F.concat(F.lpad(F.col("first").cast("string"), 10, "0"), "category")
    # A keyword repeated in a category is one row with its count, so a hit costs one step per category.
    words = settle(words.join(firsts, "category").groupBy("keyword", name.alias("name")).agg(F.count(F.lit(1)).alias("uses")))
    blocks = int((words.agg(F.sum(F.length("keyword"))).first()[0] or 0) // block_chars) + 1
    title = F.lower(F.coalesce("nombre", F.lit("")))
    text = F.lower(F.concat_ws(" ", "nombre", "descripcion"))
    points, out = F.lit(None).cast("map<string,int>"), df
    for block in range(blocks):
        mine = words if blocks == 1 else words.filter(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.select("keyword", "name", "uses").collect()])
        out = out.withColumn("_points", _keyword_points(shared)(title, text, points))
        points = F.col("_points")
        if block < blocks - 1:
            out = settle(out)  # a worker holds one automaton at a time
    best = F.array_max(F.transform(F.map_entries(points), lambda e: F.struct(
        e["value"].alias("score"), (-F.substring(e["key"], 1, 10).cast("long")).alias("ord"), F.substr(e["key"], F.lit(11)).alias("name"))))
    return out.withColumn("estilo", F.coalesce(best["name"], F.col("estilo"))).select(*df.columns)


def _keyword_points(shared):
    """Points per category name of the keywords in ``shared``, added to the points so far."""
    held: list = []

    @F.pandas_udf("map<string,int>")
    def add(titles: pd.Series, texts: pd.Series, so_far: pd.Series) -> pd.Series:
        import ahocorasick

        if not held:
            uses: dict = {}
            for keyword, name, n in shared.value:
                uses.setdefault(keyword, []).append((name, n))
            automaton = ahocorasick.Automaton()
            for keyword, names in uses.items():
                automaton.add_word(keyword, (keyword, names))
            automaton.make_automaton()
            held.append(automaton if uses else None)
        automaton, out = held[0], []
        for title, text, start in zip(titles, texts, so_far):
            points = dict(start) if start is not None else {}
            if automaton is not None:
                found = {keyword: names for _, (keyword, names) in automaton.iter(text)}
                for keyword, names in found.items():
                    weight = 3 if keyword in title else 1
                    for name, n in names:
                        points[name] = points.get(name, 0) + weight * n
            out.append(points)
        return pd.Series(out)

    return add


def apply_labels(df: DataFrame, labels: DataFrame, valid: Sequence[str] = v.CATEGORIES) -> DataFrame:
    """External categories (id, categoria): unknown ones count as the default,
    and only others overwrite.

    Of several labels of one id the last one counts, by ``order`` where the labels have that
    column, else (and among equals) by the place of the category in ``valid``, the first one.
    """
    known = F.col("categoria").isin(*valid) & (F.col("categoria") != v.DEFAULT_CATEGORY)
    later = [F.col("order")] if "order" in labels.columns else []
    rank = F.struct(*later, (-F.array_position(F.array(*[F.lit(c) for c in valid]), F.col("categoria"))).alias("place"))
    best = labels.filter(known).groupBy("id").agg(F.max_by("categoria", rank).alias("_label"))
    joined = df.join(best, "id", "left")
    return joined.withColumn("estilo", F.coalesce("_label", F.col("estilo"))).select(*df.columns)


def apply_enrichment(df: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Merge enrichment rows by id.

    Text when longer than 20; place only over a generic one, which voids the
    coordinates; price and hour only where missing.  Every row counts as enriched.  Of several
    enrichments of one id the last one counts, by ``order`` where they have that column, and
    among equals the one with the greatest values.
    """
    fields = ["descripcion_limpia", "precio_num", "hora", "lugar_corregido"]
    later = ["order"] if "order" in enrichment.columns else []
    e = enrichment.groupBy("id").agg(F.max(F.struct(*later, *fields)).alias("e")).select(
        "id", F.col("e.descripcion_limpia").alias("_text"), F.col("e.precio_num").alias("_price"),
        F.col("e.hora").alias("_hour"), F.col("e.lugar_corregido").alias("_place"),
    )
    joined = df.join(e, "id", "left")
    place = F.when(is_generic_place(F.col("lugar")) & (F.length("_place") > 2), strip(F.col("_place")))
    joined = _set_place(joined.withColumn("_place", place), F.col("_place"))
    return joined.withColumns({
        "descripcion": F.when(F.length("_text") > 20, strip_ai_tags(F.col("_text"))).otherwise(F.col("descripcion")),
        "precio_num": F.coalesce("precio_num", "_price"),
        "hora": F.coalesce("hora", F.when(F.contains("_hour", F.lit(":")), F.col("_hour"))),
        "enriquecido": F.lit(True),
    }).select(*df.columns)


# ---------------------------------------------------------------- other joins
def attach_sources(survivors: DataFrame, groups: DataFrame, key: str = "cluster") -> DataFrame:
    return survivors.join(groups, key, "left")


def drop_matched(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def related(df: DataFrame, k: int = 4, *, as_of: Column) -> DataFrame:
    """For every listing the next ``k`` others of its category: (id, place, related_id).

    The first ``k + 1`` listings of a category are enough for all its members,
    whatever its size, so the join side has at most ``k + 1`` rows per category.
    """
    future = df.filter((F.col("fecha_iso") >= as_of) & F.col("estilo").isNotNull())
    heads = keep_best(
        future.select("estilo", "fecha_iso", "id"), ["estilo"], [F.col("fecha_iso"), F.col("id")], k + 1
    )
    heads = heads.groupBy("estilo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fecha_iso", "id"))), lambda x: x["id"]).alias("heads")
    )
    # Written first: the planner then knows its size and broadcasts it only if small,
    # instead of shuffling all listings by a handful of categories.
    heads = settle(heads)
    others = F.slice(F.filter("heads", lambda x: x != F.col("id")), 1, k)
    return (
        df.filter(F.col("estilo").isNotNull()).select("id", "estilo").join(heads, "estilo")
        .select("id", F.posexplode(others).alias("place", "related_id"))
    )


def next_date(df: DataFrame, as_of: Column) -> DataFrame:
    """Earliest later date per category."""
    return (
        df.filter(F.col("fecha_iso") > as_of).groupBy("estilo")
        .agg(F.min("fecha_iso").alias("next_date"))
    )


def garbage(df: DataFrame) -> DataFrame:
    return df.filter(is_garbage_row(F.col("nombre"), F.col("lugar"))).select("id")
