"""Entity resolution: which listings are copies of one event.

Greedy leader clustering is sequential by definition: titles are visited in
order, each joins the first leader that is similar enough or becomes a leader.
It runs here without ever holding a whole block in one task:

* copies collapse first: one row per (block, title), by a partial aggregate;
* a block of at most ``chunk`` titles is one array in one Arrow batch;
* of a larger block the first ``chunk`` titles are solved, and all others, spread
  over slices of bounded size, are compared with the leaders found.  A title that
  finds one is decided (leaders found earlier in the order win, exactly as in the
  sequential pass);
* the rest goes through a candidate join and an ordered fixpoint over its edges
  (``candidates``).

Nothing is capped, and the result equals the sequential pass (``tests/test_resolve.py``
checks it against brute force).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab as v
from ..functions.flags import is_generic_place, is_generic_title
from ..functions.parse import hour_to_minutes
from ..functions.similarity import Leaders, cached_score, follow_few, follow_leaders
from ..functions.text import canonical_title, fold, occurrence_key, strip
from ..session import no_match_key, python_partitions, settle
from .candidates import TILE, ordered_leaders, similar_edges
from .survivors import keep_best, master_rank, quality_score, survivor_rank, text_size

CHUNK = 4096
SLICE = 20_000
FEW = 12


# ------------------------------------------------------------ leader clusters
def _solve_udf(threshold: float, use_ratio: bool):
    @F.pandas_udf("array<string>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = cached_score(use_ratio)
        for lists in batches:
            yield pd.Series([
                follow_few(titles, score, threshold) if len(titles) <= FEW else follow_leaders(titles, Leaders(threshold, use_ratio))
                for titles in lists
            ])

    return solve


def _solve_blocks(titles: DataFrame, threshold: float, use_ratio: bool) -> DataFrame:
    """(block, title, leader) for blocks that fit in one array."""
    spread = titles.repartition(python_partitions(titles.sparkSession), "block")
    packed = spread.groupBy("block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]
        ).alias("titles")
    )
    solved = packed.withColumn("leaders", _solve_udf(threshold, use_ratio)("titles"))
    return solved.select(
        "block", F.inline(F.arrays_zip("titles", "leaders")).alias("title", "leader")
    )


def _first_chunk(df: DataFrame, key: str, chunk: int) -> DataFrame:
    """First rows of each key, at most ``chunk``; limited below the shuffle where the optimiser does so."""
    place = F.row_number().over(W.partitionBy(key).orderBy("rank"))
    return df.withColumn("place", place).filter(F.col("place") <= chunk).drop("place")


def assign_leaders(
    titles: DataFrame, *, threshold: float, use_ratio: bool = True,
    chunk: int = CHUNK, slice_size: int = SLICE,
) -> DataFrame:
    """Leader of every (block, title).

    ``titles`` has one row per ``block`` and ``title`` and an orderable ``rank``
    that fixes the visiting order inside the block.
    """
    titles = settle(titles.select("block", "title", "rank"))
    sizes = titles.groupBy("block").count()
    large = sizes.filter(F.col("count") > chunk)
    if large.isEmpty():
        return _solve_blocks(titles, threshold, use_ratio)

    large = settle(large.withColumn("slices", F.ceil(F.col("count") / slice_size).cast("int")))
    small = titles.join(large, "block", "left_anti")
    decided = [_solve_blocks(small, threshold, use_ratio)]
    todo = titles.join(large.select("block", "slices"), "block")

    def compare(open_titles: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if open_titles.empty:
            return pd.DataFrame({"block": [], "title": [], "leader": []}, dtype="str")
        leaders = Leaders(threshold, use_ratio)
        for name in found.sort_values("place")["leader"]:
            leaders.add(name)
        hits = [leaders.first(name) for name in open_titles["title"]]
        return pd.DataFrame({
            "block": open_titles["block"],
            "title": open_titles["title"],
            "leader": [leaders.names[i] if i >= 0 else None for i in hits],
        })

    # The head of a large block is solved as it is and compared with all others; what then still is
    # open has few similar pairs left.
    parts = python_partitions(titles.sparkSession)
    solved = settle(_solve_blocks(_first_chunk(todo, "block", chunk), threshold, use_ratio))
    decided.append(solved)
    rest = todo.join(solved, ["block", "title"], "left_anti")
    rest = rest.withColumn("slice", F.pmod(F.xxhash64("title"), F.col("slices")))
    leaders = (
        todo.join(solved.filter("title = leader"), ["block", "title"])
        .select("block", "leader", F.col("rank").alias("place"), "slices")
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)))
        .drop("slices")
    )
    order = F.row_number().over(W.partitionBy("block", "slice").orderBy("place"))
    leaders = settle(leaders.withColumn("place", order))
    compared = settle(
        rest.select("block", "title", "slice").repartition(parts, "block", "slice")
        .groupBy("block", "slice")
        .cogroup(leaders.repartition(parts, "block", "slice").groupBy("block", "slice"))
        .applyInPandas(compare, "block string, title string, leader string")
    )
    decided.append(compared.filter("leader IS NOT NULL"))
    todo = settle(
        todo.join(compared.filter("leader IS NULL").select("block", "title"), ["block", "title"]).select("block", "title", "rank")
    )
    sizes = todo.groupBy("block").count()
    large = settle(sizes.filter(F.col("count") > chunk).select("block"))
    decided.append(_solve_blocks(todo.join(large, "block", "left_anti"), threshold, use_ratio))
    if not large.isEmpty():
        todo = settle(todo.join(large, "block"))
        decided.append(ordered_leaders(todo, similar_edges(todo, threshold=threshold, use_ratio=use_ratio, tile=min(slice_size, TILE))))
    return reduce(DataFrame.unionByName, decided)


def cluster_titles(
    df: DataFrame, *, block: Column, title: Column, rank: Column, threshold: float,
    use_ratio: bool = True, chunk: int = CHUNK, slice_size: int = SLICE,
) -> DataFrame:
    """Add ``block`` and ``leader`` to every row; rows keep their payload."""
    rows = df.withColumn("block", block).withColumn("title", title)
    titles = rows.withColumn("rank", rank).groupBy("block", "title").agg(F.min("rank").alias("rank"))
    leaders = settle(assign_leaders(
        titles, threshold=threshold, use_ratio=use_ratio, chunk=chunk, slice_size=slice_size
    ))
    return rows.join(leaders, ["block", "title"])


def similar_pairs(
    df: DataFrame, *, block: Column, title: Column, rank: Column,
    threshold: float = v.TITLE_MATCH_SCORE, use_ratio: bool = True,
) -> DataFrame:
    """(block, title, leader): each distinct title that matched a leader in its block."""
    titles = (
        df.select(block.alias("block"), title.alias("title"), rank.alias("rank"))
        .groupBy("block", "title").agg(F.min("rank").alias("rank"))
    )
    leaders = assign_leaders(titles, threshold=threshold, use_ratio=use_ratio)
    return leaders.filter(F.col("title") != F.col("leader"))


# ------------------------------------------------------------ across sources
def fuzzy_cluster(
    df: DataFrame, *, threshold: float = v.TITLE_MATCH_SCORE, drafts: str = "pass",
    chunk: int = CHUNK, slice_size: int = SLICE,
) -> DataFrame:
    """Cluster dated listings of one day by canonical title; adds ``cluster``.

    ``drafts="pass"`` gives each undated row its own cluster; ``"merge"`` puts
    them all in one, so that they are only told apart by their hours.
    """
    dated = cluster_titles(
        df.filter(F.col("fecha_iso").isNotNull()),
        block=F.col("fecha_iso").cast("string"), title=canonical_title(F.col("nombre")),
        rank=survivor_rank(), threshold=threshold, chunk=chunk, slice_size=slice_size,
    ).withColumn("cluster", F.concat_ws("|", "block", "leader")).drop("block", "title", "leader")
    own = F.lit("draft") if drafts == "merge" else F.concat(F.lit("draft|"), F.col("id").cast("string"))
    return dated.unionByName(df.filter(F.col("fecha_iso").isNull()).withColumn("cluster", own))


def _sessions_udf(gap: int, no_hour: int):
    """Sequential grouping of the minutes of one cluster, starting from given groups."""

    @F.pandas_udf("struct<subs: array<int>, state: array<array<int>>>")
    def group(minutes: pd.Series, state: pd.Series) -> pd.DataFrame:
        subs, states = [], []
        for row, start in zip(minutes, state):
            groups = [set(map(int, g)) for g in (start if start is not None else [])]
            out = []
            for m in map(int, row):
                hit = next(
                    (i for i, g in enumerate(groups)
                     if m == no_hour or no_hour in g or any(abs(m - x) < gap for x in g)),
                    None,
                )
                if hit is None:
                    hit = len(groups)
                    groups.append(set())
                groups[hit].add(m)
                out.append(hit)
            subs.append(out)
            states.append([sorted(g) for g in groups])
        return pd.DataFrame({"subs": subs, "state": states})

    return group


def hour_subgroups(
    rows: DataFrame, *, gap: int = v.SESSION_GAP_MINUTES, chunk: int = CHUNK
) -> DataFrame:
    """(cluster, rank, sub): sessions of a cluster, told apart by their hour.

    ``rows`` has ``cluster``, ``rank`` (unique order in the cluster) and
    ``minute``.  Rows join the first group that has a member without hour or
    within ``gap`` minutes.  A row without hour always joins group 0, and so does
    every row after it; only rows before the first such row need the sequential
    pass.  Large clusters run it in chunks: once the groups cover all minutes
    still to come, the remaining rows are decided in parallel.
    """
    no_hour = v.NO_HOUR
    free = rows.filter(F.col("minute") == no_hour).groupBy("cluster").agg(
        F.min("rank").alias("free")
    )
    marked = rows.join(free, "cluster", "left")
    after = (F.col("free").isNotNull()) & (F.col("rank") >= F.col("free"))
    absorbed = marked.filter(after).select("cluster", "rank", F.lit(0).alias("sub"))
    timed = settle(marked.filter(~after).select("cluster", "rank", "minute"))
    group = _sessions_udf(gap, no_hour)

    def solve(df: DataFrame) -> DataFrame:
        spread = df.repartition(python_partitions(df.sparkSession), "cluster")
        packed = spread.groupBy("cluster").agg(
            F.array_sort(F.collect_list(F.struct("rank", "minute"))).alias("items"),
            F.first("state", ignorenulls=True).alias("state"),
        )
        return packed.select(
            "cluster", "items",
            group(F.transform("items", lambda x: x["minute"]), F.col("state")).alias("out"),
        )

    def unpack(solved: DataFrame) -> DataFrame:
        return solved.select(
            "cluster", F.inline(F.arrays_zip("items", "out.subs")).alias("item", "sub")
        ).select("cluster", F.col("item.rank").alias("rank"), "sub")

    no_state = F.lit(None).cast("array<array<int>>")
    large = timed.groupBy("cluster").count().filter(F.col("count") > chunk)
    if large.isEmpty():
        return absorbed.unionByName(unpack(solve(timed.withColumn("state", no_state))))

    large = settle(large.select("cluster"))
    small = timed.join(large, "cluster", "left_anti").withColumn("state", no_state)
    decided = [absorbed, unpack(solve(small))]
    todo = timed.join(large, "cluster").withColumn("state", no_state)
    while True:
        solved = settle(solve(_first_chunk(todo, "cluster", chunk)))
        decided.append(unpack(solved))
        reached = solved.select(
            "cluster", F.element_at("items", -1)["rank"].alias("last"),
            F.col("out.state").alias("state"),
        )
        rest = todo.drop("state").join(reached, "cluster").filter(F.col("rank") > F.col("last"))
        fits = F.transform(
            "state", lambda g: F.exists(g, lambda x: F.abs(x - F.col("minute")) < gap)
        )
        target = F.array_position(fits, True)
        routed = (
            rest.groupBy("cluster", "minute").agg(F.min("rank").alias("head"), F.first("state").alias("state"))
            .withColumn("target", target)
            .withColumn("stable", F.coalesce(
                F.array_contains(F.get("state", (F.col("target") - 1).cast("int")), F.col("minute")),
                F.lit(False)))
            .select("cluster", "minute", "head", "target", "stable")
        )
        routed = settle(routed)
        change = routed.filter(~F.col("stable")).groupBy("cluster").agg(F.min("head").alias("change"))
        rest = settle(
            rest.join(routed.select("cluster", "minute", "target"), ["cluster", "minute"])
            .join(change, "cluster", "left")
        )
        open_row = F.col("change").isNotNull() & (F.col("rank") >= F.col("change"))
        decided.append(rest.filter(~open_row).select(
            "cluster", "rank", (F.col("target") - 1).cast("int").alias("sub")))
        todo = rest.filter(open_row).select("cluster", "rank", "minute", "state")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, decided)


def same_venue_clusters(clustered: DataFrame) -> DataFrame:
    """Clusters in which at least two rows name a concrete place and all name the same."""
    place = strip(F.lower(F.coalesce(F.col("lugar"), F.lit(""))))
    concrete = F.when((place != "") & ~is_generic_place(place), place)
    return (
        clustered.groupBy("cluster")
        .agg(F.count(concrete).alias("named"), F.min(concrete).alias("lo"), F.max(concrete).alias("hi"))
        .filter((F.col("named") >= 2) & (F.col("lo") == F.col("hi")))
        .select("cluster")
    )


def merged_sources(clustered: DataFrame, key: str = "cluster") -> DataFrame:
    """Sorted distinct sources of each group, joined by " + "."""
    return (
        clustered.select(key, "organiza").distinct()
        .groupBy(key)
        .agg(F.concat_ws(" + ", F.array_sort(F.collect_list("organiza"))).alias("merged_from_sources"))
    )


def session_minute() -> Column:
    """Minute that tells sessions apart; a generic place counts as a row without hour."""
    return F.when(is_generic_place(F.col("lugar")), F.lit(v.NO_HOUR)).otherwise(hour_to_minutes(F.col("hora")))


def session_survivors(clustered: DataFrame, *, rows: DataFrame | None = None,
                      gap: int = v.SESSION_GAP_MINUTES, chunk: int = CHUNK) -> DataFrame:
    """Best row of every session of every cluster, with the cluster's sources.

    Only key, order, minute, place and score travel through the grouping; the
    listings (``rows``, by default ``clustered``) are joined once, by id.
    """
    slim = settle(clustered.select(
        "cluster", "id", "lugar", "organiza", survivor_rank().alias("rank"),
        quality_score().alias("score"), session_minute().alias("minute"),
    ))
    same = same_venue_clusters(slim).withColumn("one_place", F.lit(True))
    marked = slim.join(same, "cluster", "left")
    fixed = marked.filter("one_place").withColumn("sub", F.lit(0))
    split = marked.filter("one_place IS NULL")
    subs = hour_subgroups(split.select("cluster", "rank", "minute"), gap=gap, chunk=chunk)
    placed = split.join(subs, ["cluster", "rank"]).unionByName(fixed.select(*split.columns, "sub"))
    best = keep_best(
        placed, ["cluster", "sub"], [F.col("score").desc(), F.col("rank").asc()]
    ).select("id", "cluster")
    best = best.join(merged_sources(slim), "cluster", "left")
    payload = clustered.drop("cluster") if rows is None else rows
    return payload.join(best, "id")


# ------------------------------------------------------------ inside the table
def _table_rows(df: DataFrame) -> DataFrame:
    """Rows without a generic title, with their ``block`` and ``title``."""
    block = F.concat_ws(
        "\u0001",
        F.coalesce(F.col("fecha_iso").cast("string"), F.lit("-")),
        F.coalesce(F.col("hora"), F.lit("")),
        fold(F.col("lugar")),
    )
    return df.filter(~is_generic_title(F.col("nombre"))).withColumns({"block": block, "title": F.lower("nombre")})


def _star_clusters(rows: DataFrame, **options) -> DataFrame:
    rows = cluster_titles(
        rows, block=F.col("block"), title=F.col("title"), rank=F.struct("id"), use_ratio=False, **options)
    return rows.withColumn("cluster", F.concat_ws("\u0001", "block", "leader")).drop(
        "block", "title", "leader"
    )


def table_clusters(
    df: DataFrame, *, threshold: float = v.TABLE_MATCH_SCORE, chunk: int = CHUNK,
    slice_size: int = SLICE,
) -> DataFrame:
    """Star clusters of equal date, hour and place with similar titles; adds ``cluster``.

    Generic titles are left out.  A missing date, hour or place is a value of the
    block key like any other.
    """
    return _star_clusters(_table_rows(df), threshold=threshold, chunk=chunk, slice_size=slice_size)


def _merged(clustered: DataFrame, size: Column, text: Column) -> DataFrame:
    """(cluster, master, longest, imagen_url, copies); all are ordered aggregates, so a hot cluster
    is combined on the map side.  ``longest.text`` is the ``text`` of the row of the largest ``size``."""
    rank = master_rank(size=size)
    image = F.when(F.coalesce("imagen_url", F.lit("")) != "", F.struct(rank.alias("r"), F.col("imagen_url")))
    master = F.struct(rank.alias("r"), F.col("imagen_url").alias("image"))
    # Longest text; among equals the first in master order.
    longest = F.struct((-size).alias("size"), rank.alias("r"), text.alias("text"))
    merged = clustered.groupBy("cluster").agg(
        F.min(master).alias("master"), F.min(longest).alias("longest"),
        F.min(image).alias("image"), F.count("*").alias("copies"),
    )
    own = F.when(F.col("master.image") != "", F.col("master.image"))
    return merged.withColumn("imagen_url", F.coalesce(own, F.col("image.imagen_url"), F.col("master.image")))


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """One fused row per cluster: master, longest description, first image.

    Returns (cluster, id, descripcion, imagen_url, copies).
    """
    return _merged(clustered, text_size(), F.col("descripcion")).select(
        "cluster", F.col("master.r.id").alias("id"), F.col("longest.text").alias("descripcion"), "imagen_url", "copies")


def table_masters(df: DataFrame, *, threshold: float = v.TABLE_MATCH_SCORE) -> DataFrame:
    """(id, text_id, text_size, odd_text, imagen_url, own_image, copies): the master of every cluster of the table.

    ``text_id`` is the row whose text the master takes.  Texts stay where they are: only their sizes
    go through the clusters, but for rows without an id, whose text is ``odd_text``.
    """
    text = F.struct("id", F.when(F.col("id").isNull(), F.col("descripcion")).alias("odd"))
    slim = settle(_table_rows(df).select("block", "title", "id", "organiza", "imagen_url", text_size().alias("size"), text.alias("text")))
    return settle(_merged(_star_clusters(slim, threshold=threshold), F.col("size"), F.col("text")).select(
        F.col("master.r.id").alias("id"), F.col("longest.text.id").alias("text_id"), (-F.col("longest.size")).alias("text_size"),
        F.col("longest.text.odd").alias("odd_text"), "imagen_url", F.col("master.image").alias("own_image"), "copies"))


def clean_table(df: DataFrame, *, threshold: float = v.TABLE_MATCH_SCORE) -> DataFrame:
    """The table without duplicates; masters carry the best text and image of their copies.

    ``id`` is the key of the table; rows without one are never left out.
    """
    masters = table_masters(df, threshold=threshold)
    longer = masters.filter(~F.col("text_id").eqNullSafe(F.col("id"))).select("id", "text_id", "text_size")
    texts = df.select(F.col("id").alias("text_id"), text_size().alias("text_size"), F.col("descripcion").alias("found"))
    found = longer.join(texts, ["text_id", "text_size"]).groupBy("id").agg(F.min("found").alias("found"))
    fused = masters.filter("id IS NOT NULL").join(found, "id", "left").select(
        "id", F.coalesce("odd_text", "found").alias("best_text"), F.col("imagen_url").alias("best_image"), F.lit(True).alias("is_master"))
    # Rows that are in a cluster and not its master go.
    kept = df.join(fused, "id", "left").filter(
        F.col("is_master") | F.col("id").isNull() | is_generic_title(F.col("nombre")))
    return kept.select(*[
        F.coalesce("best_text", c).alias(c) if c == "descripcion"
        else F.when(F.col("is_master"), F.col("best_image")).otherwise(F.col(c)).alias(c) if c == "imagen_url"
        else F.col(c)
        for c in df.columns
    ])


# ------------------------------------------------------------ exact keys
def occurrence_groups(df: DataFrame, numbered: bool = False) -> DataFrame:
    """Group id shared by equal title, date and venue.

    The id is a hash of the key.  ``numbered=True`` gives ``group_1``,
    ``group_2``, ... by first appearance: the groups, not the rows, are numbered,
    in range partitions with an offset per partition, so no task sees them all.
    """
    keyed = df.withColumn("key", occurrence_key(F.col("nombre"), F.col("fecha_iso"), F.col("lugar")))
    if not numbered:
        return keyed.withColumn("event_group_id", F.sha2("key", 256)).drop("key")
    groups = keyed.groupBy("key").agg(F.min("id").alias("first_id"))
    numbers = number_rows(groups, ["first_id"], "n")
    named = numbers.select("key", F.concat(F.lit("group_"), F.col("n").cast("string")).alias("event_group_id"))
    return keyed.join(named, "key").drop("key")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in global order, without a single-task window.

    Rows are range-partitioned and sorted; each partition is numbered on its own
    and shifted by the sizes of the partitions before it (one row each).
    """
    spread = settle(
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    sizes = spread.groupBy("part").count()
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    local = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return (
        spread.withColumn("place", local).join(F.broadcast(shifts), "part")
        .withColumn(name, F.col("place") + F.col("shift")).drop("part", "place", "shift")
    )


def fingerprint_text(df: DataFrame, *, run: str, text: str, order: Sequence[str], size: int = 200) -> DataFrame:
    """Null out a text whose first ``size`` characters an earlier row of the run has.

    The first owner per fingerprint is an ordered minimum, combined before the
    shuffle; every row is then compared with its owner's order key.
    """
    mark = F.sha2(strip(F.substring(F.col(text), 1, size)), 256)
    place = F.struct(*[F.col(c) for c in order])
    keyed = df.withColumn("mark", mark).withColumn("place", place)
    owners = keyed.filter(F.col("mark").isNotNull()).groupBy(run, "mark").agg(F.min("place").alias("owner"))
    # Rows without text have no owner; a key of their own keeps them out of one task.
    return (
        keyed.withColumn("mark", F.coalesce("mark", no_match_key())).join(owners, [run, "mark"], "left")
        .withColumn(text, F.when(F.col("place") == F.col("owner"), F.col(text)))
        .drop("mark", "place", "owner")
    )


def first_new_text(candidates: DataFrame, *, run: str, order: Sequence[str], place: str, text: str, size: int = 200) -> DataFrame:
    """The candidate text that each owner takes: its first, in ``place`` order, whose first ``size``
    characters no earlier owner of the run took.  Owners without any are left out.

    The sequential rule as rounds: each owner offers its first text still open to it, each text
    goes to the earliest owner that offers it, and the others go on to their next.  A text once
    lost stays lost, so the rounds follow the longest chain of refusals, not the number of owners.
    All sides grow with the candidates, so none is broadcast and nothing but counts reaches the driver.
    """
    owner = F.struct(*[F.col(c) for c in order])
    every = settle(candidates.withColumns({"_mark": F.xxhash64(strip(F.substring(F.col(text), 1, size))), "_owner": owner}))
    slim = every.select(run, "_owner", F.col(place).alias("_place"), "_mark")
    while True:
        offers = settle(slim.groupBy(run, "_owner").agg(F.min(F.struct("_place", "_mark")).alias("o")).select(run, "_owner", "o.*"))
        holders = offers.groupBy(run, "_mark").agg(F.min("_owner").alias("_holder"))
        lost = settle(offers.join(holders.hint("merge"), [run, "_mark"]).filter("_owner <> _holder").select(run, "_owner", "_place"))
        if lost.isEmpty():
            taken = offers.select(run, "_owner", F.col("_place").alias(place), "_mark")
            return every.join(taken.hint("merge"), [run, "_owner", place, "_mark"], "left_semi").drop("_mark", "_owner")
        slim = settle(slim.join(lost.hint("merge"), [run, "_owner", "_place"], "left_anti"))
