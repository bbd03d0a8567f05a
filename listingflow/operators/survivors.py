"""Ranking and survivorship: which copy of a listing is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab as v
from ..functions.flags import is_generic_place
from ..functions.text import fold, strip


def value_of(key: Column, pairs, default) -> Column:
    """Literal look-up of a source name."""
    out = F.lit(default)
    for name, value in reversed(pairs):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key.

    Spark puts a group limit below the shuffle, so a key that holds a third of
    all rows sends at most ``n`` rows per map task.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def text_size(name: str = "descripcion") -> Column:
    return F.coalesce(F.length(F.col(name)), F.lit(0))


def survivor_rank() -> Column:
    """Order of copies: folded title, specific place first, longest text first, id."""
    return F.struct(
        fold(F.col("nombre")).alias("t"), is_generic_place(F.col("lugar")).alias("g"),
        (-text_size()).alias("d"), F.col("id"),
    )


def keep_first(df: DataFrame) -> DataFrame:
    """One row per (source, url, date, hour): the first in survivor order; nulls are equal."""
    hour = F.coalesce(F.col("hora"), F.lit(""))
    keyed = df.withColumn("_hour", hour).withColumn("_rank", survivor_rank())
    return keep_best(keyed, ["organiza", "url_venta", "fecha_iso", "_hour"], [F.col("_rank")]).drop(
        "_hour", "_rank"
    )


def quality_score(sources=v.SOURCE_SCORES, default: int = v.DEFAULT_SOURCE_SCORE) -> Column:
    """Source preference plus points for hour, price, place and text length."""
    place = strip(F.coalesce(F.col("lugar"), F.lit("")))
    hour = strip(F.coalesce(F.col("hora"), F.lit("")))
    return (
        value_of(F.col("organiza"), sources, default)
        + F.when(hour != "", 10).otherwise(0)
        + F.when(F.col("precio_num").isNotNull(), 10).otherwise(0)
        + F.when(place == "", 0).when(is_generic_place(place), 2).otherwise(20)
        + F.least(F.floor(text_size() / 100), F.lit(10)).cast("int")
    )


def best_of_group(df: DataFrame, group: str) -> DataFrame:
    """Highest score per group; ties go to the first in survivor order."""
    ranked = df.withColumn("_score", quality_score()).withColumn("_rank", survivor_rank())
    return keep_best(ranked, [group], [F.col("_score").desc(), F.col("_rank")]).drop("_rank", "_score")


def master_rank(priorities=v.SOURCE_PRIORITIES, default: int = v.DEFAULT_SOURCE_PRIORITY, size: Column | None = None) -> Column:
    """Order inside a duplicate cluster: source priority, longest text, id; ``size`` where the text is not at hand."""
    return F.struct(
        value_of(F.col("organiza"), priorities, default).alias("p"),
        (-(text_size() if size is None else size)).alias("d"), F.col("id"),
    )


def master_of_cluster(df: DataFrame, group: str) -> DataFrame:
    return keep_best(df, [group], [master_rank()])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in arrival order."""
    return keep_best(df, keys, [F.col(c) for c in order])


def top_n_per_day(df: DataFrame, n: int, day: str = "fecha_iso") -> DataFrame:
    """First ``n`` listings of each day and how many more there are.

    The totals are a partial aggregate and the listing side is limited before
    its shuffle; the two meet in a join on the day.
    """
    hour = F.coalesce(F.col("hora"), F.lit(""))
    dated = df.filter(F.col(day).isNotNull())
    place = F.row_number().over(W.partitionBy(day).orderBy(hour, "id"))
    shown = dated.withColumn("place", place).filter(F.col("place") <= n)
    totals = dated.groupBy(day).agg(F.count("*").alias("total"))
    rest = F.greatest(F.col("total") - n, F.lit(0))
    return shown.join(totals, day).withColumn("rest", rest)
