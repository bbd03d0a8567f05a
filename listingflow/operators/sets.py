"""Union, fallback and split of listing frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_sources(frames: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Bag union of all sources by column name, and the names of those that failed to build.

    Raises ValueError when none could be built.
    """
    built, failed = [], []
    for name, frame in frames.items():
        try:
            built.append(frame() if callable(frame) else frame)
        except Exception:  # noqa: BLE001 - a broken source must not stop the others
            failed.append(name)
    if not built:
        raise ValueError(f"no source could be built: {failed}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), built), failed


def fallback_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """``second`` only when ``first`` is empty, decided inside the plan."""
    some = first.limit(1).agg(F.count("*").alias("_n"))
    return first.unionByName(
        second.join(some.filter("_n > 0"), F.lit(True), "left_anti"), allowMissingColumns=True
    )


def split(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the predicate, and all others (null counts as not met)."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.filter(hit), df.filter(~hit)
