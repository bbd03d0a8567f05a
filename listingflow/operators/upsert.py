"""Keys, upsert and the life cycle of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as v
from ..functions.text import fold, strip

# Columns an incoming row overwrites, even by null.
OVERWRITTEN = [
    "nombre", "fecha_raw", "fecha_iso", "estilo", "imagen_url", "descripcion", "latitud",
    "longitud", "source_id", "precio_num", "hora", "lugar", "url_venta",
]
# Columns an incoming row sets only when it has a value.
SET_WHEN_GIVEN = ["event_group_id", "quality_flags", "field_confidence"]
INSERT_ONLY = ["organiza", "source_priority"]


def hash_key(variant: str = "ingest") -> Column:
    """SHA-256 key of a listing.

    ``ingest``: source, folded title, date, hour, folded place.
    ``publish``: source, url, date, hour; a missing value reads ``None``.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    if variant == "ingest":
        parts = [text("organiza"), fold(F.col("nombre")), text("fecha_iso"),
                 strip(F.coalesce("hora", F.lit(""))), fold(F.col("lugar"))]
    elif variant == "publish":
        parts = [text("organiza"), text("url_venta"), text("fecha_iso"), text("hora")]
    else:
        raise ValueError(f"unknown key variant: {variant}")
    return F.sha2(F.concat_ws("|", *parts), 256)


def _given(name: str, dtype: str) -> Column:
    c = F.col(name)
    if dtype.startswith(("array", "map")):
        return F.when(F.size(c) > 0, c)
    return F.when(c != "", c)


def fold_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row per key of a batch: the last row wins; optional columns keep their
    last given value and insert-only ones their first.  Rows of equal ``order`` go by
    the hash of all their values, so the result doesn't depend on the order they come in.
    All are ordered aggregates, so a repeated key is combined before the shuffle."""
    types = dict(batch.dtypes)
    at = F.struct(F.col(order), F.xxhash64(*[c for c, t in types.items() if "map<" not in t]))
    last = F.max_by(F.struct(*OVERWRITTEN), at).alias("last")
    given = [
        F.max_by(_given(c, types[c]), F.when(_given(c, types[c]).isNotNull(), at)).alias(c)
        for c in SET_WHEN_GIVEN
    ]
    first = [F.min_by(c, at).alias(c) for c in INSERT_ONLY]
    return batch.groupBy("hash_id").agg(last, *given, *first).select(
        "hash_id", "last.*", *SET_WHEN_GIVEN, *INSERT_ONLY
    )


def upsert(target: DataFrame, batch: DataFrame, *, now: Column, order: str) -> DataFrame:
    """Target with the batch merged by ``hash_id``.

    One full outer join on the key, which shuffles the target rows it is given: callers pass
    only the key buckets the batch touches (see ``streaming.upsert_stream``).
    """
    new = fold_batch(batch, order).withColumn("_new", F.lit(True))
    old = target.withColumn("_old", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), "hash_id", "full_outer")
    hit, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = {}
    for c in target.columns:
        o = F.col(f"o.{c}") if c != "hash_id" else F.col("hash_id")
        n = F.col(f"n.{c}") if c in new.columns and c != "hash_id" else None
        if c in OVERWRITTEN:
            out[c] = F.when(hit, n).otherwise(o)
        elif c in SET_WHEN_GIVEN:
            out[c] = F.coalesce(n, o)
        elif c in INSERT_ONLY:
            out[c] = F.when(known, o).otherwise(n)
        elif c == "enriquecido":
            out[c] = F.when(hit, F.lit(False)).otherwise(o)
        elif c == "last_seen_at":
            out[c] = F.when(hit, now).otherwise(o)
        elif c == "estado":
            out[c] = F.when(known, o).otherwise(F.lit("upcoming"))
        elif c == "id":
            out[c] = F.when(known, o).otherwise(F.xxhash64("hash_id"))
        else:
            out[c] = o
    return joined.select(*[expr.alias(c) for c, expr in out.items()])


def upsert_counters(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys of the batch that are new and that exist."""
    keys = batch.select("hash_id").distinct()
    known = target.select("hash_id").distinct().withColumn("known", F.lit(True))
    return keys.join(known, "hash_id", "left").agg(
        F.count(F.when(F.col("known").isNull(), 1)).alias("insertados"),
        F.count("known").alias("actualizados"),
    )


def mark_past(df: DataFrame, as_of: Column, recompute: bool = False) -> DataFrame:
    """Dated rows before ``as_of`` become past; ``recompute`` derives both states anew."""
    past = F.col("fecha_iso") < as_of
    if recompute:
        state = F.when(F.col("fecha_iso") >= as_of, F.lit("upcoming")).otherwise(F.lit("past"))
    else:
        state = F.when(past, F.lit("past")).otherwise(F.col("estado"))
    return df.withColumn("estado", state)


def replace_future(target: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """History before ``as_of`` stays, the future is what ``new`` says."""
    return target.filter((F.col("fecha_iso") < as_of) | F.col("fecha_iso").isNull()).unionByName(
        new, allowMissingColumns=True
    )


def drop_long_courses(df: DataFrame, as_of: Column, span: str = "span") -> DataFrame:
    """Courses and past rows out; a run that has begun loses its single date."""
    start, end = F.col(f"{span}.start"), F.col(f"{span}.end")
    over = F.coalesce((start < as_of) & ~F.coalesce(end >= as_of, F.lit(False)), F.lit(False))
    return df.filter(~F.col(f"{span}.is_course") & ~over).withColumn(
        "fecha_iso", F.when(start >= as_of, start)
    )


def mark_stale(df: DataFrame, now: Column, days: int) -> DataFrame:
    """Flag listings not seen for ``days`` days."""
    return df.withColumn("stale", F.datediff(now, F.col("last_seen_at")) > days)
