"""Quality gates, the QA report and run-to-run regression checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import vocab as v
from ..functions.flags import (
    future_or_draft, is_blank_hour, is_garbage_row, is_generic_place, is_generic_title,
    is_junk_title, is_social,
)
from ..functions.parse import price_cap
from ..functions.text import any_contains, canonical_venue, strip_place_suffix
from .aggregates import share
from .lookups import apply_page_venue, detect_venue

# Gate -> (level, threshold in percent) steps, strongest first.
GATES = {
    "blank_hour": [("alert", 25.0)],
    "generic_titles": [("abort", 5.0)],
    "no_date": [("error", 40.0)],
    "generic_places": [("alert", 60.0)],
    "repeated_title": [("error", 15.0), ("alert", 5.0)],
    "drop_ratio": [("alert", 60.0)],
    "failed_sources": [("alert", 30.0)],
}
# QA metric -> highest accepted value.
QA_LIMITS = {
    "missing_fecha": 0.0, "missing_hora": 0.07, "missing_precio": 0.12, "missing_img": 0.08,
    "dupes_same_source": 0.0, "dupes_cross": 0.01, "titulos_basura": 0.0,
    "lugares_contaminados": 0.0, "precios_imposibles": 0.0, "horas_sentinel": 0.0,
    "borradores": 0.15,
}


def _level(gate: str, value: Column) -> Column:
    inclusive = gate == "drop_ratio"
    out = F.lit("ok")
    for level, limit in reversed(GATES[gate]):
        out = F.when(value >= limit if inclusive else value > limit, F.lit(level)).otherwise(out)
    return out


def _gate_rows(row: DataFrame, gates: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"),
                 F.lit(GATES[g][-1][1]).alias("threshold"), _level(g, F.col(g)).alias("level"))
        for g in gates
    ]
    return row.select(F.inline(F.array(*entries)))


def table_gates(df: DataFrame) -> DataFrame:
    """(gate, value, threshold, level) for blank hours, generic titles and places,
    missing dates and the most repeated title.

    Titles are counted first (partial aggregate), everything else is added up in
    the same pass, so one shuffle serves all gates.
    """
    confirmed = F.col("fecha_iso").isNotNull()
    per_title = df.groupBy("nombre").agg(
        F.count("*").alias("n"), F.count("fecha_iso").alias("dated"),
        F.count_if(confirmed & is_blank_hour(F.col("hora"))).alias("blank"),
        F.count_if(is_generic_place(F.col("lugar"))).alias("vague"),
    )
    row = per_title.agg(
        (100.0 * F.sum("blank") / F.nullif(F.sum("dated"), F.lit(0))).alias("blank_hour"),
        (100.0 * F.sum(F.when(is_generic_title(F.col("nombre")), F.col("n")).otherwise(0)) / F.sum("n")).alias("generic_titles"),
        (100.0 * (F.sum("n") - F.sum("dated")) / F.sum("n")).alias("no_date"),
        (100.0 * F.sum("vague") / F.sum("n")).alias("generic_places"),
        F.max(F.when(F.col("nombre").isNotNull(), F.col("n"))).alias("repeated_title"),
    )
    return _gate_rows(row, ["blank_hour", "generic_titles", "no_date", "generic_places", "repeated_title"])


def drop_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of rows lost between two stages."""
    b = before.agg(F.count("*").alias("b"))
    a = after.agg(F.count("*").alias("a"))
    row = b.join(a, F.lit(True)).select((100.0 * (F.col("b") - F.col("a")) / F.col("b")).alias("drop_ratio"))
    return _gate_rows(row, ["drop_ratio"])


def source_gate(df: DataFrame, expected: Sequence[str] = v.EXPECTED_SOURCES,
                source: str = "organiza") -> DataFrame:
    """Expected sources that delivered nothing, with the share they make up."""
    seen = df.select(source).distinct()
    wanted = df.sparkSession.createDataFrame([(s,) for s in expected], f"{source} string")
    row = wanted.join(seen.withColumn("ok", F.lit(1)), source, "left").agg(
        (100.0 * F.count_if(F.col("ok").isNull()) / F.count("*")).alias("failed_sources"),
        F.concat_ws(" + ", F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col(source))))).alias("missing"),
    )
    gate = _gate_rows(row, ["failed_sources"])
    return gate.join(row.select("missing"), F.lit(True))


def qa_report(export: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row of QA metrics over confirmed export rows, with failures and the verdict."""
    price = F.col("precio_num").try_cast("double")
    name = F.coalesce("nombre", F.lit(""))
    text_columns = [c for c, t in export.dtypes if t == "string"]
    null_cells = sum((F.col(c).isNull().cast("int") for c in export.columns), F.lit(0))
    token_cells = sum((F.coalesce(F.col(c).isin("nan", "NaN", "None"), F.lit(False)).cast("int") for c in text_columns), F.lit(0))
    flagged = export.select(
        "organiza", "url_venta", "fecha_iso", "hora", "nombre",
        F.col("fecha_iso").isNull().alias("no_date"),
        F.coalesce(F.col("hora") == v.HOUR_UNKNOWN, F.lit(True)).alias("no_hour"),
        F.coalesce(F.col("precio_num").cast("string") == v.PRICE_UNKNOWN, F.lit(True)).alias("no_price"),
        F.col("imagen_url").isNull().alias("no_image"),
        ((F.length(name) < 3) | F.lower(name).isin(*v.QA_JUNK_TITLES)).alias("junk"),
        any_contains(F.lower(F.coalesce("lugar", F.lit(""))), v.PLACE_LEAK_PHRASES).alias("leak"),
        (price > v.PRICE_LIMIT_QA).alias("costly"),
        F.col("hora").isin(*v.SENTINEL_HOURS).alias("sentinel"),
        (null_cells + token_cells).alias("cells"),
    )
    # One shuffle: rows per (title, date), inside it rows per same-source key.
    per_key = flagged.groupBy("nombre", "fecha_iso", "organiza", "url_venta", "hora").agg(
        F.count("*").alias("n"), F.sum("cells").alias("cells"),
        *[F.count_if(F.col(c)).alias(c) for c in
          ("no_date", "no_hour", "no_price", "no_image", "junk", "leak", "costly", "sentinel")],
    )
    same = per_key.groupBy("organiza", "url_venta", "fecha_iso", "hora").agg(F.sum("n").alias("n")).agg(
        F.sum(F.col("n") - 1).alias("dupes_same_source"))
    cross = per_key.groupBy("nombre", "fecha_iso").agg(F.sum("n").alias("n")).agg(
        F.sum(F.col("n") - 1).alias("cross"))
    totals = per_key.agg(
        F.sum("n").alias("confirmados"), F.sum("cells").alias("nan_en_export"),
        *[F.sum(c).alias(c) for c in
          ("no_date", "no_hour", "no_price", "no_image", "junk", "leak", "costly", "sentinel")],
    )
    count = drafts.agg(F.count("*").alias("n_drafts"))
    row = totals.join(same, F.lit(True)).join(cross, F.lit(True)).join(count, F.lit(True))
    n, total = F.col("confirmados"), F.col("confirmados") + F.col("n_drafts")
    row = row.select(
        total.alias("total_eventos"), n.alias("confirmados"), F.col("n_drafts").alias("borradores_n"),
        "nan_en_export",
        (F.col("no_date") / n).alias("missing_fecha"), (F.col("no_hour") / n).alias("missing_hora"),
        (F.col("no_price") / n).alias("missing_precio"), (F.col("no_image") / n).alias("missing_img"),
        F.col("dupes_same_source").cast("double").alias("dupes_same_source"),
        (F.col("cross") / n).alias("dupes_cross"), F.col("junk").cast("double").alias("titulos_basura"),
        F.col("leak").cast("double").alias("lugares_contaminados"),
        F.col("costly").cast("double").alias("precios_imposibles"),
        F.col("sentinel").cast("double").alias("horas_sentinel"),
        (F.col("n_drafts") / total).alias("borradores"),
    )
    failures = F.filter(
        F.array(*[F.when(F.col(m) > limit, F.lit(m)) for m, limit in QA_LIMITS.items()]),
        lambda x: x.isNotNull(),
    )
    return row.withColumn("failures", F.concat_ws(" + ", failures)).withColumn(
        "passed", F.col("failures") == ""
    )


def run_metrics(confirmed: DataFrame, drafts: DataFrame, *, timestamp: Column, elapsed: float) -> DataFrame:
    """KPI row of one run; the source distribution is a map."""
    both = confirmed.select("organiza", "hora", "precio_num", F.lit(True).alias("c")).unionByName(
        drafts.select("organiza", "hora", "precio_num", F.lit(False).alias("c")))
    no_hour = F.coalesce(F.col("hora").isin(v.HOUR_UNKNOWN, ""), F.lit(True))
    no_price = F.coalesce(F.col("precio_num").cast("string").isin(v.PRICE_UNKNOWN, ""), F.lit(True))
    per_source = both.groupBy("organiza").agg(
        F.count("*").alias("n"), F.count_if("c").alias("conf"),
        F.count_if(F.col("c") & no_hour).alias("h"), F.count_if(F.col("c") & no_price).alias("p"))
    n = F.nullif(F.sum("conf"), F.lit(0))
    pct = lambda name: F.coalesce(F.round(100.0 * F.sum(name) / n, 2), F.lit(0.0))
    return per_source.agg(
        F.sum("n").alias("total_eventos"), F.sum("conf").alias("totales_confirmados"),
        (F.sum("n") - F.sum("conf")).alias("totales_borradores"),
        pct("h").alias("pct_hora_vacia_en_conf"), pct("p").alias("pct_precio_vacio_en_conf"),
        F.map_from_entries(F.collect_list(F.struct("organiza", "n"))).alias("distribucion_fuentes"),
    ).select(timestamp.alias("timestamp"), F.lit(float(elapsed)).alias("elapsed_seconds"), "*")


def compare_runs(current: DataFrame, previous: DataFrame, key: str = "organiza") -> DataFrame:
    """(source, prev, cur) over the sources of both runs; a missing one counts 0."""
    return current.select(key, F.col("total").alias("cur")).join(
        previous.select(key, F.col("total").alias("prev")), key, "full_outer"
    ).select(key, F.coalesce("prev", F.lit(0)).alias("prev"), F.coalesce("cur", F.lit(0)).alias("cur"))


def source_regressions(compared: DataFrame) -> DataFrame:
    """Sources that collapsed to nothing or fell under 40 percent."""
    level = F.when((F.col("cur") == 0) & (F.col("prev") > 5), "critical").when(
        F.col("cur") < F.col("prev") * 0.4, "warning")
    return compared.withColumn("level", level).filter("level IS NOT NULL")


def total_regressions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fewer rows in total, or blank hours up by over five points (one row per run given)."""
    joined = current.select(F.col("total_eventos").alias("c_n"), F.col("pct_hora_vacia_en_conf").alias("c_h")).join(
        previous.select(F.col("total_eventos").alias("p_n"), F.col("pct_hora_vacia_en_conf").alias("p_h")), F.lit(True))
    return joined.select(
        (F.col("c_n") - F.col("p_n")).alias("diff_total"), (F.col("c_h") - F.col("p_h")).alias("diff_hora"),
        (F.col("c_n") < F.col("p_n")).alias("volume_alert"),
        ((F.col("c_h") - F.col("p_h")) > 5.0).alias("hour_alert"))


def audit(df: DataFrame, page_venues: DataFrame | None = None) -> DataFrame:
    """Garbage rows out, venues for generic places, absurd prices voided."""
    kept = df.filter(~is_garbage_row(F.col("nombre"), F.col("lugar")))
    kept = detect_venue(kept).withColumn("precio_num", price_cap(F.col("precio_num")))
    return apply_page_venue(kept, page_venues) if page_venues is not None else kept


def canonical_rows(df: DataFrame) -> DataFrame:
    """Social links out, junk titles without a date, titles and places canonical, prices capped."""
    kept = df.filter(~is_social(F.col("nombre"), F.col("url_venta")))
    return kept.withColumns({
        "fecha_iso": F.when(~is_junk_title(F.col("nombre")), F.col("fecha_iso")),
        "nombre": strip_place_suffix(F.col("nombre")),
        "lugar": canonical_venue(F.col("lugar")),
        "precio_num": price_cap(F.col("precio_num")),
    })


def staged_gates(df: DataFrame) -> DataFrame:
    """Blank hours and generic titles as they stand between the price cap and the date cut."""
    rows = canonical_rows(df).select("nombre", "lugar", "fecha_iso", "hora")
    return table_gates(rows).filter(F.col("gate").isin("blank_hour", "generic_titles"))


def watch_gates(rows: DataFrame, metrics: Observation) -> DataFrame:
    """Canonical rows as they are; whoever computes them also fills ``metrics`` for :func:`watched_gates`.

    The sums are collected on the way, in the pass that reads the rows anyhow.  A task that runs
    again may count twice, in both parts of a share.
    """
    dated = F.col("fecha_iso").isNotNull()
    return rows.observe(
        metrics, F.count(F.lit(1)).alias("rows"), F.count_if(dated).alias("dated"),
        F.count_if(dated & is_blank_hour(F.col("hora"))).alias("blank"), F.count_if(is_generic_title(F.col("nombre"))).alias("generic"),
    )


def watched_gates(spark: SparkSession, metrics: Observation) -> DataFrame:
    """The rows of :func:`staged_gates` from the sums of a finished pass."""
    found = metrics.get

    def share_of(part: str, whole: str) -> float | None:
        return 100.0 * found[part] / found[whole] if found.get(whole) else None

    row = spark.createDataFrame(
        [(share_of("blank", "dated"), share_of("generic", "rows"))], "blank_hour double, generic_titles double")
    return _gate_rows(row, ["blank_hour", "generic_titles"])


def demote_and_cut(rows: DataFrame, as_of: Column) -> DataFrame:
    """Generic titles of canonical rows become drafts, the past is cut off."""
    kept = rows.withColumn("fecha_iso", F.when(~is_generic_title(F.col("nombre")), F.col("fecha_iso")))
    return kept.filter(future_or_draft(F.col("fecha_iso"), as_of))


def sanitize(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows fit to publish: :func:`canonical_rows`, generic titles demoted to drafts, the past cut off.

    A single narrow projection between two filters; nothing shuffles.
    """
    return demote_and_cut(canonical_rows(df), as_of)


def audit_counters(df: DataFrame, page_venues: DataFrame | None = None) -> DataFrame:
    """What :func:`audit` does to a table: rows, garbage, prices voided, places found, of these on the listing's own page."""
    garbage = is_garbage_row(F.col("nombre"), F.col("lugar"))
    kept = df.filter(~garbage).withColumn("_before", F.col("lugar"))
    found = detect_venue(kept).withColumn("_detected", F.col("lugar"))
    if page_venues is not None:
        found = apply_page_venue(found, page_venues)
    left = df.agg(F.count("*").alias("total"), F.count_if(garbage).alias("basura_eliminada"))
    done = found.agg(
        F.count_if(~F.col("lugar").eqNullSafe(F.col("_before"))).alias("lugares_corregidos"),
        F.count_if(~F.col("lugar").eqNullSafe(F.col("_detected"))).alias("deep_scrape_hits"),
        F.count_if(F.col("precio_num").isNotNull() & price_cap(F.col("precio_num")).isNull()).alias("precios_corregidos"),
    )
    return left.join(done, F.lit(True))
