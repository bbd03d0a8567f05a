"""The batch refinery: from a listing table to publishable rows.

Stages: audit -> classify -> locate -> sanitize -> same-source dedupe -> fuzzy
clusters -> sessions -> best copy.  Up to the dedupe everything is one narrow
projection over the scan; the dedupe shuffles once, the clusters once on short
titles, and the survivors are joined back by id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import vocab as v
from ..operators.lookups import apply_enrichment, apply_labels, classify_by_table, classify_keywords, lookup_coords
from ..operators.quality import audit, canonical_rows, demote_and_cut, drop_gate, table_gates, watch_gates, watched_gates
from ..operators.resolve import CHUNK, fuzzy_cluster, session_survivors
from ..operators.survivors import keep_first
from ..session import settle


def prepare(
    df: DataFrame, *, gazetteer: DataFrame | None = None, labels: DataFrame | None = None,
    enrichment: DataFrame | None = None, page_venues: DataFrame | None = None,
    keywords=v.STARTER_KEYWORDS,
) -> DataFrame:
    """Audited, classified, enriched and located rows; ``keywords`` is a short list or a table."""
    classify = classify_by_table if isinstance(keywords, DataFrame) else classify_keywords
    out = classify(audit(df, page_venues), keywords)
    if labels is not None:
        out = apply_labels(out, labels)
    if enrichment is not None:
        out = apply_enrichment(out, enrichment)
    return lookup_coords(out, gazetteer).drop("geo_method")


def resolve(df: DataFrame, *, drafts: str = "pass", chunk: int = CHUNK) -> DataFrame:
    """One row per real event session, with the sources it was seen in.

    The rows are written once; the grouping stages read only the columns they
    need from there, and the survivors are picked from the same files.
    """
    return resolve_written(settle(keep_first(df)), drafts=drafts, chunk=chunk)


def resolve_written(rows: DataFrame, *, drafts: str = "pass", chunk: int = CHUNK) -> DataFrame:
    return session_survivors(fuzzy_cluster(rows, drafts=drafts, chunk=chunk), rows=rows, chunk=chunk)


def refine(df: DataFrame, as_of: dt.date, *, drafts: str = "pass", gates: bool = True, **tables) -> DataFrame:
    """All stages; ``tables`` are the optional inputs of :func:`prepare`.

    With ``gates`` the share of generic titles is measured before they are demoted and the
    past is cut, in the one pass that prepares and writes the rows, and the run stops where
    it is too high.
    """
    ready, metrics = canonical_rows(prepare(df, **tables)), Observation("gates")
    if gates:
        ready = watch_gates(ready, metrics)
    rows = settle(keep_first(demote_and_cut(ready, F.lit(as_of))))
    if gates:
        require_gates(watched_gates(df.sparkSession, metrics))
    return resolve_written(rows, drafts=drafts)


def gate_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Gate rows of a refinery run, to be checked before publishing."""
    return table_gates(after).unionByName(drop_gate(before, after))


def require_gates(gates: DataFrame) -> None:
    """Raise when a gate says ``abort`` or ``error`` (a handful of rows)."""
    failed = gates.filter(F.col("level").isin("abort", "error")).collect()
    if failed:
        raise RuntimeError("quality gates failed: " + ", ".join(f"{r.gate}={r.value:.1f}" for r in failed))
