"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is run in full (all rows and columns computed, nothing collected).
Times are the best of $BENCH_RUNS runs after one warm-up of the session.  The inputs are
single files of one split each; they are first written as one file per core, outside the times.
"""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time

from listingflow.catalog import QUERIES
from listingflow.session import spark_session

HEADLINE = [
    "clean_text", "extract_price", "extract_date", "extract_hour", "extract_cards", "extract_jsonld",
    "lookup_coords", "classify_keywords", "detect_venue", "sanitize", "keep_first", "best_of_group",
    "upsert", "qa_report", "fuzzy_cluster", "session_survivors", "clean_table", "refine",
    "facet_counts", "grid", "nearest_page", "week", "related", "search_index", "publish_rows",
    "jsonld_rows",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def dealt_out(spark, sf_dir: str, files: int) -> str:
    """A folder with the same tables, each in so many files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).repartition(files).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = spark_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    inputs = dealt_out(spark, sf_dir, int(cpus))
    run(QUERIES["facet_counts"](spark, inputs))
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            run(QUERIES[name](spark, inputs))
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, total of best runs", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
