"""Run corpus queries next to their SQL: python -m tests.llm.harness [--sf 0.01] [name ...]"""

import argparse

import __spark_entry__ as entry
from listingflow.session import spark_session
from tests.oracle import DATA, compare, connect


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    spark = spark_session("corpus", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{args.sf}"
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args.names or [q for q in queries if q.startswith("op") or q == "pipeline"]:
        print(compare(spark, con, name, queries[name], sql.get(name), sf_dir), flush=True)


if __name__ == "__main__":
    main()
