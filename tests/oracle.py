"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python -m tests.oracle [--sf 0.01] [--plan] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import os
import time

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.isoformat(sep=" ")
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    return x


def key(row):
    return tuple((x is not None, str(type(x).__name__), str(x)) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, name, fn, sql, sf_dir, plan=False):
    t = time.time()
    df = fn(spark, sf_dir)
    if plan:
        df.explain("formatted")
    left = rows_of(df.columns, df.collect())
    spent = time.time() - t
    if sql is None:
        return f"rows  {name}: {len(left[1])} rows, {spent:.2f}s"
    t = time.time()
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck = time.time() - t
    types = {c: t for c, t in df.dtypes}
    if left == right:
        empty = " EMPTY" if not left[1] else ""
        return f"ok    {name}: {len(left[1])} rows, {spent:.2f}s (duckdb {duck:.2f}s){empty}"
    out = [f"DIFF  {name}: spark {len(left[1])} duckdb {len(right[1])} columns {left[0]} vs {right[0]} {types}"]
    a, b = set(left[1]), set(right[1])
    out += [f"   spark only : {r}" for r in sorted(a - b, key=key)[:3]]
    out += [f"   duckdb only: {r}" for r in sorted(b - a, key=key)[:3]]
    return "\n".join(out)


def main():
    from listingflow.catalog import ORACLES, QUERIES
    from listingflow.session import spark_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--plan", action="store_true")
    args = ap.parse_args()
    sf_dir = f"{DATA}/sf{args.sf}"
    spark = spark_session("oracle", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in args.names or QUERIES:
        if name not in QUERIES:
            continue
        try:
            print(compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir, args.plan), flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
