"""Rows of one page, field, layer and position that differ in value: the first in the table counts, as in the SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from listingflow.catalog import ORACLES, QUERIES

COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
TIED = [(1, 3, 5, 4, 30.0), (1, 7, 5, 8, 5.0), (1, 3, 5, 4, 15.0), (2, 7, 5, 4, 5.0), (2, 3, 5, 4, 30.0), (3, 3, 9, 4, 5.0), (3, 3, 5, 4, 15.0)]


@pytest.mark.parametrize("rows", [TIED, TIED[::-1]])
def test_the_first_tied_row_gives_the_value(spark, tmp_path, rows):
    pq.write_table(pa.table(dict(zip(COLUMNS, zip(*rows)))), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    found = QUERIES["layered_facts"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLES["layered_facts"]).fetchall())
