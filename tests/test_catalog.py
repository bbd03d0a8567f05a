"""Every registered query runs at the smallest scale; those with SQL must match it."""

import pytest

from listingflow.catalog import ORACLES, QUERIES
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    report = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert report.startswith(("ok", "rows")), report


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
