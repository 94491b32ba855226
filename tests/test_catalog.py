"""Every registered query against its SQL on the smallest data."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.compare import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not available")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(spark, duck, name):
    got = E.queries()[name](spark, SF).toPandas()
    if name not in E.oracle_sql():
        assert len(got)
        return
    a, b = canonical(got), canonical(duck.execute(E.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert (a.to_numpy() == b.to_numpy()).all()


def test_entry(spark):
    assert E.entry(spark).count() == 3
