"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

import __spark_entry__ as entry  # noqa: E402
from lakeproof import suite  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import check
    return check.connect(SF)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, con, name):
    import check
    df = suite.QUERIES[name](spark, SF)
    wrong = check.differences(df, df.collect(), con, suite.SQL[name])
    assert wrong is None, wrong


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert suite.QUERIES.keys() == suite.SQL.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
