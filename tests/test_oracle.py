"""Every registered query against its SQL in DuckDB on the smallest data."""

from pathlib import Path

import pytest

from suite import load_all
from suite.check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = load_all()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, rows = compare(spark, con, SF, QUERIES[name])
    assert verdict in ("ok", "rows"), verdict
    if verdict == "rows":
        assert rows > 0


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.FLAGSHIP in e.queries()
