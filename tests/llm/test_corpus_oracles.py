"""Every corpus query against its SQL on the smallest data."""

from pathlib import Path

import pytest

from axonframe.llm.queries import ORACLE, QUERIES
from suite.base import Query
from suite.check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    verdict, rows = compare(spark, duck(SF), SF, Query(QUERIES[name], ORACLE[name]))
    assert verdict == "ok" and rows > 0
