"""Queries of the text operators that SQL can express, against their twins."""

import pytest

from tests.compare import connect, differences
from tests.llm.conftest import SF
from tidemark.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    problem, rows = differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert not problem, problem
    assert rows
