"""Queries against their SQL."""

import pytest

from glyphspark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01") > 0
