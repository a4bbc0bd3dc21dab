"""Queries against their SQL, and the rest for rows."""

import pytest

from glyphspark.file_queries import ORACLES, QUERIES
from tests.oracle import compare

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, D), ORACLES[name], D) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0
