"""Every registered query against its SQL on the smallest given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from oracle import compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
#: The training-data operators have tests of their own.
QUERIES = {name: f for name, f in contract.queries().items() if not name.startswith("op") and name != "pipeline"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    rows, _, problem = compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert problem is None
    assert rows > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
