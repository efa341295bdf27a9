"""Queries of the text operators against their SQL, and what the driver's contract asks of all of them."""

import pytest

from souklens.llm.queries import ORACLES, QUERIES
from tests.compare import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
