"""Every core query against its oracle on the smallest tables."""

import pytest

from changelake.plans.catalogue import ORACLES, QUERIES
from tests.compare import DATA, oracle, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    assert name in ORACLES
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(oracle(ORACLES[name]))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
