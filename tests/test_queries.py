"""Every registered query against its SQL, and controls that the SQL can fail."""

import pytest
from compare import both_differences

from workload.oracle import oracle_sql
from workload.registry import queries

EXPECTED = oracle_sql()


def test_every_query_has_an_expectation():
    assert set(EXPECTED) == set(queries())


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_matches_sql(spark, sf_dir, name):
    wrong, altered = both_differences(spark, sf_dir, queries()[name], EXPECTED[name])
    assert wrong is None
    # the same SQL over tables without two rows each expects something else
    assert altered is not None
