"""Named queries against their SQL. ``python -m tests.compare <sf_dir>`` runs all of them at any scale."""

import pytest

import __spark_entry__ as entry
from spendlens.plans.catalog import QUERIES
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
#: A least-norm fit of fewer weeks than features; tests/test_resampling.py holds it against numpy.
WITHOUT_SQL = {"weekly_metrics", "weekly_coefficients"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() - WITHOUT_SQL <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WITHOUT_SQL))
def test_query_matches_sql(spark, connection, name):
    assert differences(entry.queries()[name](spark, SF), connection, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5
