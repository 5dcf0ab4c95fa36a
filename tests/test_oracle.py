"""Every registered query that has a SQL twin, value by value on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from modalweave.plans.catalog import QUERIES
from modalweave.plans.oracle import ORACLE
from tools.check import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    verdict = compare(spark, con, SMALL, QUERIES[name], ORACLE[name])
    assert verdict.startswith("ok"), verdict


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    row = entry(spark).collect()
    assert len(row) == 1 and row[0]["n_folds"] == 3
