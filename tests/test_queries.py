"""Every registered query against its SQL in the checking engine."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from check_queries import compare, connect
from ledgerloom.plans import catalog
from tests.conftest import SMALL

PLANS, SQL = {key: catalog.runnable(plan) for key, plan in catalog.PLANS.items()}, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, key):
    assert compare(spark, con, key, PLANS[key], SQL[key], SMALL) is None


@pytest.mark.parametrize("key", sorted(set(PLANS) - set(SQL)))
def test_query_runs(spark, key):
    df = PLANS[key](spark, SMALL)
    assert df.columns and df.count() > 0


def test_every_statement_has_a_plan():
    assert set(SQL) <= set(PLANS)


def test_entry(spark):
    assert {"company_id", "section", "label", "value"} <= set(entry(spark).columns)
