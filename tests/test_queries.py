"""Every registered query of the reference's operators against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from sievegrid.plans import catalog, rulebook  # noqa: F401
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hybrid_plan(spark):
    """The cuts reach down to window group limits, and only wanted columns are read."""
    plan = catalog.bm25_topk(spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan.replace(",lang:string", "").replace(",source:string", "")
    assert "Python" not in plan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
