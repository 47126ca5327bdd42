"""Plans: filters and columns reach the scan, no Cartesian product, no row-at-a-time Python."""

import pytest

from textloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_slow_nodes(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_columns_are_pruned(spark):
    text = plan(catalog.queries()["agg7_consensus"](spark, SF))
    assert "l_extendedprice" not in text and "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string>" in text


def test_filters_are_pushed(spark):
    text = plan(catalog.queries()["sto8_ledger_projection"](spark, SF))
    assert "GreaterThan(c_acctbal,0.0)" in text
