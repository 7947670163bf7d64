from __future__ import annotations

import pytest

import __spark_entry__
from brindle.plans.catalogue import ORACLE, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown_and_pruning(spark, sf):
    plan = QUERIES["facet_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(p_brand,Brand#13)" in plan and "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size" in plan


@pytest.mark.parametrize("partitions", [1, 16])
def test_results_do_not_depend_on_partitions(spark, sf, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for name in ("hybrid_topk", "parent_collapse", "staged_budget", "manifest_fingerprint"):
            check(spark, sf, QUERIES[name], ORACLE[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
