"""Every query of the catalog against its SQL, and the registry's rules."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.same import from_duckdb, rows
from vellumetry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(from_duckdb(SQL[name], sf_dir))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_banded_search_has_no_nested_loop(spark, sf_dir):
    plan = QUERIES["hamming_pairs_banded"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_page_summary_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in QUERIES["paginate_summary"](spark, sf_dir)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["image_totals"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.rpartition("ReadSchema")[2]


def test_lines_of_envelopes_are_dealt_once(spark, sf_dir, monkeypatch):
    """Lines are shuffled while they are narrow, into partitions that grow with them; pages are not shuffled again."""
    from vellumetry.plans import serving

    monkeypatch.setattr(serving, "PAGES", 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["envelopes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100 + 1
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(dealt) == 3 and all(f", {n})" in x for x in dealt if "REPARTITION_BY_NUM" in x) and sum("REPARTITION_BY_NUM" in x for x in dealt) == 1
