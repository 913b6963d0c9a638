"""Every registered query next to its SQL on the smallest tables, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from checks import compare
from checks.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ok, note = compare.check(spark, duck, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert ok, note
    assert "TYPES" not in note, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["j1_fact_candidates", "j2_resolve_all", "j3_match_myths", "j3_match_large_base", "j18_myth_context", "j24_search_entities",
                                  "j13_bm25_search", "a21_propaganda", "j8_check_anachronisms", "g5_related", "a6_aggregate_sources", "w3_mark_duplicates"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from claimspark.operators.myths import list_myths
    from checks.inputs import table

    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as ordinal", "p_type as category", "p_brand as era", "p_size as popularity")
    plan = list_myths(parts, category="PROMO")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan and "p_name" not in plan


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["claim_id", "overall_status"] and df.count() == 1500
