"""Physical-plan properties the scale design relies on."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = E.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_pushes_filters_and_limits_before_shuffle(spark):
    p = plan(QUERIES["q09_knn_search"](spark, SF_SMALL))
    assert "PushedFilters: [In(lang, [en,fr])" in p
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in p and "LessThan(ts,2024-01-11T00:00)" in p
    assert "MapInArrow" in p
    assert p.count("WindowGroupLimit") == 4  # two merge levels: each partial (before the exchange) + final
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


@pytest.mark.parametrize("name", ["q15_facets", "q16_facet_any", "q17_approx_terms"])
def test_multi_field_aggregates_scan_once(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert p.count("documents.parquet") == 1


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "q28_facet_refresh"))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDFs


def test_topic_counts_pre_aggregate(spark):
    p = plan(QUERIES["q18_topic_counts"](spark, SF_SMALL))
    assert "partial_count" in p
