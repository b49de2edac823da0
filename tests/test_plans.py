"""Shape of the physical plans: no cross joins, pruned scans, pushed filters."""

import pytest

import __spark_entry__ as entry
from verdictframe import plans

SF_DIR = "/root/testdata/sf0.001"
BATCH = [name for name in plans.QUERIES if not name.startswith("stream_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_battle_stats_reads_what_it_needs(spark):
    text = plan(entry.queries()["battle_stats"](spark, SF_DIR))
    schema = text[text.index("ReadSchema: "):].split("\n")[0]
    assert "props" not in schema and "ts:" not in schema
    assert text.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from verdictframe.sources.views import view

    rows = view(spark, SF_DIR, "battles").filter(F.col("seq") > 100)
    assert "GreaterThan(event_id,100)" in plan(rows)


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["issues_per_repo"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


def test_category_cells_are_aggregated_before_they_multiply(spark):
    text = plan(entry.queries()["agreement_by_system_category"](spark, SF_DIR))
    assert text.index("explode(array(category") < text.index("partial_count(1)")  # printed top down
