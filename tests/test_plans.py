"""Physical plans: what must be pushed down, pruned or avoided."""

import pytest
from pyspark.sql import functions as F

from starslice import workload
from starslice.operators import ranking as K
from starslice.plans.spec import SliceSpec
from starslice.sources import driver_tables as D

QUERIES = workload.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slice_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["class_filter"](spark, sf_dir))
    assert "In(l_returnflag, [A,no-such-class])" in text and "EqualTo(l_linestatus,O)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in text
    assert "l_tax" not in text


def test_one_pass_for_many_metrics(spark, sf_dir):
    df = QUERIES["season_stats"](spark, sf_dir)
    assert plan(df).count("lineitem.parquet") == 1


def test_cells_are_aggregated_before_subtotals(spark, sf_dir):
    text = plan(D.fact(spark, sf_dir))
    generate = text.index("Generate")
    assert "partial_sum(qty" in text[generate:]  # partial aggregate sits below the expansion


@pytest.mark.parametrize("name", ["record_highest", "nearest_k", "name_search"])
def test_top_k_keeps_k_rows_per_task(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_no_python_and_no_product_in_any_plan(spark, sf_dir):
    """Plans of queries that are cheap to build; a broadcast nested loop may only meet a one-row or literal side."""
    for name in ("slice_filter", "fact_dim_join", "html_cells", "text_sections", "alias_resolve", "latest_wins", "point_in_polygon",
                 "filter_links", "ring_area", "albers_inverse", "pivot_series", "harvest_totals"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_extraction_needs_no_shuffle(spark, sf_dir):
    for name in ("html_cells", "text_sections", "clean_ints", "filter_links", "line_records", "header_order"):
        assert "Exchange" not in plan(QUERIES[name](spark, sf_dir)), name


def test_unbounded_rank_never_orders_a_whole_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("entity"), (F.col("id") % 97).alias("v"))
    text = plan(K.competition_rank(df, ["g"], "v"))
    assert "_bucket" in text.split("Window")[1]


def test_spec_is_reusable():
    base = SliceSpec(species="O", season="fall")
    assert base.patch(season="").season == "" and base.season == "fall"
