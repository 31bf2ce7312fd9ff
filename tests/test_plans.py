"""Properties of the physical plans that matter at scale."""

import contextlib
import io

import pytest

from tillscope.operators.baskets import collect_baskets
from tillscope.operators.lifetime import event_log, purchase_history
from tillscope.plans.catalogue import QUERIES
from tillscope.plans.test_tables import order_lines
from tillscope.sources.order_lines import VALUE, read_order_lines

LAZY = [
    "agg_top_customers",
    "agg_basket_summary",
    "agg_summary_numeric",
    "clu_centroid_distance",
    "clv_cbs",
    "clv_independence",
    "clv_pipeline",
    "clv_spend_distribution",
    "join_cooccurrence",
    "join_semi",
    "rfm_segment_medians",
    "rfm_table",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, data, name):
    plan = _plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_not_a_full_sort(spark, data):
    plan = _plan(QUERIES["agg_top_customers"](spark, data))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_scan_reads_only_needed_columns(spark, data):
    plan = _plan(order_lines(spark, data, ["customer_id", VALUE]))
    assert "p_partkey" not in plan and "c_custkey" not in plan
    assert "l_quantity" not in plan and "o_totalprice" not in plan


def test_date_filter_reaches_the_scan(spark, data, tmp_path):
    path = str(tmp_path / "lines")
    order_lines(spark, data).write.parquet(path)
    lines = read_order_lines(spark, path).where("date < DATE '1999-01-01'").select("customer_id")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        lines.explain("formatted")
    plan = out.getvalue()
    assert "LessThan(date" in plan
    assert "product_title" not in plan


def test_lifetime_history_needs_two_shuffles(spark, data):
    """On a flat table: lines to customer-days, customer-days to customers."""
    flat = order_lines(spark, data, ["customer_id", "date", VALUE])
    flat = spark.createDataFrame(flat.limit(10).collect(), flat.schema)
    plan = _plan(purchase_history(event_log(flat, "1999-01-01"), "1999-01-01"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_baskets_need_one_shuffle(spark, data):
    """On a flat table: a task sends each of its orders once, with distinct items."""
    flat = order_lines(spark, data, ["order_id", "product_title"])
    flat = spark.createDataFrame(flat.limit(10).collect(), flat.schema)
    plan = _plan(collect_baskets(flat))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_collect_set" in plan
