"""Scale properties of every registered question's physical plan (static plan, AQE off)."""

import pytest

from scales import SF_SMALL
from grainline.catalog import all_questions

QUESTIONS = all_questions()
TOP_N = ["q14_top_customer_per_region", "q24_top_two_per_region", "c_top_customer_share", "c_top_two_q1_share", "j_c07_best_month_vs_avg"]


def _plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # scan descriptions untruncated
    try:
        return QUESTIONS[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_no_pairwise_products(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", TOP_N)
def test_top_n_limits_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    "name,column",
    # the bound order_date is cast(o_orderdate as date): Catalyst unwraps the cast and pushes the range
    [("q20_quarter_region", "o_orderdate"), ("q21_weekday_revenue", "o_orderdate"), ("t_march_events", "ts"),
     ("q23_monthly_by_region", "o_orderdate"), ("c_top_two_q1_share", "o_orderdate"), ("b6_ship_lag_by_month", "o_orderdate"),
     ("j_q02_orders_2025", "o_orderdate"), ("j_q03_revenue_by_store_2025", "o_orderdate"), ("j_c03_basket_mix", "o_orderdate")],
)
def test_period_filters_reach_the_scan(spark, name, column):
    plan = _plan(spark, name)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "PushedFilters" in line]
    assert any(f"GreaterThanOrEqual({column}" in s and f"LessThan({column}" in s for s in scans), name
