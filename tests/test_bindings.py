"""Every binding DataFrame equals its SQL twin run by DuckDB on the raw tables."""

import pytest
from pyspark.sql import functions as F

from scales import SF_SMALL
from grainline.catalog.views import VIEWS, with_views
from grainline.functions.calendar import in_range
from grainline.sources.bindings import Bench, Shop, money
from oracle import compare


@pytest.mark.parametrize("name", list(VIEWS))
def test_binding_matches_sql(spark, duck_small, name):
    obj = Bench(spark, SF_SMALL) if name.startswith("b_") else Shop(spark, SF_SMALL)
    assert compare(getattr(obj, name[2:]), duck_small, with_views(f"select * from {name}")) is None


def test_no_row_is_dropped(spark):
    b = Bench(spark, SF_SMALL)
    raw = b.t
    assert b.orders.count() == raw("orders").count()
    assert b.order_items.count() == raw("lineitem").count()
    assert b.returns.agg(F.sum("amount")).first()[0] == raw("lineitem").where("l_returnflag = 'R'").agg(F.sum(money("l_extendedprice"))).first()[0]
    assert b.members.select("campaign_id").distinct().count() == raw("lineitem").select("l_suppkey").distinct().count()
    assert b.cities.select("city").distinct().count() == raw("customer").join(raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name").distinct().count()


def test_orders_in_equals_the_filter(spark):
    b = Bench(spark, SF_SMALL)
    for r in ("1997-08", "1997-09", "1998", ["1997-07-15", "1997-10-01"]):
        assert b.orders_in(r).exceptAll(b.orders.where(in_range("order_date", r))).isEmpty()
        assert b.orders_in(r).count() == b.orders.where(in_range("order_date", r)).count()
    assert b.orders_in("1997-08").isEmpty() and not b.orders_in("1997-09").isEmpty()


def test_components_of_sold_products_come_from_one_sort(spark, tmp_path):
    from grainline.sources.bindings import Shop

    rows = [(1, 5), (1, 5), (1, None), (1, None), (2, 6), (2, 7), (None, 5), (3, 8)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sold = spark.createDataFrame([(1,), (2,), (2,), (None,)], "sku long")
    got = Shop(spark, str(tmp_path)).supplies_of(sold)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Window" in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 5, 7), (1, None, None), (2, 6, 9), (2, 7, 3)], key=str)
