"""Trap liveness (K9): on the bound data every naive query gives a different answer from the truth.

The naive SQL lives only here, as in the reference. DuckDB runs both sides on sf0.01 (where every
planted case has witnesses); one trap is also checked through the Spark reconciliation operator.
"""

import pytest

from scales import SF_MID
from grainline.catalog import all_questions
from grainline.catalog.views import with_views
from grainline.operators import recon
from oracle import rows_of_duck

NAIVE = {
    # the year's months are cut before the total runs
    "t_all_time_running": """select month, cast(revenue as double) as revenue, cast(sum(revenue) over (order by month) as double) as running_total
        from b_months where year(month) = 1998""",
    # an order counts once for every campaign that reached its customer
    "t_bridge_email": """select o.region, cast(sum(o.amount) as double) as revenue from b_campaigns k
        join b_members m on m.campaign_id = k.id join b_orders_flat o on o.customer_id = m.customer_id where k.channel = 'email' group by o.region""",
    # orders and returns of a customer multiply each other
    "t_chasm": """with home as (select cu.id, re.name as region from b_customers cu left join b_regions re on re.id = cu.region_id)
        select region, cast(sum(o.amount) as double) as ordered, cast(sum(t.amount) as double) as returned
        from home left join b_orders o on home.id = o.customer_id left join b_returns t on home.id = t.customer_id group by region""",
    # a city's name is no key: it is listed in several regions
    "t_city_size": """select size_class, cast(sum(amount) as double) as revenue
        from b_orders_flat left join b_cities using (city) group by size_class""",
    # rows of the join are orders, not customers
    "t_count_after_join": "select tier, count(*) as customers from b_orders_flat where status = 'P' and tier is not null group by tier",
    # a customer's credit is added up once per order, and customers without orders are not there
    "t_fan_out_credit": """select region, count(distinct customer_id) as customers, cast(sum(credit) as double) as total_credit, count(*) as orders
        from b_orders_flat group by region""",
    # an order's amount is added up once per line
    "t_fan_out_items": """select region, cast(sum(amount) as double) as revenue, count(product_id) as lines
        from b_order_items, b_orders_flat where b_orders_flat.id = b_order_items.order_id group by region""",
    # the last day ends at its first instant
    "t_march_events": """select count(*) as events, cast(sum(amount) as double) as total_amount from b_events
        where event_ts between timestamp '2024-01-08' and timestamp '2024-01-14'""",
    # a month without orders has no row
    "t_monthly_gaps": """select month, cast(revenue as double) as revenue, cast(sum(revenue) over (order by month) as double) as running_total
        from b_months where year(month) = 1997""",
    # NOT IN a list that holds NULL is never true
    "t_never_returned": """select tier, count(*) as customers from b_customers
        where id not in (select customer_id from b_returns) group by 1""",
    # the share's base is every region's total, not the region's own
    "t_ok_share": """select region, cast(sum(amount) as double) / cast((select sum(amount) from b_orders) as double) as share
        from b_orders_flat where status = 'F' group by 1""",
    # an order of several categories counts in each, so the categories' counts do not add up to the orders
    "t_orders_per_category": """with per as (select category, count(distinct order_id) as orders from b_products p, b_order_items i where i.product_id = p.id group by category)
        select category, orders, (select sum(orders) from per) as total_orders from per""",
    # the row of a customer without orders counts as an order
    "t_orders_per_customer": """with rows_of_join as (select tier, c.id as customer from b_customers c left join b_orders on b_orders.customer_id = c.id)
        select tier, count(distinct customer) as customers, count(*) as orders, cast(count(*) as double) / count(distinct customer) as orders_per_customer
        from rows_of_join group by tier""",
    # the average of averages weighs regions alike
    "t_overall_aov": """with per as (select region, cast(sum(amount) as double) / count(*) as aov from b_orders_flat group by region)
        select region, aov, (select avg(aov) from per) as overall_aov from per""",
    # the first month's predecessor is cut off before it is looked back at
    "t_prev_month": """select month, cast(revenue as double) as revenue, cast(lag(revenue) over (order by month) as double) as previous_revenue
        from b_months where year(month) = 1998 and quarter(month) = 1""",
    # three rows are not three months where a month has none
    "t_rolling_gap": """select month, revenue_3m from (
          select month, cast(sum(revenue) over (order by month rows 2 preceding) as double) as revenue_3m from b_months)
        where month between date '1997-09-01' and date '1997-12-01'""",
    # regions without orders in the period have no row to be counted
    "t_zero_regions": "select region, count(*) as orders from b_orders_flat where order_date >= date '1998-01-01' and region is not null group by region",
}


def _same(con, a, b, tol=1e-9):
    ca, ra = rows_of_duck(con, a)
    cb, rb = rows_of_duck(con, b)
    if ca != cb or len(ra) != len(rb):
        return False
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for x, y in zip(sorted(ra, key=key), sorted(rb, key=key)):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                if abs(u - v) > tol * max(1.0, abs(u), abs(v)):
                    return False
            elif u != v:
                return False
    return True


@pytest.mark.parametrize("trap", sorted(NAIVE))
def test_trap_is_live(duck_mid, trap):
    truth = all_questions()[trap].oracle
    assert not _same(duck_mid, truth, with_views(NAIVE[trap])), f"{trap}: the naive query gives the truth"


def test_every_trap_has_a_naive_twin():
    traps = {n for n in all_questions() if n.startswith("t_")}
    assert traps == set(NAIVE)


def test_liveness_through_spark(spark, duck_mid):
    """K9 with the Spark operator: truth and naive differ while their columns still resolve."""
    truth = all_questions()["t_ok_share"].build(spark, SF_MID)
    naive_pdf = duck_mid.sql(with_views(NAIVE["t_ok_share"])).df()
    naive = spark.createDataFrame(naive_pdf)
    out = recon.is_live(truth, naive, ["region"], ["share"], tol=1e-9)
    assert out.ok, out.reason
