"""The order-database questions, bound to the driver's tables (see ``grainline.sources.bindings``).

Fixed binding values: year 2024 -> 1997 (holds the month without orders), 2025 -> 1998; status 'ok' ->
'F', 'bad' -> 'P'; tier 'bronze' -> 'BUILDING'; amounts are TPC-H order prices, so the money thresholds
are scaled (high spend > 2,000,000; a big order > 250,000; revenue bands of 1,000,000). Each question's
Spark plan is built from the library's operators; its oracle is independent SQL over the raw tables.
Money sums are exact decimals, cast to DOUBLE at the end on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainline.catalog.registry import question
from grainline.functions.aggregates import count_rows, weighted_avg
from grainline.functions.calendar import bucket, in_period, in_range, iso_weekday, last_complete
from grainline.functions.scalar import band, ratio
from grainline.operators import grain, periods, ranking, relations
from grainline.plans.sizing import bounded_broadcast
from grainline.plans.model import Catalog, Join, Measure, Model
from grainline.plans.spec import QuerySpec
from grainline.sources.bindings import Bench

# Fixed values of the binding (see module docstring).
OK, BAD, BRONZE, EMAIL = "F", "P", "BUILDING", "email"
HIGH_SPEND = 2_000_000
BIG_ORDER = 250_000
REVENUE_BAND_EDGES = (1_000_000, 2_000_000, 3_000_000)
Y2024, Y2025 = "1997", "1998"

AOV = Measure("aov", lambda: ratio(F.sum("amount"), count_rows()))  # D27: a saved measure


def dbl(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _bench(spark: SparkSession, sf_dir: str) -> Bench:
    return Bench(spark, sf_dir)


def models(spark: SparkSession, sf_dir: str) -> Catalog:
    """The order database's models and declared joins (the semantic layer's graph); built per call, so no frame outlives its session,
    and each model when it is first used."""
    b = _bench(spark, sf_dir)
    to_customers = {"customers": Join("customers", (("customer_id", "id"),))}
    return Catalog(
        lazy={
            "regions": lambda _: Model("regions", b.regions, ("id",), max_rows=Bench.REGION_ROWS),
            "customers": lambda _: Model(
                "customers",
                b.customers,
                ("id",),
                joins={"regions": Join("regions", (("region_id", "id"),)), "cities": Join("cities", (("city", "city"), ("region_id", "region_id")))},
            ),
            "cities": lambda _: Model("cities", b.cities, ("city", "region_id")),
            "orders": lambda _: Model("orders", b.orders, ("id",), joins=to_customers, time_col="order_date", within=b.orders_in, measures={"aov": AOV}),
            "returns": lambda _: Model("returns", b.returns, ("id",), joins=to_customers, time_col="return_date"),
            "order_items": lambda _: Model(
                "order_items", b.order_items, (), joins={"orders": Join("orders", (("order_id", "id"),)), "products": Join("products", (("product_id", "id"),))}
            ),
            "products": lambda _: Model("products", b.products, ("id",)),
            "campaigns": lambda _: Model("campaigns", b.campaigns, ("id",)),
            "campaign_members": lambda _: Model(
                "campaign_members", b.members, ("campaign_id", "customer_id"), joins={**to_customers, "campaigns": Join("campaigns", (("campaign_id", "id"),))}
            ),
            "events": lambda _: Model("events", b.events, ("id",), time_col="event_ts"),
            "orders_flat": lambda _: Model("orders_flat", b.orders_flat, ("id",), time_col="order_date"),
            "monthly_rev": lambda cat: MONTHLY_REV.as_model(cat, "monthly_rev"),
        }
    )


# H3: the saved monthly revenue query.
MONTHLY_REV = QuerySpec(source="orders", measures={}, additive={"revenue": ("sum", "amount")}, time=("order_date", "month"))


def _by_customer(b: Bench, orders: DataFrame, dims, partials, finals) -> DataFrame:
    """Orders aggregated per customer first, then by the customer's attributes (eager aggregation)."""
    return grain.eager_aggregate(orders, "customer_id", b.customer_dims, "id", dims, partials, finals)


def _revenue_by(b: Bench, orders: DataFrame, dims) -> DataFrame:
    return _by_customer(b, orders, dims, {"__s": F.sum("amount")}, {"revenue": F.sum("__s")})


def _monthly(b: Bench, date_range=None) -> DataFrame:
    """Monthly revenue; ``date_range`` covers the output and what its shifts look back at."""
    o = b.orders if date_range is None else b.orders_in(date_range)
    return periods.series(o, "order_date", "month", [], {"revenue": F.sum("amount")}, name="month")


# ---------------------------------------------------------------- capability


@question(
    "q1_region_total",
    """select region, city, cast(sum(amount) as double) as revenue,
  cast(sum(sum(amount)) over (partition by region) as double) as region_total
from b_orders_flat group by 1, 2""",
    ("A3", "D1", "D18"),
)
def q1_region_total(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders, ["region", "city"])
    g = grain.with_total(g, {"region_total": F.sum("revenue")}, ["region"])
    return g.select("region", "city", dbl("revenue").alias("revenue"), dbl("region_total").alias("region_total"))


@question(
    "q2_city_share",
    """select region, city,
  cast(sum(amount) as double) / cast(sum(sum(amount)) over (partition by region) as double) as share_of_region,
  cast(sum(amount) as double) / cast(sum(sum(amount)) over () as double) as share_of_total
from b_orders_flat group by 1, 2""",
    ("D19", "D20"),
)
def q2_city_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders, ["region", "city"])
    g = grain.share(g, "revenue", ["region"], "share_of_region")
    g = grain.share(g, "revenue", [], "share_of_total")
    return g.select("region", "city", "share_of_region", "share_of_total")


@question(
    "q3_avg_city_revenue",
    """select region, cast(sum(rev) as double) / count(*) as avg_city_revenue
from (select region, city, sum(amount) as rev from b_orders_flat group by 1, 2) group by 1""",
    ("D22",),
)
def q3_avg_city_revenue(spark, sf_dir):
    b = _bench(spark, sf_dir)
    cities = _revenue_by(b, b.orders, ["region", "city"])  # the inner level, aggregated per customer first
    res = grain.reaggregate(cities, ["region", "city"], F.sum("revenue"), ["region"], lambda v: ratio(F.sum(v), F.count(v)), "avg_city_revenue")
    return res.df


@question(
    "q4_prior_year",
    """select y.month, cast(y.revenue as double) as revenue,
  (select cast(e.revenue as double) from b_months e where e.month + interval 1 year = y.month) as prior_year_revenue
from b_months y where year(y.month) = 1998 and quarter(y.month) = 1""",
    ("E2", "C15", "B9", "F1"),
)
def q4_prior_year(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir), ["1997-01", "1998-03"])
    s = periods.time_shift(s, "month", "revenue", -1, "year", name="prior_year_revenue")
    s = periods.clip(s, "month", ["1998-01-01", "1998-03-31"])
    return s.select("month", dbl("revenue").alias("revenue"), dbl("prior_year_revenue").alias("prior_year_revenue"))


@question(
    "q4_running_total",
    """select y.month, cast(y.revenue as double) as revenue,
  cast((select sum(e.revenue) from b_months e where year(e.month) = 1998 and e.month <= y.month) as double) as running_total,
  cast(y.revenue - p.revenue as double) as change
from b_months y left join b_months p on p.month + interval 1 month = y.month where year(y.month) = 1998""",
    ("E1", "E3", "B9"),
)
def q4_running_total(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir), ["1997-12", "1998-12"])
    s = periods.change(s, "month", "revenue", "month", name="change")
    s = periods.clip(s, "month", Y2025)
    s = periods.cumsum(s, "month", "revenue", name="running_total")
    return s.select("month", dbl("revenue").alias("revenue"), dbl("running_total").alias("running_total"), dbl("change").alias("change"))


@question(
    "q5_spend_band",
    f"""with rich as (select customer_id from b_orders where customer_id is not null group by customer_id having sum(amount) > {HIGH_SPEND})
select 'high' as band, cast(sum(amount) as double) as revenue from b_orders where customer_id in (from rich) having count(*) > 0
union all
select 'other', cast(sum(amount) as double) from b_orders where customer_id is null or customer_id not in (from rich) having count(*) > 0""",
    ("B3",),
)
def q5_spend_band(spark, sf_dir):
    b = _bench(spark, sf_dir)
    out = grain.calc_dim_rollup(
        b.orders, "customer_id", F.sum("amount"), lambda t: F.when(t > HIGH_SPEND, "high").otherwise("other"), "band",
        {"revenue": (F.sum("amount"), "sum")}, null_label="other",
    )
    return out.select("band", dbl("revenue").alias("revenue"))


@question(
    "q6_region_credit",
    """with o as (select region, sum(amount) as revenue from b_orders_flat group by 1),
c as (select r.name as region, sum(c.credit) as total_credit from b_customers c left join b_regions r on c.region_id = r.id group by 1)
select o.region, cast(o.revenue as double) as revenue, cast(c.total_credit as double) as total_credit
from o left join c on o.region is not distinct from c.region""",
    ("C1", "C3", "C14"),
)
def q6_region_credit(spark, sf_dir):
    cat = models(spark, sf_dir)
    b = _bench(spark, sf_dir)
    o = _revenue_by(b, b.orders, ["region"])
    c = cat.attach("customers", {"region": "regions.name"})
    c = grain.aggregate(c, ["region"], {"total_credit": F.sum("credit")})
    out = grain.null_safe_join(o, c, ["region"])  # root orders: only regions with orders (S10)
    return out.select("region", dbl("revenue").alias("revenue"), dbl("total_credit").alias("total_credit"))


@question(
    "q7_cumulative_change",
    """select month, cast(revenue - (select revenue from b_months where month = date '1997-12-01') as double) as cumulative_change
from b_months where year(month) = 1998""",
    ("E5", "E13"),
)
def q7_cumulative_change(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir), ["1997-12", "1998-12"])
    s = periods.lag_change(s, "month", "revenue", name="change")
    s = periods.clip(s, "month", Y2025)
    s = periods.cumsum(s, "month", "change", name="cumulative_change")
    return s.select("month", dbl("cumulative_change").alias("cumulative_change"))


@question(
    "q8_tier_customers",
    """select c.tier, count(distinct c.id) as customers, cast(sum(o.amount) as double) as revenue
from b_customers c left join b_orders o on o.customer_id = c.id group by 1""",
    ("C20", "D5"),
)
def q8_tier_customers(spark, sf_dir):
    b = _bench(spark, sf_dir)
    per_customer = b.orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.sum("amount").alias("spend"))
    c = b.customers.join(per_customer, F.col("id") == F.col("customer_id"), "left")
    out = c.groupBy("tier").agg(count_rows().alias("customers"), F.sum("spend").alias("revenue"))
    return out.select("tier", "customers", dbl("revenue").alias("revenue"))


@question(
    "q9_credit_by_status_associated",
    """select status, cast(sum(c) as double) as total_credit from (
  select o.status, o.customer_id, max(c.credit) as c from b_orders o left join b_customers c on c.id = o.customer_id group by 1, 2)
group by 1""",
    ("C6", "M2"),
)
def q9_credit_by_status_associated(spark, sf_dir):
    cat = models(spark, sf_dir)
    # the (status, customer) pairs first: the join to the customer's credit sees each pair once
    pairs = cat["orders"].df.select("status", "customer_id").distinct()
    o = cat.attach("orders", {"credit": "customers.credit"}, df=pairs)
    res = grain.associate(o, ["status"], "customer_id", "credit", "total_credit")
    return res.df.select("status", dbl("total_credit").alias("total_credit"))


@question(
    "q9_credit_by_status_broadcast",
    """select s.status, cast((select sum(credit) from b_customers) as double) as total_credit
from (select distinct status from b_orders) s""",
    ("C7", "M2"),
)
def q9_credit_by_status_broadcast(spark, sf_dir):
    b = _bench(spark, sf_dir)
    total = b.customers.agg(F.sum("credit").cast("double"))
    return grain.broadcast_total(b.orders, ["status"], total, "total_credit").df


@question(
    "q10_bronze_or_ok",
    f"""select count(*) as customers from b_customers
where tier = '{BRONZE}' or id in (select customer_id from b_orders where status = '{OK}')""",
    ("C10",),
)
def q10_bronze_or_ok(spark, sf_dir):
    b = _bench(spark, sf_dir)
    kept = relations.where_any(b.customers, F.col("tier") == BRONZE, "id", b.orders, "customer_id", F.col("status") == OK)
    return kept.agg(count_rows().alias("customers"))


@question(
    "q11_rolling_customers",
    """select m.month, count(distinct o.customer_id) as customers
from b_months m join b_orders o on o.order_date < m.month + interval 1 month and o.order_date + interval 90 day >= m.month + interval 1 month
where year(m.month) = 1998 group by m.month""",
    ("E6", "D5"),
)
def q11_rolling_customers(spark, sf_dir):
    b = _bench(spark, sf_dir)
    return periods.rolling(
        b.orders_in(["1997-11", "1998-12"]), "order_date", "month", "90d", {"customers": F.count_distinct}, {"customers": "customer_id"},
        date_range=Y2025, name="month", distinct_key="customer_id",
    )


@question(
    "q12_net_revenue",
    "select region, cast(sum(amount - discount) as double) as net_revenue from b_orders_flat group by 1",
    ("B13", "C1"),
)
def q12_net_revenue(spark, sf_dir):
    b = _bench(spark, sf_dir)
    # sum(amount - discount) over a customer's orders = sum(amount) - orders * discount (NULL when unknown)
    return _by_customer(
        b, b.orders, ["region"], {"__s": F.sum("amount"), "__n": count_rows()},
        {"net_revenue": dbl(F.sum(F.col("__s") - F.col("__n") * F.col("discount")))},
    )


@question(
    "q13_top_cities_count",
    """select city, count(*) as orders from b_orders_flat where city is not null
group by 1 order by sum(amount) desc, city limit 3""",
    ("G2", "G4", "B7"),
)
def q13_top_cities_count(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _by_customer(b, b.orders, ["city"], {"__n": count_rows(), "__s": F.sum("amount")}, {"orders": F.sum("__n"), "__rev": F.sum("__s")})
    g = g.where(F.col("city").isNotNull())
    return ranking.order_limit(g, [F.col("__rev").desc(), F.col("city")], 3, drop=["__rev"])


@question(
    "q14_top_customer_per_region",
    """select region, customer_id, revenue from (
  select region, customer_id, cast(sum(amount) as double) as revenue,
         rank() over (partition by region order by sum(amount) desc) as rk
  from b_orders_flat where region is not null and customer_id is not null group by 1, 2)
where rk = 1""",
    ("E7", "B12"),
)
def q14_top_customer_per_region(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders.where(F.col("customer_id").isNotNull()), ["region", "customer_id"]).where(F.col("region").isNotNull())
    top = ranking.top_n_per_group(g, "revenue", ["region"], 1)
    return top.select("region", "customer_id", dbl("revenue").alias("revenue"))


@question(
    "q15_revenue_bands",
    """with spend as (select sum(amount) as total from b_orders where customer_id is not null group by customer_id)
select cast(least(floor(total / 1000000), 3) * 1000000 as bigint) as band, count(*) as customers from spend group by all""",
    ("H1", "B4"),
)
def q15_revenue_bands(spark, sf_dir):
    b = _bench(spark, sf_dir)
    per_customer = b.orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.sum("amount").alias("rev"))
    labels = [0, *REVENUE_BAND_EDGES]
    stage = per_customer.withColumn("band", band("rev", REVENUE_BAND_EDGES, labels).cast("long"))
    return stage.groupBy("band").agg(count_rows().alias("customers"))


@question(
    "q16_order_size",
    f"""select case when amount > {BIG_ORDER} then 'big' else 'small' end as size, count(*) as orders,
  cast(sum(amount) as double) as revenue from b_orders group by 1""",
    ("B2",),
)
def q16_order_size(spark, sf_dir):
    cat = models(spark, sf_dir)
    m = cat["orders"].extend(columns={"size": F.when(F.col("amount") > BIG_ORDER, "big").otherwise("small")})
    return m.df.groupBy("size").agg(count_rows().alias("orders"), dbl(F.sum("amount")).alias("revenue"))


@question(
    "q17_running_aov",
    """select m.month, sum(cast(e.revenue as double) / e.orders order by e.month) as running_aov
from b_months m join b_months e on year(e.month) = year(m.month) and e.month <= m.month where year(m.month) = 1998 group by m.month""",
    ("D27", "E5"),
)
def q17_running_aov(spark, sf_dir):
    b = _bench(spark, sf_dir)
    s = periods.series(b.orders_in(Y2025), "order_date", "month", [], {"aov": AOV.build()}, name="month")
    return periods.cumsum(s, "month", "aov", name="running_aov").select("month", "running_aov")


@question(
    "q18_monthly_rev_by_quarter",
    """select date_trunc('quarter', order_date)::date as order_date, cast(sum(amount) as double) as revenue
from b_orders where order_date >= date '1998-01-01' and order_date < date '1999-01-01' group by 1""",
    ("F4", "H3"),
)
def q18_monthly_rev_by_quarter(spark, sf_dir):
    """The saved monthly query re-bucketed coarser (by quarter) - allowed; by day it raises."""
    cat = models(spark, sf_dir)
    m = cat["monthly_rev"]
    stage = m.df.where(in_period("order_date", Y2025))  # on the saved query's buckets
    stage = periods.rebucket(stage, "order_date", m.buckets["order_date"], "quarter")
    return stage.groupBy("order_date").agg(dbl(F.sum("revenue")).alias("revenue"))


@question(
    "q20_last_three_months",
    """select date_trunc('month', order_date)::date as month, cast(sum(amount) as double) as revenue from b_orders
where order_date >= date '1998-10-01' and order_date < date '1999-01-01' group by 1""",
    ("B10", "F1"),
)
def q20_last_three_months(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = b.orders_in(["1998-10", "1998-12"]).where(last_complete("order_date", 3, "month", as_of="1999-01-15"))
    return periods.series(o, "order_date", "month", [], {"revenue": dbl(F.sum("amount"))}, name="month")


@question(
    "q20_quarter_region",
    """select region, cast(sum(amount) as double) as revenue from b_orders_flat
where order_date >= date '1998-01-01' and order_date < date '1998-04-01' group by 1""",
    ("B8", "C1"),
)
def q20_quarter_region(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders_in("1998-Q1"), ["region"])
    return g.select("region", dbl("revenue").alias("revenue"))


@question(
    "q21_weekday_revenue",
    """select isodow(order_date) as day_of_week, cast(sum(amount) as double) as revenue from b_orders
where order_date >= date '1998-01-01' and order_date < date '1999-01-01' group by 1""",
    ("B5",),
)
def q21_weekday_revenue(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = b.orders_in(Y2025)
    return o.groupBy(iso_weekday("order_date").alias("day_of_week")).agg(dbl(F.sum("amount")).alias("revenue"))


@question(
    "q23_monthly_by_region",
    """select date_trunc('month', order_date)::date as month, region, cast(sum(amount) as double) as revenue
from b_orders_flat where order_date >= date '1998-01-01' and order_date < date '1998-04-01' group by 1, 2""",
    ("H2", "H3"),
)
def q23_monthly_by_region(spark, sf_dir):
    cat = models(spark, sf_dir)
    spec = MONTHLY_REV.refine(dims={"region": "customers.regions.name"}, date_range="1998-Q1")
    out = spec.build(cat)
    return out.select(F.col("order_date").alias("month"), "region", dbl("revenue").alias("revenue"))


@question(
    "q24_top_two_per_region",
    """select region, customer_id, cast(sum(amount) as double) as revenue,
  cast(sum(sum(amount)) over (partition by region) as double) as region_revenue
from b_orders_flat where region is not null group by region, customer_id
qualify rank() over (partition by region order by sum(amount) desc) <= 2""",
    ("E10",),
)
def q24_top_two_per_region(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders.where(F.col("customer_id").isNotNull()), ["region", "customer_id"]).where(F.col("region").isNotNull())
    top = ranking.top_n_per_group(g, "revenue", ["region"], 2)
    # the region total is taken over all of the region's customers, not only the top two
    out = grain.with_total(top, {"region_revenue": F.sum("revenue")}, ["region"], source=g)
    return out.select("region", "customer_id", dbl("revenue").alias("revenue"), dbl("region_revenue").alias("region_revenue"))


@question(
    "q25_credit_per_order",
    "select cast(sum(c.credit) as double) / count(c.credit) as avg_credit from b_orders o join b_customers c on o.customer_id = c.id",
    ("D26",),
)
def q25_credit_per_order(spark, sf_dir):
    b = _bench(spark, sf_dir)
    # The customer's credit weighted by their number of orders (orders counted per customer first)
    n = b.orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(count_rows().alias("n"))
    c = n.join(b.customers.select(F.col("id").alias("customer_id"), "credit"), "customer_id")
    return c.agg(weighted_avg("credit", "n").alias("avg_credit"))


# ---------------------------------------------------------------- combo


@question(
    "c_aov_change",
    """select y.month, cast(y.revenue as double) / y.orders as aov, cast(y.revenue as double) / y.orders - cast(p.revenue as double) / p.orders as aov_change
from b_months y left join b_months p on p.month + interval 1 month = y.month where year(y.month) = 1998""",
    ("D27", "E3"),
)
def c_aov_change(spark, sf_dir):
    b = _bench(spark, sf_dir)
    s = periods.series(b.orders_in(["1997-12", "1998-12"]), "order_date", "month", [], {"aov": AOV.build()}, name="month")
    s = periods.change(s, "month", "aov", "month", name="aov_change")
    return periods.clip(s, "month", Y2025).select("month", "aov", "aov_change")


@question(
    "c_net_region_tier",
    """with net as (select region, tier, sum(amount) - sum(discount) as net from b_orders_flat where customer_id is not null group by all)
select region, tier, cast(net as double) as net_revenue,
  cast((select sum(x.net) from net x where x.region is not distinct from net.region) as double) as region_net_revenue
from net""",
    ("B13", "D18"),
)
def c_net_region_tier(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _by_customer(
        b, b.orders.where(F.col("customer_id").isNotNull()), ["region", "tier"], {"__s": F.sum("amount"), "__n": count_rows()},
        {"net_revenue": F.sum(F.col("__s") - F.col("__n") * F.col("discount"))},
    )
    g = grain.with_total(g, {"region_net_revenue": F.sum("net_revenue")}, ["region"])
    return g.select("region", "tier", dbl("net_revenue").alias("net_revenue"), dbl("region_net_revenue").alias("region_net_revenue"))


@question(
    "c_region_credit_rank",
    """with o as (select region, sum(amount) as revenue from b_orders_flat where region is not null group by 1),
c as (select r.name as region, sum(c.credit) as total_credit from b_customers c join b_regions r on r.id = c.region_id group by 1)
select o.region, cast(o.revenue as double) as revenue, rank() over (order by o.revenue desc) as revenue_rank,
  cast(c.total_credit as double) as total_credit
from o left join c using (region)""",
    ("C3", "E7"),
)
def c_region_credit_rank(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = _revenue_by(b, b.orders, ["region"]).where(F.col("region").isNotNull())
    o = ranking.rank_within(o, "revenue", [], "desc", "revenue_rank")  # over a handful of regions
    c = b.customers.join(bounded_broadcast(b.regions, Bench.REGION_ROWS), F.col("region_id") == b.regions["id"]).groupBy(b.regions["name"].alias("region"))
    c = c.agg(F.sum("credit").alias("total_credit"))
    out = o.join(c, "region", "left")
    return out.select("region", dbl("revenue").alias("revenue"), "revenue_rank", dbl("total_credit").alias("total_credit"))


@question(
    "c_region_month_share",
    """with cell as (select region, year(order_date) * 12 + month(order_date) - 1 as k, sum(amount) as revenue from b_orders_flat
  where order_date between date '1997-12-01' and date '1998-03-31' group by all)
select make_date(k // 12, k % 12 + 1, 1) as month, region, cast(revenue as double) as revenue,
  cast(revenue as double) / cast((select sum(x.revenue) from cell x where x.k = cell.k) as double) as share_of_month,
  cast(revenue - (select x.revenue from cell x where x.k = cell.k - 1 and x.region is not distinct from cell.region) as double) as revenue_change
from cell where k >= 1998 * 12""",
    ("D20", "E3", "S5"),
)
def c_region_month_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = b.orders_in(["1997-12", "1998-03"]).withColumn("month", bucket("order_date", "month"))
    s = grain.eager_aggregate(
        o, "customer_id", b.customer_dims, "id", ["month", "region"], {"__s": F.sum("amount")}, {"revenue": F.sum("__s")}, local_dims=["month"]
    )
    s = periods.change(s, "month", "revenue", "month", ["region"], "revenue_change")
    s = periods.clip(s, "month", ["1998-01-01", "1998-03-31"])
    s = grain.share(s, "revenue", ["month"], "share_of_month")
    return s.select("month", "region", dbl("revenue").alias("revenue"), "share_of_month", dbl("revenue_change").alias("revenue_change"))


@question(
    "c_saved_running",
    """with m as (select date_trunc('month', order_date)::date as month, sum(amount) as revenue
  from b_orders where order_date >= date '1998-01-01' and order_date < date '1999-01-01' group by 1)
select month, cast(revenue as double) as revenue, cast(sum(revenue) over (order by month) as double) as running_total from m""",
    ("H2", "E1"),
)
def c_saved_running(spark, sf_dir):
    cat = models(spark, sf_dir)
    spec = MONTHLY_REV.refine(running={"running_total": "revenue"}, date_range=Y2025)
    out = spec.build(cat)
    return out.select(F.col("order_date").alias("month"), dbl("revenue").alias("revenue"), dbl("running_total").alias("running_total"))


@question(
    "c_size_class_months",
    f"""with sizes as (select cast(date_trunc('month', order_date) as date) as month, count(*) filter (where amount > {BIG_ORDER}) as big, count(*) as orders from b_orders group by all),
counted as (
  select month, 'big' as size, big as n, orders from sizes
  union all select month, 'small', orders - big, orders from sizes)
select now.month, now.size, now.n as orders, cast(now.n as double) / now.orders as share_of_month,
  now.n - (select nullif(e.n, 0) from counted e where e.size = now.size and e.month + interval 1 month = now.month) as orders_change
from counted now where now.n > 0 and year(now.month) = 1998 and quarter(now.month) = 1""",
    ("B2", "D20", "E3"),
)
def c_size_class_months(spark, sf_dir):
    o = _bench(spark, sf_dir).orders_in(["1997-12", "1998-03"])
    o = o.withColumn("size", F.when(F.col("amount") > BIG_ORDER, "big").otherwise("small"))
    s = periods.series(o, "order_date", "month", ["size"], {"orders": count_rows()}, name="month")
    s = periods.change(s, "month", "orders", "month", ["size"], "orders_change")
    s = periods.clip(s, "month", ["1998-01-01", "1998-03-31"])
    s = grain.share(s, "orders", ["month"], "share_of_month")
    return s.select("month", "size", "orders", "share_of_month", "orders_change")


@question(
    "c_spend_band_share",
    f"""with banded as (
  select amount, if(customer_id in (select customer_id from b_orders where customer_id is not null group by customer_id having sum(amount) > {HIGH_SPEND}), 'high', 'other') as band from b_orders)
select band, cast(sum(amount) as double) as revenue, cast(sum(amount) as double) / cast((select sum(amount) from b_orders) as double) as share_of_total
from banded group by band""",
    ("B3", "D20"),
)
def c_spend_band_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    out = grain.calc_dim_rollup(
        b.orders, "customer_id", F.sum("amount"), lambda t: F.when(t > HIGH_SPEND, "high").otherwise("other"), "band",
        {"revenue": (F.sum("amount"), "sum")}, null_label="other",
    )
    out = grain.share(out, "revenue", [], "share_of_total")
    return out.select("band", dbl("revenue").alias("revenue"), "share_of_total")


@question(
    "c_top_customer_share",
    """with cr as (select region, customer_id, sum(amount) as revenue from b_orders_flat where region is not null group by 1, 2)
select region, customer_id, share_of_region from (
  select region, customer_id, cast(revenue as double) / cast(sum(revenue) over (partition by region) as double) as share_of_region,
         rank() over (partition by region order by revenue desc) as rk
  from cr)
where rk = 1""",
    ("E7", "D20", "B12"),
)
def c_top_customer_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders, ["region", "customer_id"]).where(F.col("region").isNotNull())
    top = ranking.top_n_per_group(g, "revenue", ["region"], 1)
    out = grain.with_total(top, {"__region_total": F.sum("revenue")}, ["region"], source=g)  # S2: total before the rank filter
    return out.select("region", "customer_id", ratio(F.col("revenue"), F.col("__region_total")).alias("share_of_region"))


@question(
    "c_top_growth_months",
    """select y.month, cast(y.revenue as double) as revenue from b_months y join b_months p on p.month + interval 1 month = y.month
where year(y.month) = 1998 order by y.revenue - p.revenue desc, y.month limit 3""",
    ("G3", "E3"),
)
def c_top_growth_months(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir), ["1997-12", "1998-12"])
    s = periods.change(s, "month", "revenue", "month", name="__increase")
    s = periods.clip(s, "month", Y2025).select("month", dbl("revenue").alias("revenue"), "__increase")
    return ranking.order_limit(s, [F.col("__increase").desc_nulls_last(), F.col("month")], 3, drop=["__increase"])


@question(
    "c_top_two_q1_share",
    """select region, customer_id, cast(sum(amount) as double) as revenue,
  cast(sum(amount) as double) / cast(sum(sum(amount)) over (partition by region) as double) as share_of_region
from b_orders_flat where region is not null and year(order_date) = 1998 and quarter(order_date) = 1 group by region, customer_id
qualify rank() over (partition by region order by sum(amount) desc) <= 2""",
    ("E10", "D20", "B8"),
)
def c_top_two_q1_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders_in("1998-Q1"), ["region", "customer_id"]).where(F.col("region").isNotNull())
    top = ranking.top_n_per_group(g, "revenue", ["region"], 2)
    out = grain.with_total(top, {"__region_total": F.sum("revenue")}, ["region"], source=g)
    return out.select("region", "customer_id", dbl("revenue").alias("revenue"), ratio(F.col("revenue"), F.col("__region_total")).alias("share_of_region"))


@question(
    "c_weekday_share",
    """select isodow(order_date) as day_of_week, cast(sum(amount) as double) as revenue,
  cast(sum(amount) as double) / cast(sum(sum(amount)) over () as double) as share_of_year
from b_orders where order_date >= date '1998-01-01' and order_date < date '1999-01-01' group by 1""",
    ("B5", "D20"),
)
def c_weekday_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = b.orders_in(Y2025)
    g = o.groupBy(iso_weekday("order_date").alias("day_of_week")).agg(F.sum("amount").alias("revenue"))
    g = grain.share(g, "revenue", [], "share_of_year")
    return g.select("day_of_week", dbl("revenue").alias("revenue"), "share_of_year")


# ---------------------------------------------------------------- traps


@question(
    "t_all_time_running",
    """select y.month, cast(y.revenue as double) as revenue,
  (select cast(sum(o.amount) as double) from b_orders o where o.order_date < y.month + interval 1 month) as running_total
from b_months y where year(y.month) = 1998""",
    ("E12", "H1"),
)
def t_all_time_running(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir))
    s = periods.cumsum(s, "month", "revenue", name="running_total")  # over all history first (E12)
    s = periods.clip(s, "month", Y2025)
    return s.select("month", dbl("revenue").alias("revenue"), dbl("running_total").alias("running_total"))


@question(
    "t_bridge_email",
    f"""with reached as (select distinct m.customer_id from b_campaigns k, b_members m where m.campaign_id = k.id and k.channel = '{EMAIL}')
select region, cast(sum(amount) as double) as revenue from b_orders_flat semi join reached using (customer_id) group by region""",
    ("C12",),
)
def t_bridge_email(spark, sf_dir):
    b = _bench(spark, sf_dir)
    # revenue per customer first; the bridge filter and the region lookup then work at the customer grain
    per = b.orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.sum("amount").alias("__s"))
    chosen = b.campaigns.where(F.col("channel") == EMAIL)  # the lines of other campaigns are left out before the bridge is made
    kept = relations.via_bridge(per, "customer_id", b.members_of(chosen), "customer_id", "campaign_id", chosen, "id", F.lit(True))
    g = grain.eager_aggregate(kept, "customer_id", b.customer_dims, "id", ["region"], {"__t": F.sum("__s")}, {"revenue": F.sum("__t")})
    return g.select("region", dbl("revenue").alias("revenue"))


@question(
    "t_chasm",
    """with fact as (
  select 'ordered' as kind, customer_id, amount from b_orders
  union all select 'returned', customer_id, amount from b_returns
  union all select 'nobody', id, null from b_customers),
home as (select cu.id as customer_id, re.name as region from b_customers cu left join b_regions re on cu.region_id = re.id)
select region, cast(sum(amount) filter (where kind = 'ordered') as double) as ordered,
  cast(sum(amount) filter (where kind = 'returned') as double) as returned
from fact left join home using (customer_id) group by region having bool_or(kind = 'nobody')""",
    ("C4", "C14"),
)
def t_chasm(spark, sf_dir):
    cat = models(spark, sf_dir)
    b = _bench(spark, sf_dir)
    pop = cat.attach("customers", {"region": "regions.name"}).select("region")
    # each fact at its own grain (S9), aggregated per customer before the customer's region is looked up
    o = _by_customer(b, b.orders, ["region"], {"__s": F.sum("amount")}, {"ordered": F.sum("__s")})
    rt = _by_customer(b, b.returns, ["region"], {"__s": F.sum("amount")}, {"returned": F.sum("__s")})
    out = grain.multi_fact(pop, ["region"], [o, rt])
    return out.select("region", dbl("ordered").alias("ordered"), dbl("returned").alias("returned"))


@question(
    "t_city_size",
    """with spend as (select customer_id, sum(amount) as spent from b_orders group by customer_id),
place as (select id, (select max(size_class) from b_cities x where x.city = p.city and x.region_id = p.region_id) as size_class from b_customers p)
select size_class, cast(sum(spent) as double) as revenue from spend left join place on place.id = spend.customer_id group by size_class""",
    ("C2",),
)
def t_city_size(spark, sf_dir):
    cat = models(spark, sf_dir)
    b = _bench(spark, sf_dir)
    # The customer's city joined on the whole composite key (city, region_id)
    lookup = cat.attach("customers", {"size_class": "cities.size_class"}).select("id", "size_class")
    g = grain.eager_aggregate(b.orders, "customer_id", lookup, "id", ["size_class"], {"__s": F.sum("amount")}, {"revenue": F.sum("__s")})
    return g.select("size_class", dbl("revenue").alias("revenue"))


@question(
    "t_count_after_join",
    f"""select tier, count(*) as customers from b_customers
where id in (select customer_id from b_orders where status = '{BAD}') group by 1""",
    ("C9",),
)
def t_count_after_join(spark, sf_dir):
    b = _bench(spark, sf_dir)
    kept = relations.where_exists(b.customers, "id", b.orders, "customer_id", F.col("status") == BAD)
    return kept.groupBy("tier").agg(count_rows().alias("customers"))


@question(
    "t_fan_out_credit",
    """select region, cast(sum(person) as bigint) as customers, cast(sum(credit) as double) as total_credit,
  cast(sum(placed) as bigint) as orders
from (select re.name as region, 1 as person, cu.credit, 0 as placed from b_customers cu left join b_regions re on re.id = cu.region_id
      union all select region, 0, null, 1 from b_orders_flat)
group by region having sum(person) > 0""",
    ("C3", "C21", "S11"),
)
def t_fan_out_credit(spark, sf_dir):
    cat = models(spark, sf_dir)
    c = grain.aggregate(cat.attach("customers", {"region": "regions.name"}), ["region"], {"customers": count_rows(), "total_credit": F.sum("credit")})
    o = _by_customer(_bench(spark, sf_dir), cat["orders"].df, ["region"], {"__n": count_rows()}, {"orders": F.sum("__n")})
    out = grain.null_safe_join(c, o, ["region"])
    return out.select("region", "customers", dbl("total_credit").alias("total_credit"), F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@question(
    "t_fan_out_items",
    """select region, cast(sum(amount) as double) as revenue, cast(sum(parts) as bigint) as lines
from (select f.region, f.amount, (select count(*) from b_order_items x where x.order_id = f.id) as parts from b_orders_flat f)
where parts > 0 group by region""",
    ("C5",),
)
def t_fan_out_items(spark, sf_dir):
    b = _bench(spark, sf_dir)
    # Lines counted per order, each order once; then per customer, then by the customer's region
    per_customer = grain.sum_once(b.order_items, "order_id", {"lines": count_rows()}, b.orders, "id", ["customer_id"], {"revenue": F.sum("amount")})
    out = grain.eager_aggregate(
        per_customer, "customer_id", b.customer_dims, "id", ["region"], {"__s": F.sum("revenue"), "__n": F.sum("lines")},
        {"revenue": F.sum("__s"), "lines": F.sum("__n")},
    )
    return out.select("region", dbl("revenue").alias("revenue"), F.col("lines").cast("long").alias("lines"))


@question(
    "t_march_events",
    """select count(*) as events, cast(sum(amount) as double) as total_amount from b_events
where event_ts >= timestamp '2024-01-08' and event_ts < timestamp '2024-01-15'""",
    ("B8", "S7"),
)
def t_march_events(spark, sf_dir):
    b = _bench(spark, sf_dir)
    e = b.events.where(in_range("event_ts", ["2024-01-08", "2024-01-14"], "timestamp_ntz"))
    return e.agg(count_rows().alias("events"), dbl(F.sum("amount")).alias("total_amount"))


@question(
    "t_monthly_gaps",
    """with days as (select cast(d as date) as month from generate_series(date '1997-01-01', date '1997-12-01', interval 1 month) s(d))
select month, coalesce((select cast(b_months.revenue as double) from b_months where b_months.month = days.month), 0) as revenue,
  cast((select sum(o.amount) from b_orders o where year(o.order_date) = 1997 and o.order_date < days.month + interval 1 month) as double) as running_total
from days""",
    ("A10", "F3", "E1"),
)
def t_monthly_gaps(spark, sf_dir):
    b = _bench(spark, sf_dir)
    o = b.orders_in(Y2024)
    s = periods.series(o, "order_date", "month", [], {"revenue": F.sum("amount")}, name="month")
    s = periods.fill_periods(s, spark, "month", "1997-01-01", "1997-12-01", "month", ["revenue"])
    s = periods.cumsum(s, "month", "revenue", name="running_total")
    return s.select("month", dbl("revenue").alias("revenue"), dbl("running_total").alias("running_total"))


@question(
    "t_never_returned",
    """select tier, count(*) as customers from b_customers c
where not exists (select 1 from b_returns r where r.customer_id = c.id) group by 1""",
    ("C11",),
)
def t_never_returned(spark, sf_dir):
    b = _bench(spark, sf_dir)
    kept = relations.where_none(b.customers, "id", b.returns, "customer_id")
    return kept.groupBy("tier").agg(count_rows().alias("customers"))


@question(
    "t_ok_share",
    f"""select region, cast(sum(amount) as double) / cast((select sum(amount) from b_orders where status = '{OK}') as double) as share
from b_orders_flat where status = '{OK}' group by 1""",
    ("D21",),
)
def t_ok_share(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _revenue_by(b, b.orders.where(F.col("status") == OK), ["region"])  # S1: the filter applies to the total too
    return grain.share(g, "revenue", [], "share").select("region", "share")


@question(
    "t_orders_per_category",
    """select p.category, count(distinct i.order_id) as orders, (select count(*) from b_orders) as total_orders
from b_order_items i join b_products p on p.id = i.product_id group by 1""",
    ("D23", "D5"),
)
def t_orders_per_category(spark, sf_dir):
    cat = models(spark, sf_dir)
    items = cat["order_items"].df.join(cat["products"].df.select(F.col("id").alias("__pid"), "category"), F.col("product_id") == F.col("__pid"))
    g = grain.aggregate(items, ["category"], {"orders": F.count_distinct("order_id")})
    # the total is counted at the orders' own grain, never added up from the overlapping categories
    return grain.with_total(g, {"total_orders": count_rows()}, [], source=cat["orders"].df)


@question(
    "t_orders_per_customer",
    """select c.tier, count(*) as customers, cast(coalesce(sum(o.n), 0) as bigint) as orders,
  cast(coalesce(sum(o.n), 0) as double) / count(*) as orders_per_customer
from b_customers c left join (select customer_id, count(*) as n from b_orders group by 1) o on o.customer_id = c.id group by 1""",
    ("C20", "D25"),
)
def t_orders_per_customer(spark, sf_dir):
    b = _bench(spark, sf_dir)
    c = relations.count_children(b.customers, "id", b.orders, "customer_id", "n")
    g = c.groupBy("tier").agg(count_rows().alias("customers"), F.sum("n").cast("long").alias("orders"))
    return g.withColumn("orders_per_customer", ratio(F.col("orders"), F.col("customers")))


@question(
    "t_overall_aov",
    """select region, cast(sum(amount) as double) / count(*) as aov,
  (select cast(sum(amount) as double) / count(*) from b_orders) as overall_aov
from b_orders_flat group by 1""",
    ("D24",),
)
def t_overall_aov(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = _by_customer(b, b.orders, ["region"], {"__s": F.sum("amount"), "__n": count_rows()}, {"__t": F.sum("__s"), "__k": F.sum("__n")})
    # The ratio of the re-aggregated sums, over the few region rows
    everything = Window.partitionBy()
    overall = ratio(F.sum("__t").over(everything), F.sum("__k").over(everything))
    return g.select("region", ratio(F.col("__t"), F.col("__k")).alias("aov"), overall.alias("overall_aov"))


@question(
    "t_prev_month",
    """select y.month, cast(y.revenue as double) as revenue,
  (select cast(e.revenue as double) from b_months e where e.month + interval 1 month = y.month) as previous_revenue
from b_months y where year(y.month) = 1998 and quarter(y.month) = 1""",
    ("E2",),
)
def t_prev_month(spark, sf_dir):
    s = _monthly(_bench(spark, sf_dir), ["1997-12", "1998-03"])
    s = periods.time_shift(s, "month", "revenue", -1, "month", name="previous_revenue")
    s = periods.clip(s, "month", ["1998-01-01", "1998-03-31"])
    return s.select("month", dbl("revenue").alias("revenue"), dbl("previous_revenue").alias("previous_revenue"))


@question(
    "t_rolling_gap",
    """with spread as (select unnest([0, 1, 2]) as ahead, date_trunc('month', order_date) as own, amount from b_orders),
grid as (select make_date(1997, cast(k as integer), 1) as month from range(9, 13) as t(k))
select grid.month, cast(sum(amount) as double) as revenue_3m
from grid left join spread on cast(own + to_months(cast(ahead as integer)) as date) = grid.month group by grid.month""",
    ("E6", "S6"),
)
def t_rolling_gap(spark, sf_dir):
    b = _bench(spark, sf_dir)
    r = periods.rolling(
        b.orders_in(["1997-07", "1997-12"]), "order_date", "month", "3m", {"revenue_3m": F.sum}, {"revenue_3m": "amount"},
        date_range=["1997-09-01", "1997-12-31"], name="month", every_bucket=True,
    )
    return r.select("month", dbl("revenue_3m").alias("revenue_3m"))


@question(
    "t_zero_regions",
    """select r.name as region, count(o.id) as orders
from b_regions r left join b_customers c on c.region_id = r.id
left join b_orders o on o.customer_id = c.id and o.order_date >= date '1998-01-01' group by 1""",
    ("C13", "B16"),
)
def t_zero_regions(spark, sf_dir):
    b = _bench(spark, sf_dir)
    per_customer = relations.count_children(b.customers, "id", b.orders_in(["1998", "9998"]), "customer_id", "n")
    per_region = per_customer.groupBy("region_id").agg(F.sum("n").alias("orders"))
    out = relations.root_left(b.regions, "id", per_region, "region_id")
    return out.select(F.col("name").alias("region"), F.coalesce(F.col("orders"), F.lit(0)).cast("long").alias("orders"))
