"""The shop-database questions, bound to the driver's tables (see ``grainline.sources.bindings.Shop``).

Fixed binding values: year 2023 -> 1996, 2024 -> 1997, 2025 -> 1998, 2026 -> 1999; the 'Brooklyn' store
-> 'NATION_7'; order values are cents, so the value bands are scaled to the data ($1,000 steps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.catalog.registry import question
from grainline.functions.aggregates import agg_if, count_rows, first_by_time
from grainline.functions.calendar import in_period, period_bounds, weekday_name
from grainline.functions.scalar import band, dollars, ratio
from grainline.operators import grain, periods, ranking, recipes, relations
from grainline.plans.sizing import bounded_broadcast
from grainline.sources.bindings import Shop

BROOKLYN = "NATION_7"
Y2024, Y2025, Y2026 = "1997", "1998", "1999"
VALUE_BAND_EDGES = (100_000, 200_000, 300_000)
VALUE_BAND_LABELS = ("under $1,000", "$1,000 to $2,000", "$2,000 to $3,000", "$3,000 or more")
STREAK_FROM, STREAK_TO, STREAK_LAST_MONTH = "1996-06-01", "1999-10-01", "1999-09-01"


def _shop(spark: SparkSession, sf_dir: str) -> Shop:
    return Shop(spark, sf_dir)


def _ts_in(col: str, literal: str) -> Column:
    return in_period(col, literal, "timestamp_ntz")


def _orders_in(s: Shop, literal: str) -> DataFrame:
    start, end = period_bounds(literal)
    return s.orders_between(start.isoformat(), end.isoformat())


def _store_names(s: Shop) -> DataFrame:
    # 25 nations: a bounded broadcast
    return bounded_broadcast(s.stores.select(F.col("id").alias("store_id"), F.col("name").alias("store")), Shop.STORE_ROWS)


def _lines(s: Shop, orders: DataFrame) -> DataFrame:
    """Items of the given orders with the product's type and price (one row per item)."""
    o = orders.select(F.col("id").alias("order_id"), "store_id")
    p = s.products.select("sku", "type", "price", F.col("name").alias("product"))
    return s.items.join(o, "order_id").join(p, "sku")


@question(
    "j_c01_peak_weekday_hour",
    """select dayname(ordered_at) as weekday, cast(hour(ordered_at) as bigint) as hour, cast(sum(subtotal) as double) / 100.0 as net_sales,
  cast(sum(subtotal) as double) / cast(sum(sum(subtotal)) over () as double) as share
from s_orders where ordered_at >= timestamp '1998-01-01' and ordered_at < timestamp '1999-01-01'
group by 1, 2 order by net_sales desc, weekday, hour limit 1""",
    ("B5", "D20", "G4"),
)
def j_c01_peak_weekday_hour(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = _orders_in(s, Y2025)
    g = o.groupBy(weekday_name("ordered_at").alias("weekday"), F.hour("ordered_at").cast("long").alias("hour")).agg(F.sum("subtotal").alias("cents"))
    g = grain.share(g, "cents", [], "share").withColumn("net_sales", dollars("cents"))
    return ranking.order_limit(g, [F.col("net_sales").desc(), F.col("weekday"), F.col("hour")], 1).select("weekday", "hour", "net_sales", "share")


@question(
    "j_c02_order_value_bands",
    """select case when subtotal < 100000 then 'under $1,000' when subtotal < 200000 then '$1,000 to $2,000'
    when subtotal < 300000 then '$2,000 to $3,000' else '$3,000 or more' end as band,
  count(*) as orders, cast(sum(subtotal) as double) / 100.0 as net_sales,
  cast(sum(subtotal) as double) / cast(sum(sum(subtotal)) over () as double) as share_of_sales
from s_orders where ordered_at >= timestamp '1998-01-01' and ordered_at < timestamp '1999-01-01' group by 1""",
    ("B4", "D20"),
)
def j_c02_order_value_bands(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = _orders_in(s, Y2025).withColumn("band", band("subtotal", VALUE_BAND_EDGES, VALUE_BAND_LABELS))
    g = o.groupBy("band").agg(count_rows().alias("orders"), F.sum("subtotal").alias("cents"))
    g = grain.share(g, "cents", [], "share_of_sales")
    return g.select("band", "orders", dollars("cents").alias("net_sales"), "share_of_sales")


_BASKETS_SQL = """with sold as (
  select o.id, o.store_id, list(distinct p.type) as types from s_orders o, s_items i, s_products p
  where i.order_id = o.id and p.sku = i.sku and year(o.ordered_at) = 1998 group by o.id, o.store_id)"""


def _baskets(s: Shop) -> DataFrame:
    lines = _lines(s, _orders_in(s, Y2025))
    return recipes.basket_flags(lines, ["order_id", "store_id"], {"has_j": F.col("type") == "jaffle", "has_b": F.col("type") == "beverage"})


@question(
    "j_c03_basket_mix",
    _BASKETS_SQL
    + """
select if(len(types) = 2, 'both', types[1] || 's only') as mix, count(*) as orders,
  cast(count(*) as double) / (select count(*) from sold) as share
from sold group by mix""",
    ("D29",),
)
def j_c03_basket_mix(spark, sf_dir):
    b = recipes.basket_mix(_baskets(_shop(spark, sf_dir)), "has_j", "has_b", ("both", "jaffles only", "beverages only"))
    g = b.groupBy("mix").agg(count_rows().alias("orders"))
    return grain.share(g, "orders", [], "share")


@question(
    "j_c04_ltv_by_first_store",
    """with f as (select customer, arg_min(store_id, ordered_at) as first_store, sum(subtotal) as ltv from s_orders group by 1)
select s.name as store, count(*) as customers, cast(sum(ltv) as double) / count(*) / 100.0 as avg_lifetime_spend
from f join s_stores s on s.id = f.first_store group by 1""",
    ("D10", "H1", "C17"),
)
def j_c04_ltv_by_first_store(spark, sf_dir):
    s = _shop(spark, sf_dir)
    f = s.orders.groupBy("customer").agg(first_by_time("store_id", "ordered_at").alias("store_id"), F.sum("subtotal").alias("ltv"))
    g = f.join(_store_names(s), "store_id").groupBy("store").agg(count_rows().alias("customers"), F.sum("ltv").alias("__ltv"))
    return g.select("store", "customers", (ratio(F.col("__ltv"), F.col("customers")) / 100.0).alias("avg_lifetime_spend"))


@question(
    "j_c05_median_orders_per_customer",
    """with c as (select store_id, customer, count(*) as n from s_orders
  where ordered_at >= timestamp '1998-01-01' and ordered_at < timestamp '1999-01-01' group by 1, 2)
select s.name as store, count(*) as customers, median(n) as median_orders from c join s_stores s on s.id = c.store_id group by 1""",
    ("D8", "H1"),
)
def j_c05_median_orders_per_customer(spark, sf_dir):
    s = _shop(spark, sf_dir)
    c = _orders_in(s, Y2025).groupBy("store_id", "customer").agg(count_rows().alias("n"))
    # the built-in exact median keeps one counter per distinct value of n (orders per customer: a small
    # integer domain), so even a store holding a third of all customers stays small
    return c.join(_store_names(s), "store_id").groupBy("store").agg(count_rows().alias("customers"), F.median("n").cast("double").alias("median_orders"))


@question(
    "j_c06_top_decile_share",
    """with spend as (select customer, sum(subtotal) as total from s_orders where year(ordered_at) = 1998 group by customer),
top as (select total from spend order by total desc limit (select (count(*) + 9) // 10 from spend))
select cast((select sum(total) from top) as double) / cast((select sum(total) from spend) as double) as top_decile_share,
  (select count(*) from top) as top_decile_customers""",
    ("E8", "E14", "D17"),
)
def j_c06_top_decile_share(spark, sf_dir):
    s = _shop(spark, sf_dir)
    c = _orders_in(s, Y2025).groupBy("customer").agg(F.sum("subtotal").alias("spend"))
    return ranking.top_share(c, "spend", 10, "top_decile_share", "top_decile_customers", key="customer")


@question(
    "j_c07_best_month_vs_avg",
    """with m as (select store_id, date_trunc('month', ordered_at) as month, sum(subtotal) as cents
  from s_orders where ordered_at >= timestamp '1998-01-01' and ordered_at < timestamp '1999-01-01' group by 1, 2),
w as (select *, cast(sum(cents) over (partition by store_id) as double) / count(*) over (partition by store_id) / 100.0 as avg_month,
  rank() over (partition by store_id order by cents desc) as rk from m)
select s.name as store, cast(month as date) as best_month, cast(cents as double) / 100.0 as sales, avg_month,
  (cast(cents as double) / 100.0) / avg_month - 1 as above_avg
from w join s_stores s on s.id = w.store_id where rk = 1""",
    ("E11",),
)
def j_c07_best_month_vs_avg(spark, sf_dir):
    s = _shop(spark, sf_dir)
    m = periods.series(_orders_in(s, Y2025), "ordered_at", "month", ["store_id"], {"cents": F.sum("subtotal")}, name="best_month")
    best = ranking.best_vs_avg(m, ["store_id"], "cents", "__avg_cents", "__above")
    out = best.join(_store_names(s), "store_id")
    sales = dollars("cents")
    avg_month = F.col("__avg_cents") / 100.0
    return out.select("store", "best_month", sales.alias("sales"), avg_month.alias("avg_month"), (sales / avg_month - 1).alias("above_avg"))


@question(
    "j_c08_growth_streak",
    """with sales as (select year(ordered_at) * 12 + month(ordered_at) - 1 as k, sum(subtotal) as cents from s_orders
  where store_id = (select id from s_stores where name = 'NATION_7')
    and ordered_at >= timestamp '1996-06-01' and ordered_at < timestamp '1999-10-01' group by all),
steady as (select t.k, coalesce(cents, 0) as cents from range(1996 * 12 + 5, 1999 * 12 + 9) as t(k) left join sales on sales.k = t.k),
better as (select x.k from steady x, steady y where y.k = x.k - 1 and x.cents > y.cents),
run as (select k, k - row_number() over (order by k) as start from better)
select count(*) as streak_months, make_date(min(k) // 12, min(k) % 12 + 1, 1) as streak_start, make_date(max(k) // 12, max(k) % 12 + 1, 1) as streak_end
from run group by start order by streak_months desc, streak_start limit 1""",
    ("E9", "B6", "G1"),
)
def j_c08_growth_streak(spark, sf_dir):
    s = _shop(spark, sf_dir)
    store = s.stores.where(F.col("name") == BROOKLYN).select(F.col("id").alias("store_id"))
    o = s.orders_between(STREAK_FROM, STREAK_TO).join(bounded_broadcast(store, 1), "store_id", "left_semi")
    m = periods.series(o, "ordered_at", "month", [], {"sales": F.sum("subtotal")}, name="month")
    # a month without sales is a calendar month with 0 sales: it breaks a streak
    m = periods.fill_periods(m, spark, "month", STREAK_FROM, STREAK_LAST_MONTH, "month", ["sales"])
    m = periods.change(m, "month", "sales", "month", name="__chg")
    runs = periods.consecutive_periods(m, "month", F.col("__chg") > 0, name="__run").where(F.col("__run") > 0)
    streaks = runs.groupBy("__grp").agg(count_rows().alias("streak_months"), F.min("month").alias("streak_start"), F.max("month").alias("streak_end"))
    return ranking.order_limit(streaks, [F.col("streak_months").desc(), F.col("streak_start")], 1).select("streak_months", "streak_start", "streak_end")


@question(
    "j_c09_brooklyn_cogs_margin",
    """with u as (select sku, sum(cost) as unit_cogs from s_supplies group by 1),
l as (select i.sku from s_items i join s_orders o on o.id = i.order_id join s_stores s on s.id = o.store_id
  where s.name = 'NATION_7' and o.ordered_at >= timestamp '1998-01-01' and o.ordered_at < timestamp '1999-01-01')
select cast(sum(u.unit_cogs) as double) / 100.0 as cogs, cast(sum(p.price) as double) / 100.0 as product_sales,
  1 - cast(sum(u.unit_cogs) as double) / cast(sum(p.price) as double) as gross_margin
from l join s_products p on p.sku = l.sku join u on u.sku = l.sku""",
    ("C17", "D32"),
)
def j_c09_brooklyn_cogs_margin(spark, sf_dir):
    s = _shop(spark, sf_dir)
    store = s.stores.where(F.col("name") == BROOKLYN).select(F.col("id").alias("store_id"))
    o = _orders_in(s, Y2025).join(bounded_broadcast(store, 1), "store_id", "left_semi")
    units = s.items.join(o.select(F.col("id").alias("order_id")), "order_id").groupBy("sku").agg(count_rows().alias("units"))
    u = recipes.unit_cost(s.supplies_of(units), "sku", "cost", "unit_cogs")
    lines = units.join(s.products.select("sku", "price"), "sku").join(u, "sku")
    tot = lines.agg(F.sum(F.col("unit_cogs") * F.col("units")).alias("c"), F.sum(F.col("price") * F.col("units")).alias("p"))
    return tot.select(dollars("c").alias("cogs"), dollars("p").alias("product_sales"), (1 - ratio(F.col("c"), F.col("p"))).alias("gross_margin"))


@question(
    "j_c10_top_supply_component",
    """with used as (select sku, count(*) as units from s_items where order_id in (select id from s_orders where year(ordered_at) = 1998) group by sku)
select name as supply, cast(sum(cost * units) as double) / 100.0 as total_cost
from used join s_supplies using (sku) group by name order by total_cost desc, supply limit 1""",
    ("C19", "C17", "G4"),
)
def j_c10_top_supply_component(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = _orders_in(s, Y2025).select(F.col("id").alias("order_id"))
    # The intended fan-out items x components, pre-aggregated per sku so the join does not explode
    units = s.items.join(o, "order_id").groupBy("sku").agg(count_rows().alias("units"))
    used = s.supplies_of(units).join(units, "sku").groupBy("supplier").agg(F.sum(F.col("cost") * F.col("units")).alias("c"))
    parts = used.join(s.supplier_names, "supplier").groupBy(F.col("name").alias("supply")).agg(F.sum("c").alias("c"))
    return ranking.order_limit(parts.select("supply", dollars("c").alias("total_cost")), [F.col("total_cost").desc(), F.col("supply")], 1)


@question(
    "j_c11_tweeters_aov",
    """select segment, count(distinct customer) as customers, count(*) as orders, cast(sum(subtotal) as double) / 100.0 / count(*) as net_aov
from (select customer, subtotal,
        if(customer in (select user_id from s_tweets where year(tweeted_at) = 1998), 'tweeted', 'did not tweet') as segment
      from s_orders where year(ordered_at) = 1998)
group by segment""",
    ("C18",),
)
def j_c11_tweeters_aov(spark, sf_dir):
    s = _shop(spark, sf_dir)
    tweeters = s.tweets_between(Y2025)
    o = relations.flag_member(_orders_in(s, Y2025), "customer", tweeters, "user_id", "segment", "tweeted", "did not tweet")
    g = o.groupBy("segment").agg(F.count_distinct("customer").alias("customers"), count_rows().alias("orders"), F.sum("subtotal").alias("__c"))
    return g.select("segment", "customers", "orders", (dollars("__c") / F.col("orders")).alias("net_aov"))


@question(
    "j_c12_jaffle_beverage_attach",
    _BASKETS_SQL
    + """
select (select name from s_stores where s_stores.id = store_id) as store, count(*) as jaffle_orders,
  cast(count(*) filter (where list_contains(types, 'beverage')) as double) / count(*) as attach_rate
from sold where list_contains(types, 'jaffle') group by store_id""",
    ("D30",),
)
def j_c12_jaffle_beverage_attach(spark, sf_dir):
    s = _shop(spark, sf_dir)
    b = _baskets(s).join(_store_names(s), "store_id")
    return recipes.attach_rate(b, ["store"], "has_j", "has_b", "jaffle_orders", "attach_rate")


@question("j_q01_stores", "select name as store, cast(opened_at as date) as opened_on from s_stores", ("B1",))
def j_q01_stores(spark, sf_dir):
    s = _shop(spark, sf_dir)
    return grain.aggregate(s.stores.select(F.col("name").alias("store"), F.to_date("opened_at").alias("opened_on")), ["store", "opened_on"], {})


@question(
    "j_q02_orders_2025",
    "select count(*) as orders from s_orders where ordered_at >= timestamp '1998-01-01' and ordered_at < timestamp '1999-01-01'",
    ("D3", "B7"),
)
def j_q02_orders_2025(spark, sf_dir):
    return _orders_in(_shop(spark, sf_dir), Y2025).agg(count_rows().alias("orders"))


@question(
    "j_q03_revenue_by_store_2025",
    """select s.name as store, cast(sum(o.subtotal) as double) / 100.0 as revenue
from s_orders o join s_stores s on s.id = o.store_id
where o.ordered_at >= timestamp '1998-01-01' and o.ordered_at < timestamp '1999-01-01' group by s.name""",
    ("C1", "B15"),
)
def j_q03_revenue_by_store_2025(spark, sf_dir):
    s = _shop(spark, sf_dir)
    g = _orders_in(s, Y2025).groupBy("store_id").agg(F.sum("subtotal").alias("c"))  # aggregate before the join
    return g.join(_store_names(s), "store_id").groupBy("store").agg(dollars(F.sum("c")).alias("revenue"))


@question(
    "j_q04_monthly_orders_2026",
    """select cast(date_trunc('month', ordered_at) as date) as month, count(*) as orders
from s_orders where ordered_at >= timestamp '1999-01-01' group by 1""",
    ("F1", "D3"),
)
def j_q04_monthly_orders_2026(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = s.orders_between("1999-01-01", "9999-12-31")
    return periods.series(o, "ordered_at", "month", [], {"orders": count_rows()}, name="month")


@question(
    "j_q05_top_products_2025",
    """select p.name as product, p.type as type, count(*) as units_sold
from s_items i join s_orders o on o.id = i.order_id join s_products p on p.sku = i.sku
where o.ordered_at >= timestamp '1998-01-01' and o.ordered_at < timestamp '1999-01-01'
group by p.name, p.type order by units_sold desc, product, type limit 5""",
    ("G4", "C1"),
)
def j_q05_top_products_2025(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = _orders_in(s, Y2025).select(F.col("id").alias("order_id"))
    units = s.items.join(o, "order_id").groupBy("sku").agg(count_rows().alias("n"))  # pre-aggregate per sku
    g = units.join(s.products, "sku").groupBy(F.col("name").alias("product"), "type").agg(F.sum("n").cast("long").alias("units_sold"))
    return ranking.order_limit(g, [F.col("units_sold").desc(), F.col("product"), F.col("type")], 5)


@question(
    "j_q06_type_share_2025",
    """select p.type as type, cast(sum(p.price) as double) / 100.0 as sales,
  cast(sum(p.price) as double) / cast(sum(sum(p.price)) over () as double) as share
from s_items i join s_orders o on o.id = i.order_id join s_products p on p.sku = i.sku
where o.ordered_at >= timestamp '1998-01-01' and o.ordered_at < timestamp '1999-01-01' group by p.type""",
    ("D20", "C1"),
)
def j_q06_type_share_2025(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = _orders_in(s, Y2025).select(F.col("id").alias("order_id"))
    units = s.items.join(o, "order_id").groupBy("sku").agg(count_rows().alias("n"))
    g = units.join(s.products, "sku").groupBy("type").agg(F.sum(F.col("price") * F.col("n")).alias("c"))
    g = grain.share(g, "c", [], "share")
    return g.select("type", dollars("c").alias("sales"), "share")


@question(
    "j_q07_aov_by_store",
    """select s.name as store, cast(sum(o.subtotal) as double) / 100.0 / count(*) as aov
from s_orders o join s_stores s on s.id = o.store_id group by s.name""",
    ("D24",),
)
def j_q07_aov_by_store(spark, sf_dir):
    s = _shop(spark, sf_dir)
    g = s.orders.groupBy("store_id").agg(F.sum("subtotal").alias("c"), count_rows().alias("n")).join(_store_names(s), "store_id")
    return g.select("store", (dollars("c") / F.col("n")).alias("aov"))


@question(
    "j_q08_tax_rate_check",
    """select s.name as store, s.tax_rate as stated_rate, cast(sum(o.tax_paid) as double) / cast(sum(o.subtotal) as double) as collected_rate
from s_orders o join s_stores s on s.id = o.store_id group by s.name, s.tax_rate""",
    ("D25",),
)
def j_q08_tax_rate_check(spark, sf_dir):
    s = _shop(spark, sf_dir)
    g = s.orders.groupBy("store_id").agg(F.sum("tax_paid").alias("t"), F.sum("subtotal").alias("c"))
    st = bounded_broadcast(s.stores.select(F.col("id").alias("store_id"), F.col("name").alias("store"), F.col("tax_rate").alias("stated_rate")), Shop.STORE_ROWS)
    return g.join(st, "store_id").select("store", "stated_rate", ratio(F.col("t"), F.col("c")).alias("collected_rate"))


@question(
    "j_q09_store_growth_2024_2025",
    """select store, sales_2024, sales_2025, sales_2025 / sales_2024 - 1 as growth from (
  select any_value(s_stores.name) as store,
    cast(sum(subtotal) filter (where year(ordered_at) = 1997) as double) / 100.0 as sales_2024,
    cast(sum(subtotal) filter (where year(ordered_at) = 1998) as double) / 100.0 as sales_2025
  from s_stores join s_orders on store_id = s_stores.id group by store_id)
where sales_2024 is not null and sales_2025 is not null""",
    ("C16", "D17", "B11"),
)
def j_q09_store_growth_2024_2025(spark, sf_dir):
    s = _shop(spark, sf_dir)
    start, end = period_bounds(Y2024)[0], period_bounds(Y2025)[1]
    o = s.orders_between(start.isoformat(), end.isoformat())
    # both years in one pass: a filtered sum each
    y = o.groupBy("store_id").agg(*[agg_if(F.sum, "subtotal", _ts_in("ordered_at", p)).alias(f"c{p}") for p in (Y2024, Y2025)])
    y = y.where(F.col(f"c{Y2024}").isNotNull() & F.col(f"c{Y2025}").isNotNull())  # C16: present in both periods
    out = y.join(_store_names(s), "store_id").select("store", dollars(f"c{Y2024}").alias("sales_2024"), dollars(f"c{Y2025}").alias("sales_2025"))
    return out.withColumn("growth", ratio(F.col("sales_2025"), F.col("sales_2024")) - 1)


@question(
    "j_q10_new_customers_by_year",
    """with f as (select customer, min(ordered_at) as first_at from s_orders group by customer)
select year(first_at) as year, count(*) as new_customers from f group by 1""",
    ("D31",),
)
def j_q10_new_customers_by_year(spark, sf_dir):
    s = _shop(spark, sf_dir)
    n = recipes.new_entities(s.orders, "customer", "ordered_at", "year", "period", "new_customers")
    return n.select(F.year("period").cast("long").alias("year"), "new_customers")


@question(
    "j_q11_ytd_growth_same_store",
    """with last_day as (select cast(max(ordered_at) as date) as d from s_orders),
part as (select make_date(year(d) - n, 1, 1) as since, cast(d + 1 - to_years(n) as date) as until, n from last_day, (values (0), (1)) as t(n)),
shop as (select s.id, s.opened_at < (select since from part where n = 1) as old from s_stores s),
total as (select n, old, sum(subtotal) as cents from s_orders o join shop on shop.id = o.store_id
  join part on o.ordered_at >= since and o.ordered_at < until group by n, old),
t as (select cast(sum(cents) filter (where n = 1) as double) / 100.0 as a, cast(sum(cents) filter (where n = 0) as double) / 100.0 as b,
  cast(sum(cents) filter (where n = 1 and old) as double) / 100.0 as c, cast(sum(cents) filter (where n = 0 and old) as double) / 100.0 as d from total)
select a as ytd_prev, b as ytd_cur, b / a - 1 as headline_growth, c as ss_prev, d as ss_cur, d / c - 1 as same_store_growth from t""",
    ("D33", "D34", "D17"),
)
def j_q11_ytd_growth_same_store(spark, sf_dir):
    s = _shop(spark, sf_dir)
    o = s.orders.join(bounded_broadcast(s.stores.select(F.col("id").alias("store_id"), "opened_at"), Shop.STORE_ROWS), "store_id")
    return recipes.comparable_growth(o, "subtotal", "ordered_at", "opened_at", s.orders)


@question(
    "j_q12_best_unit_margin",
    """with priced as (select name, price, (select sum(cost) from s_supplies x where x.sku = p.sku) as spent from s_products p)
select name as product, cast(price - spent as double) / 100.0 as unit_margin, cast(price - spent as double) / cast(price as double) as margin_pct
from priced where spent is not null""",
    ("D25", "D32"),
)
def j_q12_best_unit_margin(spark, sf_dir):
    s = _shop(spark, sf_dir)
    u = recipes.unit_cost(s.supplies_of(), "sku", "cost", "unit_cogs")
    p = s.products.join(u, "sku")
    m = F.col("price") - F.col("unit_cogs")
    return p.select(F.col("name").alias("product"), dollars(m).alias("unit_margin"), ratio(m, F.col("price")).alias("margin_pct"))
