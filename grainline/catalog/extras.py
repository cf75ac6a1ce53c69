"""Questions for operators the reference names but does not use in a task.

Each reads the bound tables. Aggregates whose floating-point result depends on the summation order
(variance, correlation) or that are approximate (HyperLogLog, percentile sketches) are registered
without an oracle; ``tests/test_extras.py`` compares them with DuckDB within a tolerance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.catalog.bench import Y2025, _bench
from grainline.catalog.registry import question
from grainline.functions.aggregates import aggregate, agg_template, count_rows, first_by_time, last_by_time, weighted_avg
from grainline.functions.calendar import custom_bucket, date_add_unit, date_diff_unit, in_period, last_complete
from grainline.functions.scalar import ratio
from grainline.functions.text import missing_markers
from grainline.operators import grain, periods, ranking, recipes
from grainline.sources.bindings import Shop, Tables

FISCAL_ORIGIN = "1995-04-01"  # fixed: a fiscal year of 12 months starting in April
QUARTER_HOUR_ORIGIN = "2000-01-01"
DUE_DAYS = 30


def _order_key(date_col: str, id_col: str):
    return F.struct(F.col(date_col), F.col(id_col))


@question(
    "d_exact_stats_by_status",
    """select status, count(*) as orders, count(distinct customer_id) as customers,
  cast(min(amount) as double) as min_amount, cast(max(amount) as double) as max_amount,
  median(cast(amount * 100 as bigint)) as median_cents,
  arg_min(id, struct_pack(d := order_date, i := id)) as first_order, arg_max(id, struct_pack(d := order_date, i := id)) as last_order,
  cast(sum(amount) as double) / 100.0 as sum_hundreds
from b_orders group by 1""",
    ("D3", "D5", "D7", "D8", "D10", "D16"),
)
def d_exact_stats_by_status(spark, sf_dir):
    b = _bench(spark, sf_dir)
    hundreds = agg_template(lambda v: F.sum(v).cast("double") / 100.0)  # D16: a template aggregation
    stats = b.orders.groupBy("status").agg(
        count_rows().alias("orders"),
        aggregate("count_distinct", "customer_id").alias("customers"),
        aggregate("min", "amount").cast("double").alias("min_amount"),
        aggregate("max", "amount").cast("double").alias("max_amount"),
        first_by_time("id", _order_key("order_date", "id")).alias("first_order"),
        last_by_time("id", _order_key("order_date", "id")).alias("last_order"),
        hundreds("amount").alias("sum_hundreds"),
    )
    # amounts are nearly unique: the median comes from ranks, not from a per-group value map
    cents = b.orders.select("status", (F.col("amount") * 100).cast("long").alias("cents"))
    median = ranking.percentile_by_rank(cents, ["status"], "cents", 0.5, "median_cents")
    return stats.join(median, "status")


@question("d_dispersion_by_status", None, ("D9", "D11", "D12", "D13", "D14", "D6"))
def d_dispersion_by_status(spark, sf_dir):
    """Order-dependent floating-point and approximate aggregates per status (no bit-exact SQL twin)."""
    b = _bench(spark, sf_dir)
    o = b.orders.join(b.customers.select(F.col("id").alias("__c"), "credit"), F.col("customer_id") == F.col("__c"), "left")
    a, c = F.col("amount").cast("double"), F.col("credit").cast("double")
    # exact p90 of near-unique amounts from ranks (an exact percentile aggregate would hold every
    # distinct amount of a status in one task)
    p90 = ranking.percentile_by_rank(o.select("status", a.alias("a")), ["status"], "a", 0.9, "p90_amount")
    stats = o.groupBy("status").agg(
        aggregate("stddev_pop", a).alias("stddev_pop"),
        aggregate("stddev_samp", a).alias("stddev_samp"),
        aggregate("var_pop", a).alias("var_pop"),
        aggregate("var_samp", a).alias("var_samp"),
        aggregate("corr", a, c).alias("corr_amount_credit"),
        aggregate("covar_pop", a, c).alias("covar_pop"),
        aggregate("covar_samp", a, c).alias("covar_samp"),
        aggregate("percentile_approx", a, 0.9).alias("p90_amount_approx"),
        aggregate("count_distinct_approx", "customer_id").alias("customers_approx"),
    )
    return stats.join(p90, "status")


@question(
    "d15_weighted_credit_by_tier",
    """with n as (select customer_id, count(*) as n from b_orders group by 1)
select c.tier, cast(sum(c.credit * n.n) as double) / cast(sum(n.n) as double) as order_weighted_credit
from b_customers c join n on n.customer_id = c.id group by 1""",
    ("D15",),
)
def d15_weighted_credit_by_tier(spark, sf_dir):
    """Customer credit averaged with each customer weighted by their number of orders."""
    b = _bench(spark, sf_dir)
    n = b.orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(count_rows().alias("n"))
    c = b.customers.join(n, F.col("id") == F.col("customer_id"))
    return c.groupBy("tier").agg(weighted_avg("credit", "n").alias("order_weighted_credit"))


@question(
    "e4_monthly_change_pct",
    """with m as (select date_trunc('month', order_date)::date as month, sum(amount) as revenue from b_orders group by 1)
select a.month, cast(a.revenue as double) / cast(b.revenue as double) - 1 as revenue_change_pct
from m a left join m b on b.month = a.month - interval 1 month
where a.month >= date '1997-07-01' and a.month < date '1998-01-01'""",
    ("E4", "S5"),
)
def e4_monthly_change_pct(spark, sf_dir):
    """Month-over-month growth; the month after the empty month has no previous period (NULL)."""
    s = periods.series(_bench(spark, sf_dir).orders_in(["1997-06", "1997-12"]), "order_date", "month", [], {"revenue": F.sum("amount")}, name="month")
    s = periods.change_pct(s, "month", "revenue", "month", name="revenue_change_pct")
    return periods.clip(s, "month", ["1997-07-01", "1997-12-31"]).select("month", "revenue_change_pct")


@question(
    "f2_fiscal_year_revenue",
    f"""select cast(date '{FISCAL_ORIGIN}' + to_months(cast(floor(datediff('month', date '{FISCAL_ORIGIN}', date_trunc('month', order_date)) / 12.0) * 12 as integer)) as date)
    as fiscal_year, cast(sum(amount) as double) as revenue
from b_orders group by 1""",
    ("F2",),
)
def f2_fiscal_year_revenue(spark, sf_dir):
    o = _bench(spark, sf_dir).orders
    return o.groupBy(custom_bucket("order_date", "year", 1, FISCAL_ORIGIN).alias("fiscal_year")).agg(F.sum("amount").cast("double").alias("revenue"))


@question(
    "f2_quarter_hour_events",
    f"""select timestamp '{QUARTER_HOUR_ORIGIN}' + to_microseconds(cast(floor(date_diff('microsecond', timestamp '{QUARTER_HOUR_ORIGIN}', event_ts) / 900000000.0) as bigint) * 900000000)
    as quarter_hour, count(*) as events, cast(sum(amount) as double) as total_amount
from b_events group by 1""",
    ("F2", "T1"),
)
def f2_quarter_hour_events(spark, sf_dir):
    e = _bench(spark, sf_dir).events
    qh = custom_bucket("event_ts", "minute", 15, QUARTER_HOUR_ORIGIN).alias("quarter_hour")
    return e.groupBy(qh).agg(count_rows().alias("events"), F.sum("amount").cast("double").alias("total_amount"))


@question(
    "f5_whole_weeks_events",
    """with b as (select cast(min(event_ts) as date) as lo, cast(max(event_ts) as date) + 1 as hi from b_events),
w as (select date_trunc('week', event_ts)::date as week, count(*) as events from b_events group by 1)
select w.week, w.events from w, b where w.week >= b.lo and w.week + 7 <= b.hi""",
    ("F5",),
)
def f5_whole_weeks_events(spark, sf_dir):
    e = _bench(spark, sf_dir).events
    s = periods.series(e, "event_ts", "week", [], {"events": count_rows()}, name="week")
    return periods.whole_periods_only(s, "week", "week", e, "event_ts").df


@question(
    "b6_ship_lag_by_month",
    f"""select date_trunc('month', o.order_date)::date as month, count(*) as lines,
  cast(sum(date_diff('day', o.order_date, cast(l.l_shipdate as date))) as double) / count(*) as avg_days_to_ship,
  count(*) filter (where cast(l.l_shipdate as date) > o.order_date + interval {DUE_DAYS} day) as shipped_late
from lineitem l join b_orders o on o.id = l.l_orderkey
where o.order_date >= date '1998-01-01' and o.order_date < date '1999-01-01' group by 1""",
    ("B6", "B6b"),
)
def b6_ship_lag_by_month(spark, sf_dir):
    b = _bench(spark, sf_dir)
    li = Tables(spark, sf_dir)("lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("ship_date"))
    o = b.orders_in(Y2025).select("id", "order_date")
    j = li.join(o, F.col("l_orderkey") == F.col("id"))
    days = date_diff_unit("ship_date", "order_date", "day")
    late = F.col("ship_date") > date_add_unit("order_date", DUE_DAYS, "day")
    return j.groupBy(F.trunc("order_date", "month").alias("month")).agg(
        count_rows().alias("lines"), ratio(F.sum(days), count_rows()).alias("avg_days_to_ship"), F.count(F.when(late, 1)).alias("shipped_late")
    )


@question(
    "f7_orders_and_returns_by_month",
    """with sp as (select cast(unnest(generate_series(date '1997-01-01', date '1997-12-01', interval 1 month)) as date) as month),
o as (select date_trunc('month', order_date)::date as month, sum(amount) as ordered from b_orders group by 1),
r as (select date_trunc('month', return_date)::date as month, sum(amount) as returned from b_returns group by 1)
select sp.month, cast(coalesce(o.ordered, 0) as double) as ordered, cast(coalesce(r.returned, 0) as double) as returned
from sp left join o on o.month = sp.month left join r on r.month = sp.month""",
    ("F7", "F3", "A10", "C3"),
)
def f7_orders_and_returns_by_month(spark, sf_dir):
    """Two facts, each through its own time column, aligned on one month spine (the empty month shows 0 ordered)."""
    b = _bench(spark, sf_dir)
    o = periods.series(b.orders_in("1997"), "order_date", "month", [], {"ordered": F.sum("amount")}, name="month")
    r = periods.series(b.returns.where(in_period("return_date", "1997")), "return_date", "month", [], {"returned": F.sum("amount")}, name="month")
    s = periods.spine(spark, "1997-01-01", "1997-12-01", "month", "month")
    out = grain.multi_fact(s, ["month"], [o, r])
    return out.select("month", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("ordered", "returned")])


@question(
    "d_dispersion_rounded",
    """select o.status, round(avg(o.amount), 3) as avg_amount, round(stddev_pop(o.amount::double), 3) as stddev_pop,
  round(stddev_samp(o.amount::double), 3) as stddev_samp, round(var_pop(o.amount::double) / 1e6, 4) as var_pop_m,
  round(var_samp(o.amount::double) / 1e6, 4) as var_samp_m, round(corr(o.amount::double, c.credit::double), 8) as corr_amount_credit,
  round(covar_pop(o.amount::double, c.credit::double) / 1e6, 4) as covar_pop_m,
  round(covar_samp(o.amount::double, c.credit::double) / 1e6, 4) as covar_samp_m,
  round(quantile_cont(o.amount::double, 0.9), 3) as p90_amount, true as p90_approx_near, true as customers_approx_near
from b_orders o left join b_customers c on c.id = o.customer_id group by 1""",
    ("D2", "D6", "D9", "D11", "D12", "D13", "D14"),
)
def d_dispersion_rounded(spark, sf_dir):
    """Dispersion per status from sums per (status, customer); approximations as being near the exact value."""
    b = _bench(spark, sf_dir)
    a, known = F.col("amount"), F.col("credit").isNotNull()
    per = b.orders.groupBy("status", "customer_id").agg(count_rows().alias("n"), F.sum(a).alias("s"), F.sum(a.cast("double") * a.cast("double")).alias("q"))
    j = per.join(b.customers.select(F.col("id").alias("customer_id"), "credit"), "customer_id", "left")
    c, n, s = F.col("credit").cast("double"), F.col("n"), F.col("s").cast("double")
    g = j.groupBy("status").agg(
        F.sum("n").alias("n"),
        F.sum("s").cast("double").alias("s"),
        F.sum("q").alias("q"),
        F.count("customer_id").alias("d"),
        F.sum(F.when(known, n)).alias("k"),
        F.sum(F.when(known, F.col("s"))).cast("double").alias("ks"),
        F.sum(F.when(known, F.col("q"))).alias("kq"),
        F.sum(n * c).alias("kc"),
        F.sum(n * c * c).alias("kcc"),
        F.sum(s * c).alias("x"),
    )
    cents = b.orders.select("status", a.cast("double").alias("a"))
    p90 = ranking.percentile_by_rank(cents, ["status"], "a", 0.9, "p90")
    approx = b.orders.groupBy("status").agg(
        aggregate("avg", a.cast("double")).alias("avg"),
        aggregate("percentile_approx", a.cast("double"), 0.9).alias("p90_approx"),
        aggregate("count_distinct_approx", "customer_id").alias("d_approx"),
    )
    g = g.join(p90, "status").join(approx, "status")
    col = F.col
    var = col("q") / col("n") - F.pow(col("s") / col("n"), 2)
    samp = var * col("n") / (col("n") - 1)
    cov = col("x") / col("k") - (col("ks") / col("k")) * (col("kc") / col("k"))
    var_a = col("kq") / col("k") - F.pow(col("ks") / col("k"), 2)
    var_c = col("kcc") / col("k") - F.pow(col("kc") / col("k"), 2)
    near = lambda x, y, tol: F.abs(col(x) - col(y)) <= tol * col(y)
    return g.select(
        "status",
        F.round("avg", 3).alias("avg_amount"),
        F.round(F.sqrt(var), 3).alias("stddev_pop"),
        F.round(F.sqrt(samp), 3).alias("stddev_samp"),
        F.round(var / 1e6, 4).alias("var_pop_m"),
        F.round(samp / 1e6, 4).alias("var_samp_m"),
        F.round(cov / F.sqrt(var_a * var_c), 8).alias("corr_amount_credit"),
        F.round(cov / 1e6, 4).alias("covar_pop_m"),
        F.round(cov * col("k") / (col("k") - 1) / 1e6, 4).alias("covar_samp_m"),
        F.round("p90", 3).alias("p90_amount"),
        near("p90_approx", "p90", 0.01).alias("p90_approx_near"),
        near("d_approx", "d", 0.15).alias("customers_approx_near"),
    )


@question(
    "d31b_returning_customers_by_year",
    """with y as (select distinct customer, year(ordered_at) as y from s_orders),
f as (select customer, min(y) as first from y group by 1)
select make_date(y, 1, 1) as year, count(*) filter (where y > first) as returning from y join f using (customer) group by y""",
    ("D31b",),
)
def d31b_returning_customers_by_year(spark, sf_dir):
    o = Shop(spark, sf_dir).orders.select("customer", F.to_date("ordered_at").alias("day"))
    return recipes.returning_entities(o, "customer", "day", "year", "year", "returning")


@question(
    "g5_second_page_of_cities",
    "select city, cast(sum(amount) as double) as revenue from b_orders_flat where city is not null group by city order by sum(amount) desc, city limit 5 offset 5",
    ("G5", "G4"),
)
def g5_second_page_of_cities(spark, sf_dir):
    b = _bench(spark, sf_dir)
    g = grain.eager_aggregate(b.orders, "customer_id", b.customer_dims, "id", ["city"], {"__s": F.sum("amount")}, {"revenue": F.sum("__s")})
    page = ranking.order_limit(g.where(F.col("city").isNotNull()), [F.col("revenue").desc(), F.col("city")], 5, 5)
    return page.select("city", F.col("revenue").cast("double").alias("revenue"))


@question(
    "b18_documents_without_markers",
    """with d as (select doc_id, regexp_replace(text, '\\s+', '', 'g') as t, unnest(['en', 'fr', 'de']) as label from documents)
select doc_id, label from d where (label = 'en' and not contains(t, 'the')) or (label = 'fr' and not contains(t, 'é') and not contains(t, 'eau'))""",
    ("B18",),
)
def b18_documents_without_markers(spark, sf_dir):
    """Documents whose text lacks every marker of a language; German has none listed and is never reported."""
    d = Tables(spark, sf_dir)("documents").withColumn("labels", F.array(F.lit("en"), F.lit("fr"), F.lit("de")))
    return missing_markers(d, "doc_id", "text", "labels", {"en": ("the",), "fr": ("é", "eau"), "de": ()})


@question(
    "b10_last_two_weeks",
    """select count(*) as events, cast(sum(amount) as double) as total_amount from b_events
where event_ts >= timestamp '2024-01-08' and event_ts < timestamp '2024-01-22'""",
    ("B10",),
)
def b10_last_two_weeks(spark, sf_dir):
    e = _bench(spark, sf_dir).events.where(last_complete("event_ts", 2, "week", as_of="2024-01-24", col_type="timestamp_ntz"))
    return e.agg(count_rows().alias("events"), F.sum("amount").cast("double").alias("total_amount"))
