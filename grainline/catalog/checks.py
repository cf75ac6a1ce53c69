"""Dataset checks and reconciliation questions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.catalog.bench import BAD, EMAIL, _bench, t_chasm
from grainline.catalog.registry import question
from grainline.functions.aggregates import count_rows
from grainline.functions.calendar import in_period, in_range
from grainline.operators import checks, recon, relations
from grainline.sources.bindings import MONEY, Tables

REBASE_ANCHOR = "2026-10-29"  # fixed: the day the latest fact is moved to


@question(
    "n1_rebase_dates",
    f"""with d as (select cast(date '{REBASE_ANCHOR}' - cast(greatest((select max(order_date) from b_orders), (select max(return_date) from b_returns)) as date) as integer) as delta)
select 'orders' as table_name, min(order_date + delta) as first_day, max(order_date + delta) as last_day, count(*) as rows from b_orders, d
union all
select 'returns', min(return_date + delta), max(return_date + delta), count(*) from b_returns, d""",
    ("N1",),
)
def n1_rebase_dates(spark, sf_dir):
    b = _bench(spark, sf_dir)
    out = checks.rebase_dates({"orders": (b.orders, ["order_date"]), "returns": (b.returns, ["return_date"])}, REBASE_ANCHOR)
    parts = [
        out[t].agg(F.lit(t).alias("table_name"), F.min(c).alias("first_day"), F.max(c).alias("last_day"), count_rows().alias("rows"))
        for t, c in (("orders", "order_date"), ("returns", "return_date"))
    ]
    return parts[0].unionByName(parts[1])


@question(
    "n2_header_vs_lines",
    """with per as (select order_id, sum(line_amount) as lines_total from b_order_items group by 1)
select o.id, cast(o.amount as double) as header_total, cast(coalesce(per.lines_total, 0) as double) as lines_total,
  cast(o.amount - coalesce(per.lines_total, 0) as double) as diff
from b_orders o left join per on per.order_id = o.id
where abs(o.amount - coalesce(per.lines_total, 0)) > 0.005""",
    ("N2",),
)
def n2_header_vs_lines(spark, sf_dir):
    b = _bench(spark, sf_dir)
    bad = checks.header_vs_lines(b.orders, "id", "amount", b.order_items, "order_id", "line_amount")
    return bad.select("id", F.col("header_total").cast("double").alias("header_total"), F.col("lines_total").cast("double").alias("lines_total"), "diff")


@question(
    "n3_edge_census",
    f"""select 'regions_without_customers' as "check", count(*) as witnesses from b_regions r
  where not exists (select 1 from b_customers c where c.region_id = r.id)
union all select 'customers_null_region', count(*) from b_customers where region_id is null
union all select 'customers_without_orders', count(*) from b_customers c where not exists (select 1 from b_orders o where o.customer_id = c.id)
union all select 'orders_without_customer', count(*) from b_orders where customer_id is null
union all select 'returns_without_customer', count(*) from b_returns where customer_id is null
union all select 'months_1997_with_orders', count(distinct date_trunc('month', order_date)) from b_orders
  where order_date >= date '1997-01-01' and order_date < date '1998-01-01'
union all select 'returns_in_empty_month', count(*) from b_returns where return_date >= date '1997-08-01' and return_date < date '1997-09-01'
union all select 'customers_never_returned', count(*) from b_customers c where not exists (select 1 from b_returns r where r.customer_id = c.id)
union all select 'cities_in_two_regions', count(*) from (select city from b_cities group by 1 having count(distinct region_id) > 1)
union all select 'orders_city_missing', count(*) from b_orders o left join b_customers c on c.id = o.customer_id
  where not exists (select 1 from b_cities ci where ci.city = c.city and ci.region_id = c.region_id)
union all select 'customers_in_two_email_campaigns', count(*) from (select m.customer_id from b_members m join b_campaigns ca on ca.id = m.campaign_id
  where ca.channel = '{EMAIL}' group by 1 having count(*) >= 2)
union all select 'orders_without_lines', count(*) from b_orders o where not exists (select 1 from b_order_items i where i.order_id = o.id)
union all select 'events_week_half_open', count(*) from b_events where event_ts >= timestamp '2024-01-08' and event_ts < timestamp '2024-01-15'
union all select 'events_week_between', count(*) from b_events where event_ts between timestamp '2024-01-08' and timestamp '2024-01-14'""",
    ("N3",),
)
def n3_edge_census(spark, sf_dir):
    b = _bench(spark, sf_dir)
    email = b.campaigns.where(F.col("channel") == EMAIL).select(F.col("id").alias("__cid"))
    in_email = b.members.join(email, F.col("campaign_id") == F.col("__cid"), "left_semi")
    oc = b.orders.join(b.customers.select(F.col("id").alias("__c"), "city", "region_id"), F.col("customer_id") == F.col("__c"), "left")
    e = b.events
    return checks.census(
        {
            "regions_without_customers": relations.where_none(b.regions, "id", b.customers, "region_id"),
            "customers_null_region": b.customers.where(F.col("region_id").isNull()),
            "customers_without_orders": relations.where_none(b.customers, "id", b.orders, "customer_id"),
            "orders_without_customer": b.orders.where(F.col("customer_id").isNull()),
            "returns_without_customer": b.returns.where(F.col("customer_id").isNull()),
            "months_1997_with_orders": b.orders_in("1997").select(F.trunc("order_date", "month")).distinct(),
            "returns_in_empty_month": b.returns.where(in_period("return_date", "1997-08")),
            "customers_never_returned": relations.where_none(b.customers, "id", b.returns, "customer_id"),
            "cities_in_two_regions": b.cities.groupBy("city").agg(F.count_distinct("region_id").alias("n")).where(F.col("n") > 1),
            "orders_city_missing": relations.where_none(oc, ["city", "region_id"], b.cities, ["city", "region_id"]),
            "customers_in_two_email_campaigns": in_email.groupBy("customer_id").agg(count_rows().alias("n")).where(F.col("n") >= 2),
            "orders_without_lines": relations.where_none(b.orders, "id", b.order_items, "order_id"),
            "events_week_half_open": e.where(in_range("event_ts", ["2024-01-08", "2024-01-14"], "timestamp_ntz")),
            "events_week_between": e.where(F.col("event_ts").between(F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-14").cast("timestamp_ntz"))),
        }
    )


@question(
    "n4_calendar_gaps",
    """select cast(m as date) as period from unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 month)) t(m)
where cast(m as date) not in (select distinct date_trunc('month', order_date)::date from b_orders)""",
    ("N4", "A10"),
)
def n4_calendar_gaps(spark, sf_dir):
    b = _bench(spark, sf_dir)
    return checks.calendar_gaps(spark, b.orders, "order_date", "month", "1995-01-01", "2001-08-01")


@question(
    "n5_key_checks",
    """select 'orders.id duplicates' as "check", count(*) as violations from (select id from b_orders group by 1 having count(*) > 1)
union all select 'customers.id duplicates', count(*) from (select id from b_customers group by 1 having count(*) > 1)
union all select 'cities.(city, region_id) duplicates', count(*) from (select city, region_id from b_cities group by 1, 2 having count(*) > 1)
union all select 'lineitem.(l_orderkey, l_linenumber) duplicates', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)
union all select 'orders.customer_id orphans', count(*) from b_orders o where o.customer_id is not null and not exists (select 1 from b_customers c where c.id = o.customer_id)
union all select 'order_items.product_id orphans', count(*) from b_order_items i where i.product_id is not null and not exists (select 1 from b_products p where p.id = i.product_id)
union all select 'members.campaign_id orphans', count(*) from b_members m where m.campaign_id is not null and not exists (select 1 from b_campaigns c where c.id = m.campaign_id)
union all select 'customers.region_id orphans', count(*) from b_customers c where c.region_id is not null and not exists (select 1 from b_regions r where r.id = c.region_id)""",
    ("N5",),
)
def n5_key_checks(spark, sf_dir):
    b = _bench(spark, sf_dir)
    li = Tables(spark, sf_dir)("lineitem")
    found = {
        "orders.id duplicates": checks.duplicate_keys(b.orders, ["id"]),
        "customers.id duplicates": checks.duplicate_keys(b.customers, ["id"]),
        "cities.(city, region_id) duplicates": checks.duplicate_keys(b.cities, ["city", "region_id"]),
        "lineitem.(l_orderkey, l_linenumber) duplicates": checks.duplicate_keys(li, ["l_orderkey", "l_linenumber"]),
        "orders.customer_id orphans": checks.orphans(b.orders, ["customer_id"], b.customers, ["id"]),
        "order_items.product_id orphans": checks.orphans(b.order_items, ["product_id"], b.products, ["id"]),
        "members.campaign_id orphans": checks.orphans(b.members, ["campaign_id"], b.campaigns, ["id"]),
        "customers.region_id orphans": checks.orphans(b.customers, ["region_id"], b.regions, ["id"]),
    }
    return checks.census(found).withColumnRenamed("witnesses", "violations")


@question(
    "n6_profile_orders",
    """select 'id' as "column", count(*) as rows, count(id) as non_null, cast(min(id) as varchar) as min_value, cast(max(id) as varchar) as max_value,
  count(distinct id) as distinct_values from b_orders
union all select 'customer_id', count(*), count(customer_id), cast(min(customer_id) as varchar), cast(max(customer_id) as varchar), count(distinct customer_id) from b_orders
union all select 'amount', count(*), count(amount), cast(min(amount) as varchar), cast(max(amount) as varchar), count(distinct amount) from b_orders
union all select 'status', count(*), count(status), min(status), max(status), count(distinct status) from b_orders
union all select 'order_date', count(*), count(order_date), cast(min(order_date) as varchar), cast(max(order_date) as varchar), count(distinct order_date) from b_orders""",
    ("N6",),
)
def n6_profile_orders(spark, sf_dir):
    b = _bench(spark, sf_dir)
    return checks.profile(b.orders).drop("is_unique")


@question(
    "n7_allocate_by_lines",
    """with n as (select order_id, count(*) as n from b_order_items group by 1),
c as (select o.id, cast(o.amount * 100 as bigint) as c, n.n from b_orders o join n on n.order_id = o.id)
select id, cast(p as bigint) as part_no,
  cast(case when p = n then c - (c // n) * (n - 1) else c // n end as bigint) as part_cents
from c, unnest(generate_series(1, n)) as t(p)""",
    ("N7",),
)
def n7_allocate_by_lines(spark, sf_dir):
    b = _bench(spark, sf_dir)
    n = b.order_items.groupBy(F.col("order_id").alias("id")).agg(count_rows().alias("n"))
    o = b.orders.join(n, "id")
    return checks.allocate(o, "id", F.col("amount") * 100, F.col("n"))


@question(
    "i1_orders_drift",
    f"""with raw as (select o_orderkey as id, o_custkey as customer_id, cast(o_totalprice as decimal(18,2)) as amount, o_orderstatus as status,
  cast(o_orderdate as date) as order_date from orders)
select coalesce(r.id, b.id) as id,
  case when b.id is null then 'missing' when r.id is null then 'stale' else 'changed' end as status
from raw r full outer join b_orders b on r.id = b.id
where b.id is null or r.id is null or r.customer_id is distinct from b.customer_id or r.amount <> b.amount
  or r.status <> b.status or r.order_date <> b.order_date""",
    ("I1", "K7"),
)
def i1_orders_drift(spark, sf_dir):
    """Drift of the bound orders against the raw table: removed (missing), planted NULLs (changed)."""
    o = Tables(spark, sf_dir)("orders")
    raw = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("order_date"),
    )
    return recon.drift(raw, _bench(spark, sf_dir).orders, ["id"])


@question(
    "k9_chasm_liveness",
    """with home as (select cu.id, re.name as region from b_customers cu left join b_regions re on re.id = cu.region_id),
o as (select customer_id as id, sum(amount) as s, count(*) as n from b_orders group by 1),
t as (select customer_id as id, sum(amount) as s, count(*) as n from b_returns group by 1),
naive as (select region, sum(o.s * greatest(coalesce(t.n, 0), 1)) as ordered, sum(t.s * greatest(coalesce(o.n, 0), 1)) as returned
  from home left join o using (id) left join t using (id) group by region),
fact as (select customer_id as id, amount as a, null as b from b_orders union all select customer_id, null, amount from b_returns
  union all select id, null, null from b_customers),
truth as (select region, sum(a) as ordered, sum(b) as returned, count(home.id) as people from fact left join home using (id) group by region)
select region, 'changed' as status from truth join naive using (region)
where people > 0 and (truth.ordered is distinct from naive.ordered or truth.returned is distinct from naive.returned)
union all select null, 'changed' from (select * from truth where region is null) a, (select * from naive where region is null) b
where a.ordered is distinct from b.ordered or a.returned is distinct from b.returned""",
    ("K9", "K2", "I1"),
)
def k9_chasm_liveness(spark, sf_dir):
    """The chasm trap is live: the naive single-join answer differs from the truth (region, kind of difference).

    A customer's orders times their returns is what the naive join would make; here its sums come from the
    per-customer sums and counts (each order would count once per return and the other way round).
    """
    b = _bench(spark, sf_dir)
    truth = t_chasm(spark, sf_dir)

    def per_customer(facts, total, n):
        known = facts.where(F.col("customer_id").isNotNull())
        return known.groupBy(F.col("customer_id").alias("id")).agg(F.sum("amount").alias(total), F.count(F.lit(1)).alias(n))

    c = b.customer_dims.select("id", "region")
    c = c.join(per_customer(b.orders, "__os", "__on"), "id", "left").join(per_customer(b.returns, "__rs", "__rn"), "id", "left")
    times = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(1))
    naive = c.groupBy("region").agg(
        F.sum(F.col("__os") * times("__rn")).cast("double").alias("ordered"),
        F.sum(F.col("__rs") * times("__on")).cast("double").alias("returned"),
    )
    return recon.drift(truth, naive, ["region"], tol=0.0)


@question("k8_table_fingerprints", None, ("K8",))
def k8_table_fingerprints(spark, sf_dir):
    """Order-insensitive content hash of every given table (Spark's xxhash64; no SQL twin in DuckDB)."""
    t = Tables(spark, sf_dir)
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    parts = [recon.content_hash(t(n)).select(F.lit(n).alias("table_name"), "rows", "hash") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@question(
    "n_bad_orders_by_tier",
    f"""select c.tier, count(*) as bad_orders from b_orders o join b_customers c on c.id = o.customer_id where o.status = '{BAD}' group by 1""",
    ("B7", "C1"),
)
def n_bad_orders_by_tier(spark, sf_dir):
    """Orders (not customers) with the 'bad' status per tier: the per-order count beside t_count_after_join."""
    b = _bench(spark, sf_dir)
    o = b.orders.where(F.col("status") == BAD).join(b.customers.select(F.col("id").alias("__c"), "tier"), F.col("customer_id") == F.col("__c"))
    return o.groupBy("tier").agg(count_rows().alias("bad_orders"))


def _sample_sql(col: str) -> str:
    return f"""select '{col}' as "column", case when count(*) > 50 then '50+ distinct'
  else coalesce(string_agg(cast(v as varchar), ', ' order by v), '') end as sample_values
from (select distinct {col} as v from b_orders where {col} is not null order by v limit 51)"""


@question(
    "n6_orders_value_sample",
    "\nunion all\n".join(_sample_sql(c) for c in ("status", "order_date", "customer_id")),
    ("N6",),
)
def n6_orders_value_sample(spark, sf_dir):
    """The inspection view of a model: a few distinct values of each column, or '50+ distinct'."""
    return checks.value_sample(_bench(spark, sf_dir).orders, ["status", "order_date", "customer_id"])


@question(
    "k2_customers_against_copies",
    """select case_name, n, expected as ok from (select count(*) as n from b_customers),
  (values ('renamed, as text, jittered', true), ('one credit changed', false), ('columns by values', true), ('null as zero', true), ('null is not zero', false)) v(case_name, expected)""",
    ("K1", "K2", "K3", "K5", "K6", "B19"),
)
def k2_customers_against_copies(spark, sf_dir):
    """The customer table against re-typed, renamed, jittered and changed copies of itself: does the match see it?"""
    c = _bench(spark, sf_dir).customers.select("id", "region_id", "tier", F.col("credit").cast("double").alias("credit"))
    text = c.select(
        F.col("id").cast("string").alias("customers.id"),
        F.col("region_id").alias("customers.regions__region_id"),
        "tier",
        (F.col("credit") * (1 + (F.col("id") % 7 - 3) * F.lit(1e-10))).cast("string").alias("credit"),
    )
    last = c.agg(F.max("id")).scalar()
    changed = c.withColumn("credit", F.col("credit") + F.when(F.col("id") == last, 1.0).otherwise(0.0))
    unnamed = c.select(F.col("tier").alias("c1"), F.col("credit").alias("total_credit"), F.col("id").alias("c3"), F.col("region_id").alias("c4"))
    zero = c.withColumn("region_id", F.coalesce("region_id", F.lit(0)))
    found = [
        ("renamed, as text, jittered", recon.match(c, text, ["id"])),
        ("one credit changed", recon.match(c, changed, ["id"])),
        ("columns by values", recon.match(c, unnamed)),
        ("null as zero", recon.match(c, zero, ["id"], null_zero=True)),
        ("null is not zero", recon.match(c, zero, ["id"])),
    ]
    verdicts = F.explode(F.array(*[F.struct(F.lit(n).alias("case_name"), F.lit(m.ok).alias("ok")) for n, m in found])).alias("v")
    return c.agg(count_rows().alias("n")).select("n", verdicts).select("v.case_name", "n", "v.ok")
