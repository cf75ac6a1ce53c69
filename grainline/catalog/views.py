"""SQL twins of ``grainline.sources.bindings`` for the independent DuckDB oracle.

The oracle sees only the driver's raw tables, so each oracle query carries the binding views it needs as
CTEs. ``with_views`` finds the ``b_*`` / ``s_*`` names a query uses and prepends them (with their
dependencies) in order. ``tests/test_bindings.py`` checks every view against its DataFrame twin.
"""

from __future__ import annotations

import re

MONEY = "decimal(18,2)"

# name -> SQL body; the order of this dict is a valid dependency order.
VIEWS: dict[str, str] = {
    "b_regions": "select r_regionkey as id, r_name as name from region",
    "b_customers": f"""select c_custkey as id, c_name as name,
  cast(case when c_custkey % 20 = 7 then null when c_custkey % 7 = 0 then (n_regionkey + 1) % 4
       else n_regionkey % 4 end as integer) as region_id,
  n_name as city, c_mktsegment as tier, cast(c_acctbal as {MONEY}) as credit,
  cast(c_custkey % 6 as {MONEY}) as discount
  from customer join nation on c_nationkey = n_nationkey""",
    "b_orders": f"""select o_orderkey as id,
  case when o_orderkey % 50 = 3 or o_custkey % 25 = 11 then null else o_custkey end as customer_id,
  cast(o_totalprice as {MONEY}) as amount, o_orderstatus as status,
  case when o_orderdate >= timestamp '1997-08-01' and o_orderdate < timestamp '1997-09-01'
       then cast(cast(o_orderdate as date) + interval 1 month as date) else cast(o_orderdate as date) end as order_date
  from orders""",
    "b_order_items": f"""select l_orderkey as order_id, l_partkey as product_id, l_quantity as quantity,
  cast(l_extendedprice as {MONEY}) as line_amount from lineitem""",
    "b_returns": f"""select o.id, case when o.customer_id % 5 <> 2 then o.customer_id end as customer_id,
  cast(sum(cast(l_extendedprice as {MONEY})) as {MONEY}) as amount, cast(max(l_shipdate) as date) as return_date
  from lineitem join b_orders o on o.id = l_orderkey where l_returnflag = 'R' group by 1, 2""",
    "b_products": f"""select p_partkey as id, p_name as name, p_type as category, cast(p_retailprice as {MONEY}) as list_price
  from part""",
    "b_campaigns": """select s_suppkey as id, s_name as name,
  case when s_suppkey % 10 = 0 then 'email' when s_suppkey % 2 = 1 then 'social' else 'search' end as channel
  from supplier""",
    "b_members": """select distinct l_suppkey as campaign_id, o_custkey as customer_id
  from lineitem join orders on o_orderkey = l_orderkey""",
    "b_cities": """select distinct case when length(city) = 5 then city || ' (OLD)' else city end as city, region_id,
  case (length(city) + coalesce(region_id, 0)) % 3 when 0 then 'large' when 1 then 'medium' else 'small' end as size_class
  from b_customers""",
    "b_events": f"select event_id as id, cast(value as {MONEY}) as amount, ts as event_ts from events",
    "b_orders_flat": """select o.id, o.customer_id, o.amount, o.status, o.order_date, r.name as region, c.city, c.tier,
  c.credit, c.discount
  from b_orders o left join b_customers c on c.id = o.customer_id left join b_regions r on r.id = c.region_id""",
    "b_months": """select cast(date_trunc('month', order_date) as date) as month, sum(amount) as revenue, count(*) as orders
  from b_orders group by all""",
    # shop database
    "s_stores": """select n_nationkey as id, n_name as name,
  cast(date '1995-01-01' + to_months(n_nationkey * 4) as timestamp) as opened_at,
  cast(cast(cast(0.04 as decimal(6,4)) + (n_nationkey % 5) * cast(0.005 as decimal(6,4)) as decimal(6,4)) as double)
    as tax_rate
  from nation""",
    "s_customers": "select c_custkey as id, c_name as name from customer",
    "s_orders": f"""select id, customer, ordered_at, store_id, subtotal, tax_paid, subtotal + tax_paid as order_total from (
  select o_orderkey as id, o_custkey as customer,
    o_orderdate + to_hours(cast(o_orderkey % 12 + 8 as bigint)) as ordered_at,
    c_nationkey as store_id,
    cast(cast(cast(o_totalprice as {MONEY}) as decimal(18,0)) as bigint) as subtotal,
    cast(round(cast(cast(cast(o_totalprice as {MONEY}) as decimal(18,0)) as bigint)
      * cast(cast(0.04 as decimal(6,4)) + (c_nationkey % 5) * cast(0.005 as decimal(6,4)) as decimal(6,4))) as bigint)
      as tax_paid
  from orders join customer on o_custkey = c_custkey)""",
    "s_products": f"""select p_partkey as sku, p_name as name,
  case when p_type in ('SMALL', 'MEDIUM', 'LARGE') then 'beverage' else 'jaffle' end as type,
  cast(cast(cast(p_retailprice as {MONEY}) as decimal(18,0)) as bigint) as price
  from part""",
    "s_items": "select l_orderkey as order_id, l_partkey as sku from lineitem",
    "s_supplies": """select concat_ws('-', cast(l_suppkey as varchar), cast(l_partkey as varchar)) as id, s_name as name,
  cast(l_partkey % 11 + l_suppkey % 7 + 1 as bigint) as cost, l_suppkey % 2 = 0 as perishable, l_partkey as sku
  from (select distinct l_partkey, l_suppkey from lineitem) join supplier on l_suppkey = s_suppkey""",
    "s_tweets": """select event_id as id, user_id, ts + to_months(-312) as tweeted_at, props as content
  from events where event_type = 'click'""",
}

_NAME = re.compile(r"\b([bs]_[a-z_]+)\b")


def _needed(sql: str) -> set[str]:
    out: set[str] = set()
    todo = [n for n in _NAME.findall(sql) if n in VIEWS]
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo.extend(m for m in _NAME.findall(VIEWS[n]) if m in VIEWS)
    return out


def with_views(sql: str) -> str:
    """``sql`` prefixed by the binding views it uses, as CTEs in dependency order.

    A query that starts with ``with`` gets its own CTEs appended after the bindings.
    """
    need = _needed(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} as (\n{VIEWS[n]}\n)" for n in VIEWS if n in need)
    body = sql.strip()
    if body[:4].lower() == "with":
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"
