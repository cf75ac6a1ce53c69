"""Questions about answers, call traces and mergeable states: verdicts over many answers (K2, K4, L9, L10), parsed result texts
(A8), nested call arguments (L6, L8), sketches (D6, D9), profiles (N6), SQL functions and SQL models (D16, H4, H5), M2, K8.

Answers, result texts and calls are derived row by row from the given tables: a supplier's monthly lines are a truth and its
trials are that truth changed by rules on keys; a conversation is a trace and each of its turns a call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.catalog.bench import BAD, models
from grainline.catalog.registry import question
from grainline.functions import sql as sql_functions
from grainline.functions.scalar import band, ratio
from grainline.operators import calls, checks, group_match, periods, recon, result_text, sketches
from grainline.plans.spec import QuerySpec, sql_model
from grainline.sources import files
from grainline.sources.bindings import MONEY, Bench, Tables

SIZE_EDGES, SIZE_LABELS = (50_000, 150_000, 300_000), ("small", "medium", "large", "huge")
CELLS = ["month", "revenue", "quantity"]

# ------------------------------------------------------------------ verdicts

_TRUTH = """with truth as (
  select l_suppkey as task, strftime(l_shipdate, '%Y/%m') as month, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue, sum(l_quantity) as quantity
  from lineitem group by all),
ends as (select task, min(month) as first_month, max(month) as last_month from truth group by task),
given as (
  select task, 1 as trial, month, revenue * (1 + 3e-8) as revenue, quantity from truth
  union all
  select task, 2, month, if(task % 3 = 0 and month = first_month, revenue * 1.01, revenue), quantity from truth join ends using (task)
  union all
  select task, 3, month, revenue, if(task % 4 = 1, quantity + 0.5, quantity) from truth join ends using (task) where not (task % 4 = 0 and month = last_month)),
trials as (select task, trial from ends, (values (1), (2), (3)) v(trial)),
sizes as (select trials.task, trials.trial, count(given.month) as n from trials left join given on given.task = trials.task and given.trial = trials.trial group by all),
partners as (
  select a.task, a.trial, count(*) filter (where g.month is null) as unmatched
  from (select * from trials join truth using (task)) a left join given g on g.task = a.task and g.trial = a.trial and g.month = a.month
    and abs(g.revenue - a.revenue) <= 1e-6 * greatest(1, abs(g.revenue), abs(a.revenue)) and abs(g.quantity - a.quantity) <= 1e-6 * greatest(1, abs(g.quantity), abs(a.quantity))
  group by all),
verdicts as (
  select s.task, s.trial, s.n = w.n and unmatched = 0 as ok, if(s.n = w.n, unmatched, null) as unmatched
  from sizes s join partners using (task, trial) join (select task, count(*) as n from truth group by 1) w using (task))"""


def _answers(spark, sf_dir):
    """(truth, results of three trials, all trials)."""
    lines = Tables(spark, sf_dir)("lineitem")
    truth = lines.groupBy(F.col("l_suppkey").alias("task"), F.date_format("l_shipdate", "yyyy/MM").alias("month")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("revenue"), F.sum("l_quantity").alias("quantity")
    )
    truth = truth.checkpoint()  # the lines are read and summed once; truth, answers and trials are made of the sums
    ends = truth.groupBy("task").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    trials = ends.withColumn("trial", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    at, task = F.col("trial"), F.col("task")
    rows = truth.join(trials, "task").where(~((at == 3) & (task % 4 == 0) & (F.col("month") == F.col("last_month"))))
    revenue = F.when(at == 1, F.col("revenue") * (1 + 3e-8)).when((at == 2) & (task % 3 == 0) & (F.col("month") == F.col("first_month")), F.col("revenue") * 1.01).otherwise(F.col("revenue"))
    quantity = F.when((at == 3) & (task % 4 == 1), F.col("quantity") + 0.5).otherwise(F.col("quantity"))
    return truth, rows.select("task", "trial", "month", revenue.alias("revenue"), quantity.alias("quantity")), trials.select("task", "trial")


@question("l9_answer_verdicts", f"{_TRUTH} select task, trial, ok, unmatched from verdicts", ("L9", "K2", "K6"))
def l9_answer_verdicts(spark, sf_dir):
    """Every answer against its task's truth, within the tolerance, whatever the order of its rows."""
    truth, results, trials = _answers(spark, sf_dir)
    results = results.withColumn("trial", F.concat_ws("/", "task", "trial"))
    listed = trials.withColumn("trial", F.concat_ws("/", "task", "trial"))
    out = group_match.match_groups(truth, results, "task", "trial", CELLS, answers=listed)
    return out.select("task", F.split("trial", "/")[1].cast("int").alias("trial"), "ok", "unmatched")


@question(
    "l10_first_single_call",
    f"""{_TRUTH} select e.task, min(v.trial) filter (where v.ok and (v.task + v.trial) % 5 <> 0) as first_single_call
from ends e join verdicts v using (task) group by all""",
    ("L10",),
)
def l10_first_single_call(spark, sf_dir):
    """The first successful call of each trace (a supplier's trials) whose own rows are the answer."""
    truth, results, trials = _answers(spark, sf_dir)
    made = trials.select("task", F.col("task").alias("trace"), F.col("trial").alias("call"), ((F.col("task") + F.col("trial")) % 5 == 0).alias("is_error"))
    rows = results.withColumnRenamed("trial", "call").withColumn("trace", F.col("task"))
    return group_match.single_query(made, rows, truth, "trace", "task", "call", CELLS).select(F.col("trace").alias("task"), "first_single_call")


@question(
    "k4_ordered_answers",
    """with c as (select c_nationkey as task, c_custkey as id, cast(floor(c_acctbal / 1000) as integer) as band from customer),
sorted as (select *, row_number() over (partition by task order by band desc, id) - 1 as place from c),
given as (
  select task, 1 as trial, id, band, row_number() over (partition by task order by band desc, id % 7, id) - 1 as place from c
  union all
  select task, 2, id, band, row_number() over (partition by task order by if(task % 2 = 0, band, -band), id desc) - 1 from c)
select task, trial, bool_and(g.band = s.band) as ok, min(place + 1) filter (where g.band <> s.band) as first_off
from given g join sorted s using (task, place) group by all""",
    ("K4",),
)
def k4_ordered_answers(spark, sf_dir):
    """Customers of a nation by balance band: ties in any order are right, a wrong direction is not."""
    c = Tables(spark, sf_dir)("customer")
    truth = c.select(F.col("c_nationkey").alias("task"), F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("band"))
    shuffled = group_match.places(truth, "task", [F.col("band").desc(), F.col("id") % 7, F.col("id")])
    turned = group_match.places(truth, "task", [F.when(F.col("task") % 2 == 0, F.col("band")).otherwise(-F.col("band")), F.col("id").desc()])
    results = shuffled.withColumn("trial", F.lit("1")).unionByName(turned.withColumn("trial", F.lit("2"))).withColumn("trial", F.concat_ws("/", "task", "trial"))
    out = group_match.match_ordered_groups(truth, results, "task", "trial", ["id", "band"], [("band", True)], "place")
    return out.select("task", F.split("trial", "/")[1].cast("int").alias("trial"), "ok", "first_off")


# ------------------------------------------------------------------ result texts and calls


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _result_text() -> F.Column:
    """A turn as a result in one of eight forms, two of which are none."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    odd = turn % 2 == 1
    head = "| conv | turn | role |\n| --- | ---: | --- |\n| "
    table = _text(head, conv, " | ", turn, " | ", role, " |\n|  | ", turn + 1, " |  |")
    records = _text('[{"conv": ', conv, ', "turn": ', turn, ', "role": "', role, '"}, {"turn": ', turn + 1, ', "note": null}]')
    rows = _text("[[", conv, ", ", turn, ', "', role, '"], [null, ', turn + 1, ", null]]")
    keyed = _text('[{"role": "', role, '", "conv": ', conv, ', "turn": ', turn, '}, {"turn": ', turn + 1, ', "conv": null, "role": null}]')
    shape = F.pmod(conv * 31 + turn, F.lit(8))
    return (
        F.when(shape == 0, F.concat(table, F.when(odd, "\n\n_(truncated to 2 rows, more were found)_").otherwise("")))
        .when(shape == 1, records)
        .when(shape == 2, F.concat(F.lit('{"data": '), records, F.lit(', "warnings": [{"kind": "broadcast", "hint": "across turns"}]}')))
        .when(shape == 3, F.concat(F.lit('{"columns": ["conv", "turn", "role"], "rows": '), rows, F.when(odd, ', "truncated": true}').otherwise("}")))
        .when(shape == 4, F.concat(F.lit('{"columns": [{"name": "conv"}, {"name": "turn"}, {"name": "role"}], "rows": '), keyed, F.lit("}")))
        .when(shape == 5, F.concat(F.lit("SQL:\nselect 1\n\nfrom turns\n\n"), table))
        .when(shape == 6, F.col("text"))
        .otherwise('{"columns": ["a"], "rows": [1]}')
    )


@question(
    "a8_parsed_turns",
    """with c as (select conv_id, turn, (conv_id * 31 + turn) % 8 as shape from conversations)
select conv_id, turn, shape < 6 as is_result,
  case when shape in (1, 2) then 'conv,turn,role,note' when shape < 6 then 'conv,turn,role' end as columns,
  if(shape < 6, 2, null) as n_rows, if(shape < 6, 2 * turn + 1, null) as turn_sum,
  case when shape in (1, 2) then 4 when shape < 6 then 2 end as null_cells,
  case when shape >= 6 then null when shape in (0, 3) and turn % 2 = 1 then 'truncated' when shape = 2 then 'broadcast' else '' end as warnings from c""",
    ("A8", "J"),
)
def a8_parsed_turns(spark, sf_dir):
    """Every turn as a result text, parsed back to typed cells."""
    c = Tables(spark, sf_dir)("conversations")
    p = result_text.parse_texts(c.select("conv_id", "turn", _result_text().alias("result")), "result")
    rows, at = F.col("parsed.rows"), F.array_position("parsed.columns", F.lit("turn")).cast("int") - 1
    turns = F.aggregate(F.transform(rows, lambda r: F.try_variant_get(F.get(r, at), "$", "bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select(
        "conv_id",
        "turn",
        F.col("parsed").isNotNull().alias("is_result"),
        F.array_join("parsed.columns", ",").alias("columns"),
        F.when(F.col("parsed").isNotNull(), F.size(rows)).alias("n_rows"),
        turns.alias("turn_sum"),
        F.when(F.col("parsed").isNotNull(), F.size(F.filter(F.flatten(rows), lambda v: v.isNull()))).alias("null_cells"),
        F.array_join(F.transform("parsed.warnings", lambda w: w["kind"]), ",").alias("warnings"),
    )


_TOOLS = ("query", "sql", "python", "create_model", "edit_model", "submit_answer")
#: Arguments as JSON by tool: the second and third hold SQL, the third inside JSON text.
_QUERY_ARGS = (
    '{"query":{"source_model":"orders"}}',
    '{"query":{"source_model":{"columns":[{"sql":"x"}]}}}',
    r'{"query":"[{\"source_model\":{\"sql\":\"s\"}}]"}',
    '{"query":"monthly"}',
)
_MODEL_ARGS = ('{"name":"m"}', '{"sql":"select 1"}', r'{"columns":"[{\"filter\":\"a > 0\"}]"}', '{"query":{"source_model":"o"}}')
_QUERY_ASKED = ("orders", '{"columns":[{"sql":"x"}]}', '{"sql":"s"}', "saved query monthly")


def _pick(values, at: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CALLS = f"""with calls as (select conv_id as trace, turn as call, {_sql_list(_TOOLS)}[(conv_id * 7 + turn) % 6 + 1] as tool, (conv_id + turn) % 4 as arg,
  (conv_id + 2 * turn) % 5 = 0 as is_error, turn % 3 as n from conversations)"""


def _calls(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    tool, arg = _pick(_TOOLS, (conv * 7 + turn) % 6), (conv + turn) % 4
    text = F.when(tool == "query", _pick(_QUERY_ARGS, arg)).when(tool == "sql", F.lit('{"sql":"select\\n  1"}')).when(tool.isin("create_model", "edit_model"), _pick(_MODEL_ARGS, arg)).otherwise("{}")
    error = (conv + 2 * turn) % 5 == 0
    result = F.when(error, "Error executing tool t: pkg.BadError: no").when(turn % 3 == 0, "done").when(turn % 3 == 1, '[{"a": 1}]').otherwise('{"columns": ["a"], "rows": [[1], [2]], "truncated": true}')
    c = Tables(spark, sf_dir)("conversations")
    return c.select(conv.alias("trace"), turn.alias("call"), tool.alias("tool"), F.try_parse_json(text).alias("args"), error.alias("is_error"), result.alias("result_text"))


@question(
    "l6_call_flags",
    f"""{_CALLS} select trace, count(*) as calls, bool_or(tool = 'python') as used_python,
  bool_or(tool = 'sql' or (tool in ('query', 'create_model', 'edit_model') and arg in (1, 2))) as raw_sql, bool_or(tool in ('create_model', 'edit_model')) as edited_models,
  bool_or(is_error and tool not in ('python', 'submit_answer')) as query_errors, count(*) filter (where tool in ('query', 'sql')) > 1 as several_queries
from calls group by trace""",
    ("L6", "J"),
)
def l6_call_flags(spark, sf_dir):
    """Flags of every trace by tool and argument, SQL found inside nested models and JSON text."""
    return calls.trace_flags(_calls(spark, sf_dir), "trace")


@question(
    "l8_call_outcomes",
    f"""{_CALLS} select trace, call, '#' || call || ' `' || tool || '` ' || case tool when 'query' then {_sql_list(_QUERY_ASKED)}[arg + 1] when 'sql' then 'select 1' else {_sql_list(_MODEL_ARGS)}[arg + 1] end
  || ' → ' || case when is_error then 'error BadError' when n = 0 then 'ok' when n = 1 then '1 rows' else '2 rows, truncated warning' end as line
from calls where tool not in ('python', 'submit_answer')""",
    ("L8", "L11", "L12"),
)
def l8_call_outcomes(spark, sf_dir):
    """One line per data call: what was asked, with its arguments, and what came back."""
    return calls.call_digest(result_text.parse_texts(_calls(spark, sf_dir), "result_text"), "trace", "call")


# ------------------------------------------------------------------ mergeable states


@question(
    "d6_distinct_states",
    """with o as (select customer_id, order_date from b_orders where customer_id is not null),
m as (select distinct date_trunc('month', order_date) as period from o)
select 'month' as grain, cast(date_trunc('month', order_date) as date) as period, count(distinct customer_id) as customers, true as within_5_percent from o group by all
union all
select 'rolling', cast(m.period as date), count(distinct customer_id), true from m join o
  on o.order_date < m.period + interval 1 month and o.order_date >= m.period + interval 1 month - interval 90 day group by all""",
    ("D6", "D18", "D23", "E6"),
)
def d6_distinct_states(spark, sf_dir):
    """Customers per month and in the 90 days to a month's end: exact, and from daily states by status that were merged."""
    o = Bench(spark, sf_dir).orders.where(F.col("customer_id").isNotNull())
    states = sketches.distinct_states(o, "order_date", ["status"], "customer_id")
    exact = periods.series(o, "order_date", "month", [], {"customers": F.count_distinct("customer_id")}, name="period")
    by_month = exact.join(sketches.distinct_at(states, "month", []), "period").withColumn("grain", F.lit("month"))
    rolled = periods.rolling(o, "order_date", "month", "90d", {"customers": F.count_distinct}, {"customers": "customer_id"}, name="period", distinct_key="customer_id")
    rolled = rolled.join(exact.select("period"), "period", "left_semi")
    by_window = rolled.join(sketches.rolling_distinct(states, "month", "90d"), "period").withColumn("grain", F.lit("rolling"))
    near = F.abs(F.col("n") - F.col("customers")) <= 0.05 * F.col("customers")
    return by_month.unionByName(by_window).select("grain", "period", "customers", near.alias("within_5_percent"))


@question(
    "d9_quantile_states",
    """select cast(date_trunc('year', order_date) as date) as period, status, r as "rank", true as within_bound
from b_orders, (values (0.1::double), (0.5), (0.9), (0.99)) t(r) group by all""",
    ("D9",),
)
def d9_quantile_states(spark, sf_dir):
    """Quantiles of order amounts per year and status from merged daily summaries; their ranks, checked in the facts, are near."""
    o = Bench(spark, sf_dir).orders
    states = sketches.quantile_states(o, "order_date", ["status"], "amount")
    found = sketches.quantiles_at(states, "year", ["status"], [0.1, 0.5, 0.9, 0.99])
    checked = sketches.rank_errors(o, "order_date", "year", ["status"], "amount", found)
    return checked.select("period", "status", "rank", (F.col("rank_error") <= 2 * sketches.KLL_RANK_ERROR).alias("within_bound"))


# ------------------------------------------------------------------ profiles, functions, models


@question(
    "n6_averages_by_status",
    """select 'status' as "column", status as "value", grouping(status) = 1 as is_total, count(*) as rows, cast(avg(amount) as double) as avg_amount, avg(id) as avg_id
from b_orders group by grouping sets ((status), ())""",
    ("N6",),
)
def n6_averages_by_status(spark, sf_dir):
    """Averages by the text column with the fewest values, which a pass of sketches finds."""
    return checks.averages_by_low_cardinality(Bench(spark, sf_dir).orders, ["amount", "id"])


@question(
    "udf_sql_functions",
    """with t as (select customer_id, status, cast(sum(amount) as double) as s, count(amount) as n from b_orders where customer_id is not null group by all)
select customer_id, status, s / n as average, cast(round(s * 100) as bigint) as cents from t where n > 1""",
    ("UDF surface", "D16"),
)
def udf_sql_functions(spark, sf_dir):
    """A SQL text that calls the library's formulas, a custom aggregation and a table function by name."""
    sql_functions.register(spark)
    sql_functions.register_template(spark, "gl_average", "gl_ratio(v_sum, CAST(v_count AS DOUBLE))")
    Bench(spark, sf_dir).orders.createOrReplaceTempView("gl_orders")
    sql_functions.register_table(
        spark,
        "gl_spend",
        "least_orders BIGINT",
        "customer_id BIGINT, status STRING, s DECIMAL(28,2), n BIGINT",
        "SELECT customer_id, status, sum(amount), count(amount) FROM gl_orders WHERE customer_id IS NOT NULL GROUP BY customer_id, status HAVING count(amount) >= least_orders",
    )
    return spark.sql("SELECT customer_id, status, gl_average(CAST(s AS DOUBLE), n) AS average, gl_cents(CAST(s AS DECIMAL(18,2))) AS cents FROM gl_spend(2)")


@question(
    "h5_orders_since",
    """select c.tier, count(*) as n_orders, cast(sum(o.amount) as double) as revenue from b_orders o join b_customers c on o.customer_id = c.id
where o.order_date >= date '1998-03-01' group by all""",
    ("H4", "H5"),
)
def h5_orders_since(spark, sf_dir):
    """A model of SQL text with a date parameter, joined to a model built in Python."""
    b = Bench(spark, sf_dir)
    text = "SELECT customer_id, count(*) AS n, sum(amount) AS s FROM {orders} WHERE order_date >= :since AND customer_id IS NOT NULL GROUP BY customer_id"
    recent = sql_model(spark, "recent", text, ("customer_id",), {"since": "1998-03-01"}, tables={"orders": b.orders})
    return recent.df.join(b.customers.select("id", "tier"), F.col("customer_id") == F.col("id")).groupBy("tier").agg(F.sum("n").alias("n_orders"), F.sum("s").cast("double").alias("revenue"))


@question(
    "h4_supplier_parts",
    """select l_suppkey as supplier, count(distinct l_partkey) as parts, count(*) as lines from lineitem where l_quantity >= 25 group by all""",
    ("H4",),
)
def h4_supplier_parts(spark, sf_dir):
    """A model of SQL text over a given table, with a number parameter that reaches the scan."""
    lines = Tables(spark, sf_dir)("lineitem")
    return sql_model(
        spark, "parts", "SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM {lines} WHERE l_quantity >= :least GROUP BY l_suppkey", ("supplier",), {"least": 25}, tables={"lines": lines}
    ).df


@question(
    "m2_customers_with_bad_orders",
    f"""select tier, count(*) as customers, cast(sum(credit) as double) as credit from b_customers c
where exists (select 1 from b_orders o where o.customer_id = c.id and o.status = '{BAD}') and region_id in (select id from b_regions where name <> 'ASIA') group by tier""",
    ("M2", "C9"),
)
def m2_customers_with_bad_orders(spark, sf_dir):
    """A filter across a to-many join in a saved query becomes a semi-join; one across a to-one join stays a filter."""
    spec = QuerySpec(
        source="customers",
        measures={"customers": lambda: F.count(F.lit(1)), "credit": lambda: F.sum("credit").cast("double")},
        dims={"tier": "tier"},
        where=(("orders.status", lambda c: c == BAD), ("regions.name", lambda c: c != "ASIA")),
    )
    return spec.result(models(spark, sf_dir)).df


@question(
    "k8_orders_md5",
    r"""select count(*) as rows, cast(sum(cast(('0x' || substr(md5(id || chr(10) || coalesce(cast(customer_id as varchar), '\N') || chr(10) || cast(amount as varchar) || chr(10) || status || chr(10) || cast(order_date as varchar) || chr(10)), 1, 15)) as bigint)) as varchar) as hash
from b_orders""",
    ("K8",),
)
def k8_orders_md5(spark, sf_dir):
    """The fingerprint of the orders by a digest that DuckDB has too."""
    return recon.content_md5(Bench(spark, sf_dir).orders.select("id", "customer_id", "amount", "status", "order_date"))


# ------------------------------------------------------------------ models: default time, proven cardinalities


@question(
    "f6_returns_by_default_time",
    """with sp as (select cast(unnest(generate_series(date '1997-01-01', date '1998-12-01', interval 1 month)) as date) as month),
r as (select date_trunc('month', return_date)::date as month, count(*) as returns, count(customer_id) as known_customers, sum(amount) as amount,
  arg_min(id, struct_pack(d := return_date, i := id)) as first_return, arg_max(id, struct_pack(d := return_date, i := id)) as last_return
  from b_returns group by 1)
select sp.month, coalesce(returns, 0) as returns, coalesce(known_customers, 0) as known_customers, cast(coalesce(amount, 0) as double) as amount,
  first_return, last_return, cast(amount as double) / known_customers as amount_per_known from sp left join r using (month)""",
    ("F6", "D10", "F3", "D4", "B14"),
)
def f6_returns_by_default_time(spark, sf_dir):
    """Returns by month of their model's own time column, with the first and last of each; every month of two years appears."""
    returns = models(spark, sf_dir)["returns"]
    m = {
        "returns": F.count(F.lit(1)),
        "known_customers": F.count("customer_id"),
        "amount": F.sum("amount"),
        "first_return": returns.first("id"),
        "last_return": returns.last("id"),
        "amount_per_known": ratio(F.sum("amount"), F.count("customer_id")),
    }
    s = returns.series("month", m, ["1997", "1998"], name="month", filled=["returns", "known_customers", "amount"])
    return s.withColumn("amount", F.col("amount").cast("double"))


_EDGES = (("orders", "customers"), ("customers", "orders"), ("customers", "regions"), ("customers", "cities"), ("order_items", "orders"), ("orders", "order_items"), ("campaigns", "campaign_members"))
_EDGE_KEYS = {
    ("orders", "customers"): ("many_to_one", "b_customers", "id"),
    ("customers", "orders"): ("one_to_many", "b_orders", "customer_id"),
    ("customers", "regions"): ("many_to_one", "b_regions", "id"),
    ("customers", "cities"): ("many_to_one", "b_cities", "city, region_id"),
    ("order_items", "orders"): ("many_to_one", "b_orders", "id"),
    ("orders", "order_items"): ("one_to_many", "b_order_items", "order_id"),
    ("campaigns", "campaign_members"): ("one_to_many", "b_members", "campaign_id"),
}


def _edge_sql(edge) -> str:
    declared, table, keys = _EDGE_KEYS[edge]
    known = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    return f"""select '{edge[0]}' as source, '{edge[1]}' as target, '{declared}' as declared, count(*) as repeated_keys,
  if(count(*) = 0, 'many_to_one', 'fanning') as proven from (select {keys} from {table} where {known} group by {keys} having count(*) > 1)"""


@question("m1_proven_cardinalities", "\nunion all\n".join(_edge_sql(e) for e in _EDGES), ("M1", "N5"))
def m1_proven_cardinalities(spark, sf_dir):
    """The joins of the order database, forward and reverse: as declared, and as the keys of their targets prove them."""
    return models(spark, sf_dir).cardinalities(_EDGES)


@question(
    "n8_size_bands_by_priority",
    """with o as (select o_orderpriority as priority, cast(o_totalprice as decimal(18,2)) as amount, o_custkey from orders)
select priority, case when amount < 50000 then 'small' when amount < 150000 then 'medium' when amount < 300000 then 'large' else 'huge' end as size_band,
  count(*) as orders, count(distinct o_custkey) as customers, cast(sum(amount) as double) / count(distinct o_custkey) as amount_per_customer from o group by all""",
    ("N8", "A2", "B14", "D5"),
)
def n8_size_bands_by_priority(spark, sf_dir):
    """Orders by size band and priority from a scan of the four columns that it needs."""
    o = files.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey"])
    amount = F.col("o_totalprice").cast(MONEY)
    banded = o.select(F.col("o_orderpriority").alias("priority"), band(amount, SIZE_EDGES, SIZE_LABELS).alias("size_band"), amount.alias("amount"), "o_custkey")
    # customers once per band: the distinct count needs no second copy of the orders
    per = banded.groupBy("priority", "size_band", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))
    g = per.groupBy("priority", "size_band").agg(F.sum("n").alias("orders"), F.count("o_custkey").alias("customers"), F.sum("s").alias("s"))
    return g.select("priority", "size_band", "orders", "customers", ratio(F.col("s"), F.col("customers")).alias("amount_per_customer"))
