"""Scoreboards and checks over the bound trial log and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.catalog.registry import question
from grainline.operators import logs
from grainline.operators.logs import ALL_ROWS, COVERED_ROWS, FLAGS, MIN_TRAPS, MIN_WIDE, PITFALLS, REFUSAL_ROWS, UNCOVERED_ROWS
from grainline.sources.bindings import Tables
from grainline.sources.trials import FLAG_STEPS, trials

N_REPEATS = 3


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TRIALS = f"""with base as (
  select l.doc_id, quality, toxic, source, lang, n_chars as n from labels l join documents using (doc_id)),
t as (select 'd' || (doc_id % 1000) as task_id, if(n % 4 = 0, 'jaffle', 'bench') as dataset,
  list_filter([{_list(ALL_ROWS)}[n % 25 + 1], if(n % 3 = 0, {_list(ALL_ROWS)}[n % 7 + 1], null),
    if(n % 5 = 0, {_list(PITFALLS)}[n % 16 + 1], null)], lambda x: x is not null) as covers,
  source as profile, lang as model, doc_id as trial, n % 11 <> 0 as judged, quality = 1 as correct, toxic = 0 as single_query,
  n as input_tokens, n % 97 as output_tokens, n * 2 as cache_read_tokens, n % 5 as cache_write_tokens, n % 13 = 0 as partial,
  if(n % 6 <> 0, (n % 100)::double / 4, null) as cost_usd, n::double / 8 as duration_s, if(n % 17 = 0, 'DEV-1', null) as xfail,
  if(n % 12 = 0, 'refusal', if(n % 18 = 0, 'warning', 'match')) as expect, {", ".join(f"n % {k} = 0 as {f}" for f, k in FLAG_STEPS.items())}
  from base)"""
_COUNTS = """count(*) as trials, count(*) filter (where judged and correct) as correct,
  count(*) filter (where judged and single_query) as single_query, count(*) filter (where judged and correct and single_query) as passed"""
_SUITE = f"""case when dataset = 'jaffle' then 'jaffle' when list_has_any(covers, {_list(PITFALLS)}) then 'trap'
  when len(list_filter(covers, lambda x: list_contains({_list(COVERED_ROWS)}, x))) >= 2 then 'combo' else 'capability' end"""


@question("l1_suite_scoreboard", f"{_TRIALS} select {_SUITE} as suite, profile, model, {_COUNTS} from t where xfail is null group by all", ("L1",))
def l1_suite_scoreboard(spark, sf_dir):
    return logs.suite_scoreboard(trials(spark, sf_dir))


@question(
    "l2_row_scoreboard",
    f"""{_TRIALS}, e as (select distinct trial, unnest(covers) as "row" from t where dataset = 'bench' and xfail is null),
g as (select "row", count(distinct task_id) as tasks, {_COUNTS} from e join t using (trial) group by all),
r as (select unnest({_list(ALL_ROWS)}) as "row")
select "row", list_contains({_list(UNCOVERED_ROWS)}, "row") as uncovered,
  {", ".join(f'if(list_contains({_list(UNCOVERED_ROWS)}, "row"), null, coalesce({c}, 0)) as {c}' for c in ("tasks", "trials", "correct", "single_query", "passed"))}
from r left join g using ("row")""",
    ("L2",),
)
def l2_row_scoreboard(spark, sf_dir):
    return logs.row_scoreboard(spark, trials(spark, sf_dir))


_BLANK = ("correct", "single_query", "passed", *FLAGS)


@question(
    "l2_run_scoreboard",
    f"""{_TRIALS}, b as (select * from t where dataset = 'bench' and xfail is null),
runs as (select distinct profile, model from b),
seen as (select distinct trial, unnest(covers) as "row" from b),
g as (select profile, model, "row", count(distinct task_id) as tasks, {_COUNTS}, {", ".join(f"count(*) filter (where judged and {f}) as {f}" for f in FLAGS)}
  from seen join b using (trial) group by all),
grid as (select profile, model, unnest({_list(ALL_ROWS)}) as "row" from runs)
select grid.profile, grid.model, grid."row", list_contains({_list(UNCOVERED_ROWS)}, grid."row") as uncovered,
  {", ".join(f"case when not list_contains({_list(UNCOVERED_ROWS)}, grid.\"row\") then coalesce({c}, 0) end as {c}" for c in ("tasks", "trials"))},
  {", ".join(f"case when not list_contains({_list(UNCOVERED_ROWS)}, grid.\"row\") then {c} end as {c}" for c in _BLANK)}
from grid left join g on g."row" = grid."row" and g.profile is not distinct from grid.profile and g.model is not distinct from grid.model""",
    ("L2",),
)
def l2_run_scoreboard(spark, sf_dir):
    """Every capability row of every profile and model, with the five flags."""
    return logs.run_scoreboard(trials(spark, sf_dir))


@question(
    "l7_expected_failures",
    f"""{_TRIALS} select task_id, xfail, profile, model, count(*) as trials, count(*) filter (where judged and correct and single_query) as passed
from t where xfail is not null group by all""",
    ("L7",),
)
def l7_expected_failures(spark, sf_dir):
    return logs.xfail_table(trials(spark, sf_dir))


@question(
    "l3_pitfall_scoreboard",
    f"""{_TRIALS} select covers[-1] as pitfall, profile, model, count(*) as trials, count(*) filter (where judged and correct) as correct
from t where dataset = 'bench' and xfail is null and list_has_any(covers, {_list(PITFALLS)}) group by all""",
    ("L3",),
)
def l3_pitfall_scoreboard(spark, sf_dir):
    return logs.pitfall_scoreboard(trials(spark, sf_dir))


@question(
    "l4_pass_rates",
    f"""{_TRIALS} select task_id, profile, model, count(*) filter (where judged and correct and single_query) as k, count(*) as trials,
  pow(count(*) filter (where judged and correct and single_query)::double / count(*), {N_REPEATS}) as pass_hat_n
from t where xfail is null group by all""",
    ("L4",),
)
def l4_pass_rates(spark, sf_dir):
    return logs.pass_rates(trials(spark, sf_dir), N_REPEATS)


@question(
    "l4_until_pass",
    f"""{_TRIALS} select task_id, profile, model, arg_min(judged and correct and single_query, trial) as first_try,
  bool_or(judged and correct and single_query) as eventual, count(*) as attempts from t where xfail is null group by all""",
    ("L4",),
)
def l4_until_pass(spark, sf_dir):
    return logs.until_pass(trials(spark, sf_dir))


@question(
    "l5_totals",
    f"""{_TRIALS} select count(*) as trials, {", ".join(f"sum({c})::bigint as {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))},
  sum(coalesce(cost_usd, 0)) as cost_usd, sum(duration_s) as duration_s, count(*) filter (where partial) as partial_usage_trials from t""",
    ("L5",),
)
def l5_totals(spark, sf_dir):
    return logs.totals(trials(spark, sf_dir))


@question(
    "l13_usage_per_conversation",
    """with m as (select conv_id, turn, length(text) as chars, if(turn % 5 = 4, null, turn - if(turn % 3 = 2, 1, 0)) as message from conversations),
named as (select conv_id, message, arg_min(chars, turn) as chars from m where message is not null group by all),
every as (select conv_id, chars from named union all select conv_id, chars from m where message is null)
select conv_id, sum(chars)::bigint as chars, count(*) as turns from every group by all""",
    ("L13",),
)
def l13_usage_per_conversation(spark, sf_dir):
    """A conversation's usage by message: every third turn repeats the message before it, every fifth has no id and counts alone."""
    turn = F.col("turn")
    first = turn - F.when(turn % 3 == 2, 1).otherwise(0)
    message = F.when(turn % 5 != 4, F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), first.cast("string"))))
    c = Tables(spark, sf_dir)("conversations").withColumn("message", message).withColumn("chars", F.length("text").cast("long"))
    return logs.dedup_usage(c, "conv_id", "message", "turn", ["chars"])


@question(
    "l14_answered_turns",
    """with a as (select conv_id, turn - 1 as turn, text as result_text from conversations where role = 'assistant')
select u.conv_id, u.turn, a.result_text, a.result_text is not null as answered from conversations u left join a using (conv_id, turn) where u.role = 'user'""",
    ("L14",),
)
def l14_answered_turns(spark, sf_dir):
    """Each user turn with the assistant turn that follows it at once."""
    c = Tables(spark, sf_dir)("conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result_text"))
    return logs.pair_calls(asked, answers, "conv_id", "turn", "turn").select("conv_id", "turn", "result_text", "answered")


@question(
    "l15_coverage_problems",
    f"""{_TRIALS}, b as (select covers, expect, list_has_any(covers, {_list(PITFALLS)}) as is_trap from t where dataset = 'bench'),
held as (select distinct unnest(covers) as "row", expect <> 'match' as refuses from b)
select 'row ' || r || ' has no task' as problem from (select unnest({_list(COVERED_ROWS)}) as r) where r not in (select "row" from held)
union all select 'row ' || r || ' is not covered but has tasks' from (select unnest({_list(UNCOVERED_ROWS)}) as r) where r in (select "row" from held)
union all select 'row ' || r || ' needs a refusal or warning task' from (select unnest({_list(REFUSAL_ROWS)}) as r)
  where r not in (select "row" from held where refuses)
union all select count(*) || ' trap tasks, need at least {MIN_TRAPS}' from b where is_trap having count(*) < {MIN_TRAPS}
union all select count(*) || ' tasks cover three or more rows, need at least {MIN_WIDE}' from b
  where len(list_filter(covers, lambda x: list_contains({_list(COVERED_ROWS)}, x))) >= 3 having count(*) < {MIN_WIDE}""",
    ("L15",),
)
def l15_coverage_problems(spark, sf_dir):
    return logs.coverage_problems(trials(spark, sf_dir), expect="expect")


@question(
    "l17_selected_trials",
    f"""{_TRIALS} select task_id, trial from t where list_has_any(covers, ['Q3', 'Q5']) and {_SUITE} in ('combo', 'trap')""",
    ("L17",),
)
def l17_selected_trials(spark, sf_dir):
    return logs.select_tasks(trials(spark, sf_dir), rows=["Q3", "Q5"], suites=["combo", "trap"]).select("task_id", "trial")


@question("l18_shop_scoreboard", f"{_TRIALS} select task_id, profile, model, {_COUNTS} from t where dataset = 'jaffle' group by all", ("L18",))
def l18_shop_scoreboard(spark, sf_dir):
    return logs.jaffle_scoreboard(trials(spark, sf_dir))


#: Prefixes that make result texts of turns; the last one leaves the text as it is.
_PREFIXES = (
    "Error executing tool query: engine.errors.TimeDimensionColumnError: ",
    "ValueError: ",
    "showing first 20 rows",
    "credit broadcast across orders: ",
    "credit associated over orders: ",
    "a degenerate re-aggregation of ",
    "pushed by semi-join: ",
    "statement timeout after 5 s: ",
    "[orders] rewrote ",
    "whole periods only: ",
    "",
)


@question(
    "l11_l12_error_and_warning_kinds",
    f"""with c as (select conv_id, turn, {_list(_PREFIXES)}[(conv_id * 3 + turn) % {len(_PREFIXES)} + 1] || text as t from conversations),
k as (select conv_id, turn, t, regexp_extract(t, 'Error executing tool [A-Za-z0-9_.-]+: ([A-Za-z_][A-Za-z0-9_.]*):', 1) as a,
  regexp_extract(t, '^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)): ', 1) as b from c)
select conv_id, turn, nullif(string_split(if(a <> '', a, b), '.')[-1], '') as error_kind,
  case when regexp_matches(t, '^showing first [0-9]+ rows') then 'truncated' when contains(t, 'broadcast across') then 'broadcast'
    when contains(t, 'associated over') then 'associated' when contains(t, 'degenerate re-aggregation') then 'degenerate_reaggregation'
    when contains(t, 'by semi-join') then 'semi_join_pushed' when contains(t, 'statement timeout') then 'statement_timeout_skipped'
    when regexp_matches(t, '^\\[[^\\]]+\\] (rewrote|flagged) ') then 'normalization' when regexp_matches(t, 'whole[_ ]periods') then 'whole_periods_non_nesting'
    else 'other' end as warning_kind from k""",
    ("L11", "L12"),
)
def l11_l12_error_and_warning_kinds(spark, sf_dir):
    """The error class and the warning kind of every turn, whose text follows one of the prefixes that errors and warnings have."""
    at = (F.col("conv_id") * 3 + F.col("turn")) % len(_PREFIXES)
    said = F.concat(F.get(F.array(*[F.lit(p) for p in _PREFIXES]), at.cast("int")), F.col("text"))
    c = Tables(spark, sf_dir)("conversations").select("conv_id", "turn", said.alias("t"))
    return c.select("conv_id", "turn", logs.error_kind(F.col("t")).alias("error_kind"), logs.warning_kind(F.col("t")).alias("warning_kind"))
