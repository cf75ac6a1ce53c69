"""Analytics over evaluation logs: trial results and call traces.

Trial results are rows with nested fields (``covers`` array, ``verdict`` struct, ``usage`` struct);
traces are exploded to one row per call. Every operator is a grouped aggregate, an explode, a join or a
higher-order function over bounded arrays; none collects a trace or a task's trials into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.plans.model import UnknownReferenceError

# The benchmark's capability rows, its declared pitfalls and suites.
ALL_ROWS = tuple(f"Q{i}" for i in range(1, 26))
UNCOVERED_ROWS = ("Q19", "Q22")
COVERED_ROWS = tuple(r for r in ALL_ROWS if r not in UNCOVERED_ROWS)
PITFALLS = (
    "fan_out", "count_after_join", "chasm", "bridge", "non_unique_key", "outer_join_filter", "not_in_null",
    "count_outer_join", "filtered_total", "distinct_reagg", "missing_periods", "filter_before_window",
    "rows_window_gap", "timestamp_bounds", "avg_of_avgs", "bucket_reaggregation",
)
SUITES = ("capability", "combo", "trap", "jaffle")
# Rows that need a task with another expectation than a matching answer, and the least numbers of tasks (fixed values).
REFUSAL_ROWS = ("Q9", "Q18")
MIN_TRAPS, MIN_WIDE = 12, 2
# Flags of a verdict, in the order of the scoreboard (fixed values).
FLAGS = ("used_python", "raw_sql", "edited_models", "query_errors", "several_queries")
DIGEST_CHARS = 240
# Warning text -> kind, tried in order (fixed values).
WARNING_PATTERNS = (
    (r"^showing first \d+ rows", "truncated"),
    (r"broadcast across", "broadcast"),
    (r"associated over", "associated"),
    (r"degenerate re-aggregation", "degenerate_reaggregation"),
    (r"by semi-join", "semi_join_pushed"),
    (r"statement timeout", "statement_timeout_skipped"),
    (r"^\[[^\]]+\] (rewrote|flagged) ", "normalization"),
    (r"whole[_ ]periods", "whole_periods_non_nesting"),
)
# Error text -> exception class: "Error executing tool X: <Class>: ..." or a bare "<Class>: ..." (fixed values).
PREFIXED_ERROR = r"Error executing tool [\w.-]+: ([A-Za-z_][\w.]*):"
BARE_ERROR = r"^([A-Za-z_][\w.]*(?:Error|Exception)): "


def _arr(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def suite_of(dataset: Column, covers: Column) -> Column:
    """The suite of a trial: jaffle by dataset, trap when it covers a pitfall, combo with two or more rows."""
    pit = F.arrays_overlap(covers, _arr(PITFALLS))
    n_rows = F.size(F.filter(covers, lambda c: F.array_contains(_arr(COVERED_ROWS), c)))
    return F.when(dataset == "jaffle", "jaffle").when(pit, "trap").when(n_rows >= 2, "combo").otherwise("capability")


def _counts() -> list[Column]:
    v = F.col("verdict")
    passed = v.isNotNull() & v["correct"] & v["single_query"]
    return [
        F.count(F.lit(1)).alias("trials"),
        F.count(F.when(v.isNotNull() & v["correct"], 1)).alias("correct"),
        F.count(F.when(v.isNotNull() & v["single_query"], 1)).alias("single_query"),
        F.count(F.when(passed, 1)).alias("passed"),
    ]


def passed_col() -> Column:
    v = F.col("verdict")
    return F.coalesce(v.isNotNull() & v["correct"] & v["single_query"], F.lit(False))


def suite_scoreboard(results: DataFrame) -> DataFrame:
    """L1: suite x profile x model -> trials, correct, single query, passed (expected failures left out)."""
    scored = results.where(F.col("xfail").isNull()).withColumn("suite", suite_of(F.col("dataset"), F.col("covers")))
    return scored.groupBy("suite", "profile", "model").agg(*_counts())


def row_scoreboard(spark: SparkSession, results: DataFrame) -> DataFrame:
    """L2: per capability row: tasks, trials and counts; a trial counts under every row it covers.

    Rows without trials appear with zeros; uncovered rows are marked. Bench trials only, xfail excluded.
    """
    bench = results.where((F.col("dataset") == "bench") & F.col("xfail").isNull())
    ex = bench.withColumn("row", F.explode(F.array_distinct("covers"))).where(F.col("row").isin(*ALL_ROWS))
    agg = ex.groupBy("row").agg(F.count_distinct("task_id").alias("tasks"), *_counts())
    labels = spark.createDataFrame([(r, r in UNCOVERED_ROWS) for r in ALL_ROWS], "row string, uncovered boolean")
    out = labels.join(F.broadcast(agg), "row", "left")  # the label table is fixed (25 rows)
    for c in ("tasks", "trials", "correct", "single_query", "passed"):
        out = out.withColumn(c, F.when(F.col("uncovered"), F.lit(None)).otherwise(F.coalesce(F.col(c), F.lit(0))))
    return out


def run_scoreboard(results: DataFrame) -> DataFrame:
    """L2: the row scoreboard of every run (profile x model): tasks, trials, counts and the five flags of every capability row.

    A row that a run has no trial of shows 0 tasks and trials and no counts; an uncovered row shows none at all. One scan:
    trials are counted per (row, run, task), summed per (row, run), and each run's rows, 25 at most, are laid out from a map.
    """
    verdict = F.col("verdict")
    flags = [F.count_if(verdict.isNotNull() & verdict["flags"][f]).alias(f) for f in FLAGS]
    bench = results.where((F.col("dataset") == "bench") & F.col("xfail").isNull())
    known = F.filter(F.array_distinct("covers"), lambda c: F.array_contains(_arr(ALL_ROWS), c))
    per_task = bench.withColumn("row", F.explode_outer(known)).groupBy("profile", "model", "row", "task_id").agg(*_counts(), *flags)
    names = ["trials", "correct", "single_query", "passed", *FLAGS]
    per_row = per_task.groupBy("profile", "model", "row").agg(F.count_distinct("task_id").alias("tasks"), *[F.sum(c).alias(c) for c in names])
    cells = F.struct("row", F.struct("tasks", *names).alias("counts"))
    runs = per_row.groupBy("profile", "model").agg(F.map_from_entries(F.collect_list(F.when(F.col("row").isNotNull(), cells))).alias("__rows"))
    out = runs.select("profile", "model", "__rows", F.explode(_arr(ALL_ROWS)).alias("row"))
    out = out.withColumn("uncovered", F.col("row").isin(*UNCOVERED_ROWS)).withColumn("__c", F.try_element_at("__rows", F.col("row")))
    shown = ~F.col("uncovered")
    zero = [F.when(shown, F.coalesce(F.col(f"__c.{c}"), F.lit(0))).alias(c) for c in ("tasks", "trials")]
    return out.select("profile", "model", "row", "uncovered", *zero, *[F.when(shown, F.col(f"__c.{c}")).alias(c) for c in names[1:]])


def pitfall_scoreboard(results: DataFrame) -> DataFrame:
    """L3: per pitfall x profile x model over bench trials: trials and correct answers."""
    bench = results.where((F.col("dataset") == "bench") & F.col("xfail").isNull())
    ex = bench.withColumn("pitfall", F.explode(F.array_distinct("covers"))).where(F.col("pitfall").isin(*PITFALLS))
    v = F.col("verdict")
    return ex.groupBy("pitfall", "profile", "model").agg(F.count(F.lit(1)).alias("trials"), F.count(F.when(v.isNotNull() & v["correct"], 1)).alias("correct"))


def pass_rates(results: DataFrame, n: int) -> DataFrame:
    """L4 (repeat mode): per task, k passed of N trials and pass^N = (k/N)^N."""
    g = results.where(F.col("xfail").isNull()).groupBy("task_id", "profile", "model")
    out = g.agg(F.count(F.when(passed_col(), 1)).alias("k"), F.count(F.lit(1)).alias("trials"))
    return out.withColumn("pass_hat_n", F.pow(F.col("k") / F.col("trials"), F.lit(n)))


def until_pass(results: DataFrame) -> DataFrame:
    """L4 (until-pass mode): per task, passed on the first try, eventually, and the number of attempts."""
    g = results.where(F.col("xfail").isNull()).groupBy("task_id", "profile", "model")
    return g.agg(
        F.min_by(passed_col(), F.col("trial")).alias("first_try"),
        F.bool_or(passed_col()).alias("eventual"),
        F.count(F.lit(1)).alias("attempts"),
    )


def totals(results: DataFrame) -> DataFrame:
    """Trials, tokens, cost (NULL as 0), time and trials with partial usage; one row."""
    u = F.col("usage")
    return results.agg(
        F.count(F.lit(1)).alias("trials"),
        F.sum(u["input_tokens"]).alias("input_tokens"),
        F.sum(u["output_tokens"]).alias("output_tokens"),
        F.sum(u["cache_read_tokens"]).alias("cache_read_tokens"),
        F.sum(u["cache_write_tokens"]).alias("cache_write_tokens"),
        F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_usd"),
        F.sum("duration_s").alias("duration_s"),
        F.count(F.when(u["partial"], 1)).alias("partial_usage_trials"),
    )


def trace_flags(calls: DataFrame, trace_key: str, tool: str, text: str, query_tool: str = "query") -> DataFrame:
    """Per trace: calls, used python, raw SQL, query errors, several queries (grouped aggregate)."""
    t = F.col(text)
    return calls.groupBy(trace_key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.bool_or(F.lower(t).contains("python")).alias("used_python"),
        F.bool_or(F.lower(t).rlike("select[^;]*from")).alias("raw_sql"),
        F.bool_or(t.rlike(r"Error executing tool|[A-Za-z_][A-Za-z0-9_.]*(Error|Exception): ")).alias("query_errors"),
        (F.count(F.when(F.col(tool) == query_tool, 1)) > 1).alias("several_queries"),
    )


def xfail_table(results: DataFrame) -> DataFrame:
    """Expected failures by task x issue x profile x model: trials and passes."""
    xf = results.where(F.col("xfail").isNotNull())
    return xf.groupBy("task_id", "xfail", "profile", "model").agg(F.count(F.lit(1)).alias("trials"), F.count(F.when(passed_col(), 1)).alias("passed"))


def clip(text: Column, n: int = DIGEST_CHARS) -> Column:
    """Text cut to ``n`` characters with an ellipsis when longer."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def call_digest(calls: DataFrame, trace_key: str, pos: str, tool: str, text: str) -> DataFrame:
    """One line per call: ``#n `tool` <what, whitespace collapsed, clipped for display>``.

    The whole text is processed; ``chars`` is the length of the collapsed text, of which the display
    line shows at most ``DIGEST_CHARS`` characters.
    """
    what = F.regexp_replace(F.col(text), r"[\n\r\t ]+", " ")
    n = (F.col(pos) + 1).cast("long")
    line = F.concat(F.lit("#"), n.cast("string"), F.lit(" `"), F.col(tool), F.lit("` "), clip(what))
    return calls.select(F.col(trace_key), n.alias("call_no"), F.length(what).cast("long").alias("chars"), line.alias("line"))


def error_kind(text: Column) -> Column:
    """The exception class named by an error text, in either form; NULL when none."""
    pre = F.regexp_extract(text, PREFIXED_ERROR, 1)
    bare = F.regexp_extract(text, BARE_ERROR, 1)
    cls = F.when(pre != "", pre).when(bare != "", bare)
    return F.element_at(F.split(cls, r"\."), -1)


def warning_kind(text: Column) -> Column:
    """The kind of a warning text (first matching pattern), else 'other'."""
    expr = None
    for pat, kind in WARNING_PATTERNS:
        expr = F.when(text.rlike(pat), kind) if expr is None else expr.when(text.rlike(pat), kind)
    return expr.otherwise("other")


def dedup_usage(messages: DataFrame, trace_key: str, message_id: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Usage counted once per message id (its first occurrence), then summed per trace.

    The first occurrence is taken with ``min_by`` in a grouped aggregate (map-side combined), not a
    per-message window.
    """
    # a message without an id is one of its own
    known = F.coalesce(F.col(message_id).cast("string"), F.concat(F.lit("\u0000"), F.col(order).cast("string")))
    first = messages.withColumn("__message", known).groupBy(trace_key, "__message").agg(*[F.min_by(c, F.col(order)).alias(c) for c in cols])
    return first.groupBy(trace_key).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("turns"))


def pair_calls(uses: DataFrame, results: DataFrame, trace_key: str, call_id: str, pos: str) -> DataFrame:
    """Each tool call with its result by id (left join keeps unanswered calls), in call order.

    Where several results carry an id the last one (by ``pos``, where the results have it) counts.
    """
    rest = [c for c in results.columns if c not in (trace_key, call_id)]
    row = F.struct(*[F.col(c) for c in rest])
    last = F.max_by(row, F.col(pos)) if pos in rest else F.max(row)
    r = results.groupBy(F.col(trace_key).alias("__t"), F.col(call_id).alias("__id")).agg(last.alias("__r"))
    r = r.select("__t", "__id", *[F.col(f"__r.{c}").alias(c) for c in rest if c not in uses.columns])
    j = uses.join(r, (F.col(trace_key) == F.col("__t")) & (F.col(call_id) == F.col("__id")), "left").drop("__t", "__id")
    return j.withColumn("answered", F.col("result_text").isNotNull()) if "result_text" in results.columns else j


def coverage_problems(tasks: DataFrame, min_traps: int = MIN_TRAPS, min_wide: int = MIN_WIDE, expect: str | None = None) -> DataFrame:
    """Problems of a task set, one row each: covered rows without a task, uncovered rows with one, rows that need a
    refusal or warning task and have none (where ``expect`` names the column that says what a task expects), too few
    traps, too few tasks with three or more covered rows.

    One scan with one aggregate row; the labels are fixed. An array or expectation that is null holds nothing.
    """
    bench = tasks.where(F.col("dataset") == "bench")
    has = lambda r: F.coalesce(F.array_contains("covers", r), F.lit(False))
    n_rows = F.size(F.filter("covers", lambda c: F.array_contains(_arr(COVERED_ROWS), c)))
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    stats = [any_of(has(r)).alias(r) for r in ALL_ROWS]
    if expect is not None:
        stats += [any_of(has(r) & F.coalesce(F.col(expect) != "match", F.lit(False))).alias(f"{r}_refused") for r in REFUSAL_ROWS]
    stats += [F.count_if(F.arrays_overlap("covers", _arr(PITFALLS))).alias("traps"), F.count_if(n_rows >= 3).alias("wide")]
    problems = [F.when(~F.col(r), f"row {r} has no task") for r in COVERED_ROWS]
    problems += [F.when(F.col(r), f"row {r} is not covered but has tasks") for r in UNCOVERED_ROWS]
    if expect is not None:
        problems += [F.when(~F.col(f"{r}_refused"), f"row {r} needs a refusal or warning task") for r in REFUSAL_ROWS]
    problems += [
        F.when(F.col("traps") < min_traps, F.format_string(f"%d trap tasks, need at least {min_traps}", F.col("traps"))),
        F.when(F.col("wide") < min_wide, F.format_string(f"%d tasks cover three or more rows, need at least {min_wide}", F.col("wide"))),
    ]
    return bench.agg(*stats).select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def oversized_groups(df: DataFrame, key: Sequence[str], limit: int, name: str = "rows") -> DataFrame:
    """Groups with more than ``limit`` rows (count per group, partial aggregation)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > limit)


def select_tasks(tasks: DataFrame, ids: Sequence[str] = (), rows: Sequence[str] = (), suites: Sequence[str] = ()) -> DataFrame:
    """Tasks that meet all given selectors (any of the ids, any of the rows, any of the suites).

    Unknown suites raise, and so do ids and rows that no task has (checked against the tasks).
    """
    unknown = [s for s in suites if s not in SUITES]
    wanted = [*[("task_id", i) for i in ids], *[("covers", r) for r in rows]]
    if wanted:
        has = [F.bool_or(F.col("task_id") == v if c == "task_id" else F.array_contains("covers", v)) for c, v in wanted]
        found = tasks.agg(*[h.alias(f"k{i}") for i, h in enumerate(has)]).first()  # one row
        unknown += [v for (_, v), ok in zip(wanted, found, strict=True) if not ok]
    if unknown:
        raise UnknownReferenceError(f"unknown selection: {unknown}")
    out = tasks
    if ids:
        out = out.where(F.col("task_id").isin(*ids))
    if rows:
        out = out.where(F.arrays_overlap("covers", _arr(rows)))
    if suites:
        out = out.where(suite_of(F.col("dataset"), F.col("covers")).isin(*suites))
    return out


def jaffle_scoreboard(results: DataFrame) -> DataFrame:
    """Shop trials by task x profile x model."""
    return results.where(F.col("dataset") == "jaffle").groupBy("task_id", "profile", "model").agg(*_counts())


def produced_expected(calls: DataFrame, trace_key: str, expected_kinds: Sequence[str]) -> DataFrame:
    """L9 (refusal half): per trace, did any call return an expected error class or warning kind?"""
    kinds = _arr(expected_kinds)
    err = F.col("is_error") & F.array_contains(kinds, error_kind(F.col("result_text")))
    warn = F.exists(F.coalesce(F.col("warnings"), F.array().cast("array<string>")), lambda w: F.array_contains(kinds, warning_kind(w)))
    return calls.groupBy(trace_key).agg(F.bool_or(err | warn).alias("produced"))


def refusal_verdict(df: DataFrame, message: str, n_rows: str, phrases: Sequence[str], produced: str) -> DataFrame:
    """A refusal is right when the message names one of the phrases (any case), no rows are given,
    and (for semantic-layer runs) the expected kind was produced."""
    msg = F.lower(F.col(message))
    named = F.exists(_arr([p.lower() for p in phrases]), lambda p: F.instr(msg, p) > 0)
    return df.withColumn("refusal_ok", named & (F.col(n_rows) == 0) & F.coalesce(F.col(produced), F.lit(True)))


def first_single_call(calls: DataFrame, trace_key: str, call_no: str, result_hash: str, truth_hash: str) -> DataFrame:
    """Per trace, the first successful call whose own result equals the truth (by content hash)."""
    hit = calls.where(~F.col("is_error") & (F.col(result_hash) == F.col(truth_hash)))
    return hit.groupBy(trace_key).agg(F.min(call_no).alias("first_single_call"))


# ------------------------------------------------------------------ A8: result text -> rows

_MD_SEP = r"^\|(\s*:?-+:?\s*\|)+$"


def _md_cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.nullif(F.trim(c), F.lit("")))


def parse_results(df: DataFrame, text: str, name: str = "parsed") -> DataFrame:
    """Result text -> ``struct<columns, rows, warnings>``, or NULL when the text has no known shape.

    Shapes: a markdown table; a JSON array of records; ``{"data": [...], "warnings": [...]}``;
    ``{"columns": [...], "rows": [[...]], "truncated": ...}``. Values stay text (rows of strings).
    """
    t = F.trim(F.col(text))
    cols_rows = F.from_json(t, "struct<columns:array<string>, rows:array<array<string>>, truncated:boolean>")
    records = F.from_json(t, "array<map<string,string>>")
    wrapped = F.from_json(t, "struct<data:array<map<string,string>>, warnings:array<string>>")

    def from_records(recs: Column, warns: Column) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(recs, F.map_keys)))  # of all records, in order of appearance
        rows = F.transform(recs, lambda r: F.transform(keys, lambda k: F.try_element_at(r, k)))
        return F.struct(keys.alias("columns"), rows.alias("rows"), warns.alias("warnings"))

    lines = F.split(t, r"\n")
    is_md = F.startswith(t, F.lit("|")) & (F.size(lines) >= 2) & F.element_at(lines, 2).rlike(_MD_SEP)
    below = F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))
    other = F.array_position(F.transform(below, lambda ln: F.startswith(F.trim(ln), F.lit("|"))), F.lit(False))
    body = F.when(other > 0, F.slice(below, 1, F.greatest(other.cast("int") - 1, F.lit(0)))).otherwise(below)  # up to the first line that is no row
    md = F.struct(
        _md_cells(F.element_at(lines, 1)).alias("columns"),
        F.transform(body, _md_cells).alias("rows"),
        F.array().cast("array<string>").alias("warnings"),
    )
    no_warn = F.array().cast("array<string>")
    truncated_warn = F.when(cols_rows["truncated"], F.array(F.format_string("showing first %d rows", F.size(cols_rows["rows"])))).otherwise(no_warn)
    parsed = (
        F.when(is_md, md)
        .when(cols_rows["columns"].isNotNull() & cols_rows["rows"].isNotNull(), F.struct(cols_rows["columns"].alias("columns"), cols_rows["rows"].alias("rows"), truncated_warn.alias("warnings")))
        .when(wrapped["data"].isNotNull(), from_records(wrapped["data"], F.coalesce(wrapped["warnings"], no_warn)))
        .when(F.startswith(t, F.lit("[")) & records.isNotNull(), from_records(records, no_warn))
    )
    return df.withColumn(name, parsed)
