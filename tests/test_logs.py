"""Log analytics (A8, L1-L18) on small literal result and call tables."""

import pytest
from pyspark.sql import functions as F

from grainline.operators import logs
from grainline.plans.model import UnknownReferenceError
from grainline.sources.files import RESULT_SCHEMA


def _verdict(c, s):
    return (c, s, [], [], {}, {}, (False, False, False, False, False))


@pytest.fixture(scope="module")
def results(spark):
    u = (10, 5, 100, 1, False)
    rows = [
        ("q1-a", "bench", ["Q1"], "semantic", "m", 1, _verdict(True, True), "submitted", u, 0.5, 10.0, None),
        ("q1-a", "bench", ["Q1"], "semantic", "m", 2, _verdict(True, False), "submitted", u, None, 12.0, None),
        ("c-x", "bench", ["Q2", "Q4"], "semantic", "m", 1, _verdict(False, False), "submitted", u, 1.0, 5.0, None),
        ("t-y", "bench", ["Q6", "chasm"], "semantic", "m", 1, None, "timeout", (1, 1, 1, 1, True), None, 900.0, None),
        ("j-z", "jaffle", ["jaffle"], "sql", "m", 1, _verdict(True, True), "submitted", u, 0.25, 3.0, None),
        ("q9-b", "bench", ["Q9"], "semantic", "m", 1, _verdict(False, False), "submitted", u, 0.1, 1.0, "DEV-1"),
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def test_suite_scoreboard(results):
    got = {(r.suite, r.profile): (r.trials, r.correct, r.single_query, r.passed) for r in logs.suite_scoreboard(results).collect()}
    assert got == {("capability", "semantic"): (2, 2, 1, 1), ("combo", "semantic"): (1, 0, 0, 0), ("trap", "semantic"): (1, 0, 0, 0), ("jaffle", "sql"): (1, 1, 1, 1)}


def test_row_and_pitfall_scoreboards(spark, results):
    rows = {r.row: r for r in logs.row_scoreboard(spark, results).collect()}
    assert (rows["Q1"].tasks, rows["Q1"].trials, rows["Q1"].passed) == (1, 2, 1)
    assert rows["Q3"].trials == 0 and rows["Q19"].trials is None and rows["Q19"].uncovered
    assert rows["Q9"].trials == 0  # xfail left out
    pit = {r.pitfall: (r.trials, r.correct) for r in logs.pitfall_scoreboard(results).collect()}
    assert pit == {"chasm": (1, 0)}


def test_pass_rates_and_until_pass(results):
    pr = {r.task_id: (r.k, r.trials, round(r.pass_hat_n, 6)) for r in logs.pass_rates(results, 2).collect()}
    assert pr["q1-a"] == (1, 2, 0.25)
    up = {r.task_id: (r.first_try, r.eventual, r.attempts) for r in logs.until_pass(results).collect()}
    assert up["q1-a"] == (True, True, 2) and up["c-x"] == (False, False, 1)


def test_totals_and_xfail(results):
    t = logs.totals(results).first()
    assert t.trials == 6 and t.cost_usd == pytest.approx(1.85) and t.partial_usage_trials == 1 and t.input_tokens == 51
    x = logs.xfail_table(results).collect()
    assert [(r.task_id, r.xfail, r.trials, r.passed) for r in x] == [("q9-b", "DEV-1", 1, 0)]
    j = logs.jaffle_scoreboard(results).collect()
    assert [(r.task_id, r.passed) for r in j] == [("j-z", 1)]


def test_error_and_warning_kinds(spark):
    df = spark.createDataFrame(
        [("Error executing tool query: engine.errors.TimeDimensionColumnError: bucketed",), ("ReaggregationError: fans out",), ("fine",)], "t string"
    )
    assert [r.k for r in df.select(logs.error_kind(F.col("t")).alias("k")).collect()] == ["TimeDimensionColumnError", "ReaggregationError", None]
    w = spark.createDataFrame([("showing first 20 rows",), ("total broadcast across status",), ("something",)], "t string")
    assert [r.k for r in w.select(logs.warning_kind(F.col("t")).alias("k")).collect()] == ["truncated", "broadcast", "other"]


def test_trace_flags_digest_and_sizes(spark):
    calls = spark.createDataFrame(
        [(1, 0, "query", "select a from t"), (1, 1, "python", "import python stuff"), (1, 2, "query", "x" * 300), (2, 0, "query", "ok")],
        "trace int, pos int, tool string, text string",
    )
    f = {r.trace: r for r in logs.trace_flags(calls, "trace", "tool", "text").collect()}
    assert f[1].raw_sql and f[1].used_python and f[1].several_queries and not f[2].several_queries
    d = {(r.trace, r.call_no): r.line for r in logs.call_digest(calls, "trace", "pos", "tool", "text").collect()}
    assert d[(1, 1)] == "#1 `query` select a from t" and len(d[(1, 3)]) == len("#3 `query` ") + 240 and d[(1, 3)].endswith("…")
    assert [r.trace for r in logs.oversized_groups(calls, ["trace"], 2).collect()] == [1]


def test_dedup_usage_and_pairing(spark):
    msgs = spark.createDataFrame([(1, "m1", 0, 10), (1, "m1", 1, 10), (1, "m2", 2, 5)], "trace int, mid string, k int, tokens int")
    r = logs.dedup_usage(msgs, "trace", "mid", "k", ["tokens"]).first()
    assert (r.tokens, r.turns) == (15, 2)
    uses = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "trace int, id string, pos int")
    res = spark.createDataFrame([(1, "a", "ok")], "trace int, id string, result_text string")
    p = {x.id: x.answered for x in logs.pair_calls(uses, res, "trace", "id", "pos").collect()}
    assert p == {"a": True, "b": False}
    twice = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 3, "early")], "trace int, id string, pos int, result_text string")
    assert [(x.id, x.result_text) for x in logs.pair_calls(uses, twice, "trace", "id", "pos").orderBy("id").collect()] == [("a", "late"), ("b", None)]
    anon = spark.createDataFrame([(1, None, 1, 10), (1, None, 2, 5), (1, "m", 3, 1), (1, "m", 4, 1)], "trace int, mid string, pos int, tok int")
    assert tuple(logs.dedup_usage(anon, "trace", "mid", "pos", ["tok"]).first()) == (1, 16, 3)


def test_coverage_of_refusals_and_uncovered_rows(spark):
    shape = "task_id string, dataset string, covers array<string>, expect string"
    rows = [("a", "bench", ["Q9", "Q19"], "match"), ("b", "bench", ["Q18"], "refusal"), ("c", "jaffle", ["Q9", "Q22"], "refusal"), ("d", "bench", None, None)]
    got = {r.problem for r in logs.coverage_problems(spark.createDataFrame(rows, shape), 0, 0, "expect").collect()}
    rest = {f"row {r} has no task" for r in logs.COVERED_ROWS if r not in ("Q9", "Q18")}
    assert got - rest == {"row Q19 is not covered but has tasks", "row Q9 needs a refusal or warning task"} and rest <= got
    none = {r.problem for r in logs.coverage_problems(spark.createDataFrame([], shape), expect="expect").collect()}
    assert "0 trap tasks, need at least 12" in none and "0 tasks cover three or more rows, need at least 2" in none and len(none) == 27


def test_run_scoreboard(spark, results):
    flagged = (True, True, [], [], {}, {}, (True, False, True, False, False))
    u = (1, 1, 1, 1, False)
    more = [
        ("q1-a", "bench", ["Q1", "Q1", "Q22"], "sql", "m", 1, flagged, "submitted", u, 0.5, 1.0, None),
        ("q1-b", "bench", ["Q1"], "sql", "m", 1, None, "timeout", u, 0.5, 1.0, None),
        (None, "bench", None, None, "m", 1, None, "timeout", u, 0.5, 1.0, None),
    ]
    out = logs.run_scoreboard(results.unionByName(spark.createDataFrame(more, RESULT_SCHEMA)))
    got = {(r.profile, r.row): r for r in out.collect()}
    assert len(got) == 75 and not any(c.startswith("__") for c in out.columns)
    q1 = got[("sql", "Q1")]
    assert (q1.tasks, q1.trials, q1.correct, q1.passed, q1.used_python, q1.raw_sql, q1.edited_models) == (2, 2, 1, 1, 1, 0, 1)
    assert got[("semantic", "Q1")].trials == 2 and got[("semantic", "Q9")].trials == 0 and got[("semantic", "Q9")].correct is None
    assert got[("sql", "Q22")].uncovered and got[("sql", "Q22")].trials is None
    assert got[(None, "Q1")].tasks == 0


def test_coverage_and_selection(spark):
    tasks = spark.createDataFrame(
        [("q1", "bench", ["Q1"]), ("t1", "bench", ["Q6", "chasm"]), ("j1", "jaffle", ["jaffle"])], "task_id string, dataset string, covers array<string>"
    )
    problems = [r.problem for r in logs.coverage_problems(tasks, 2, 1).collect()]
    assert "row Q2 has no task" in problems and any("trap tasks" in p for p in problems) and any("three or more" in p for p in problems)
    assert [r.task_id for r in logs.select_tasks(tasks, suites=["trap"]).collect()] == ["t1"]
    assert {r.task_id for r in logs.select_tasks(tasks, ids=["q1", "t1"], rows=["chasm"]).collect()} == {"t1"}
    assert logs.select_tasks(tasks, ids=["q1"], rows=["chasm"]).collect() == []
    with pytest.raises(UnknownReferenceError):
        logs.select_tasks(tasks, rows=["Q2"])
    with pytest.raises(UnknownReferenceError):
        logs.select_tasks(tasks, ids=["nope"])
    with pytest.raises(UnknownReferenceError):
        logs.select_tasks(tasks, suites=["bogus"])


def test_refusal_and_single_call(spark):
    calls = spark.createDataFrame(
        [(1, True, "ReaggregationError: x", None), (2, False, "ok", ["total broadcast across status"])], "trace int, is_error boolean, result_text string, warnings array<string>"
    )
    got = {r.trace: r.produced for r in logs.produced_expected(calls, "trace", ["ReaggregationError", "broadcast"]).collect()}
    assert got == {1: True, 2: True}
    subs = spark.createDataFrame([(1, "The total would double count", 0, True), (2, "here it is", 3, True)], "trace int, msg string, n int, produced boolean")
    v = {r.trace: r.refusal_ok for r in logs.refusal_verdict(subs, "msg", "n", ["double count", "fan out"], "produced").collect()}
    assert v == {1: True, 2: False}
    hashes = spark.createDataFrame([(1, 1, False, "h0", "h1"), (1, 2, False, "h1", "h1"), (1, 3, False, "h1", "h1")], "trace int, call_no int, is_error boolean, rh string, th string")
    assert logs.first_single_call(hashes, "trace", "call_no", "rh", "th").first().first_single_call == 2


def test_parse_result_shapes(spark):
    texts = [
        ("md", "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |"),
        ("records", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'),
        ("wrapped", '{"data": [{"a": 1, "b": "x"}], "warnings": ["showing first 1 rows"]}'),
        ("colrows", '{"columns": ["a", "b"], "rows": [["1", "x"]], "truncated": true}'),
        ("union", '[{"a": 1}, {"a": 2, "b": 3}]'),
        ("tail", "| a |\n|---|\n|  |\n| 2 |\n\nnote\n| not a row |"),
        ("junk", "no table here"),
    ]
    df = logs.parse_results(spark.createDataFrame(texts, "kind string, text string"), "text")
    got = {r.kind: r.parsed for r in df.collect()}
    assert got["md"].columns == ["a", "b"] and got["md"].rows == [["1", "x"], ["2", "y"]]
    assert got["records"].rows == [["1", "x"], ["2", "y"]]
    assert got["wrapped"].warnings == ["showing first 1 rows"]
    assert got["colrows"].columns == ["a", "b"] and got["colrows"].warnings == ["showing first 1 rows"]
    assert got["union"].columns == ["a", "b"] and got["union"].rows == [["1", None], ["2", "3"]]
    assert got["tail"].rows == [[None], ["2"]]
    assert got["junk"] is None
