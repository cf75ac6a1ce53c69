from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from grainline.operators import calls, result_text

COLUMNS, ROWS = ["region", "revenue"], [["North", 1.5], ["South", 2], [None, -3e2]]
RECORDS = [dict(zip(COLUMNS, r, strict=True)) for r in ROWS]
MARKDOWN = "| region | revenue |\n| --- | ---: |\n| North | 1.5 |\n| South | 2 |\n|  | -3e2 |"
KEYED = {"columns": [{"name": "revenue", "type": "DOUBLE"}, {"name": "region"}], "rows": [{"region": r[0], "revenue": r[1]} for r in ROWS], "truncated": True}


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = result_text.parse_texts(df, "t").select("i", F.to_json("parsed").alias("j"), F.expr("transform(parsed.rows, r -> transform(r, c -> schema_of_variant(c)))").alias("kinds")).orderBy("i").collect()
    return [(json.loads(r.j) if r.j is not None else None, r.kinds) for r in out]


def shape(p):
    return None if p is None else (p["columns"], [[c for c in r] for r in p["rows"]], [w["kind"] for w in p.get("warnings", [])])


def test_shapes_parse_alike(spark):
    texts = [MARKDOWN, json.dumps(RECORDS), json.dumps({"data": RECORDS, "warnings": []}), json.dumps({"columns": COLUMNS, "rows": ROWS, "truncated": False}), "  \n" + MARKDOWN + "\n\n"]
    for p, kinds in parsed(spark, texts):
        assert shape(p) == (COLUMNS, ROWS, [])
        assert kinds[0][0] == "STRING" and kinds[1][1] == "BIGINT" and kinds[2][0] is None


def test_column_objects(spark):
    ((p, _), (repeat, _), (other, _), (nameless, _)) = parsed(
        spark,
        [
            json.dumps(KEYED),
            json.dumps(KEYED | {"columns": [{"name": "a"}, {"name": "a"}], "rows": [{"a": 1}]}),
            json.dumps(KEYED | {"rows": [{"region": 1}]}),
            json.dumps(KEYED | {"columns": [{"title": "a"}]}),
        ],
    )
    assert shape(p) == (["revenue", "region"], [[r[1], r[0]] for r in ROWS], ["truncated"])
    assert repeat is None and other is None and nameless is None


def test_footers_and_warnings(spark):
    footer = "\n\n_(truncated to 20 rows, 45 in all)_\n\nWarnings:\n- revenue is broadcast across city\n- showing first 20 rows\n- something else\nnot one\n- nor this"
    told = {"data": [], "warnings": [{"kind": "broadcast", "hint": "h"}, {"hint": "no kind"}, {"kind": "other"}]}
    (md, _), (js, _) = parsed(spark, [MARKDOWN + footer, json.dumps(told)])
    assert shape(md) == (COLUMNS, ROWS, ["truncated", "broadcast", "truncated", "other"])
    assert md["warnings"][1]["message"] == "revenue is broadcast across city"
    assert js["warnings"] == [{"kind": "broadcast", "message": "h"}, {"kind": "other", "message": ""}] and js["rows"] == []


def test_keys_keep_their_order_and_gaps(spark):
    ((p, _),) = parsed(spark, [json.dumps([{"z": 1, "a": "x"}, {"a": None, "m": True, "z": 2.5}])])
    assert shape(p)[:2] == (["z", "a", "m"], [[1, "x", None], [2.5, None, True]])


def test_sql_block_is_skipped(spark):
    sql = "SQL:\nWITH b AS (\n  SELECT 1\n\n  FROM orders\n)\nSELECT * FROM b\n\n"
    for p, _ in parsed(spark, [sql + MARKDOWN, sql + json.dumps(RECORDS), sql + "\n" + json.dumps({"data": RECORDS})]):
        assert shape(p) == (COLUMNS, ROWS, [])
    assert parsed(spark, ["SQL:\nSELECT 1\n\nQuery Plan:\nscan orders", "SQL:\nSELECT 1", "SQL:"]) == [(None, None)] * 3


@pytest.mark.parametrize("batch", [0])
def test_what_is_no_result(spark, batch):
    texts = ["", "Model 'x' created.", "[1, 2]", '{"result": 1}', '{"columns": ["a"], "truncated": false}', '{"columns": "a", "rows": [[1]]}', '{"columns": ["a"], "rows": [1]}', '{"columns": null, "data": []}', '{"data": {}}', "[{", "| a |", "| a |\n| b |", None]
    assert [p for p, _ in parsed(spark, texts)] == [None] * len(texts)


def test_cells_as_rows(spark):
    df = result_text.parse_texts(spark.createDataFrame([(7, MARKDOWN), (8, "no")], "i int, t string"), "t")
    got = [(r.i, r.row_no, r.column, r.cell_kind) for r in result_text.result_rows(df, "parsed", ["i"]).orderBy("row_no", "column").collect()]
    assert got[:2] == [(7, 0, "region", "STRING"), (7, 0, "revenue", "DECIMAL" if got[1][3] == "DECIMAL" else "DOUBLE")] and len(got) == 6


PLAIN = {"source_model": "orders", "measures": [{"formula": "sum(amount)", "name": "v"}]}


def inline(column):
    return {"query": {"source_model": {"source_name": "orders", "columns": [column]}, "measures": []}}


SQL_CALLS = [
    ("create_model", {"name": "agg", "sql": "select 1"}),
    ("create_model", {"name": "o", "columns": [{"name": "n", "sql": "amount * 2"}]}),
    ("edit_model", {"columns": [{"name": "a", "filter": "status = 'ok'"}]}),
    ("edit_model", {"columns": json.dumps([{"name": "a", "filter": "status = 'ok'"}])}),
    ("edit_model", {"aggregations": [{"name": "s", "formula": "SUM({value})"}]}),
    ("edit_model", {"add_filters": ["amount > 0"]}),
    ("edit_model", {"filters": "amount > 0"}),
    ("edit_model", {"source_queries": [{"source_model": {"sql": "x"}}]}),
    ("create_model", {"query": {"source_model": {"columns": [{"sql": "1"}]}}}),
    ("query", inline({"name": "x", "sql": "amount * 1.1"})),
    ("query", {"query": json.dumps([PLAIN, {"source_model": json.dumps({"sql": "select 2"})}])}),
    ("sql", {}),
    ("sql", None),
]
PLAIN_CALLS = [
    ("query", {"query": PLAIN}),
    ("query", inline({"name": "x", "sql": "  "})),
    ("query", {"query": "saved", "sql": "x"}),
    ("create_model", {"name": "p", "query": PLAIN}),
    ("edit_model", {"columns": None, "filters": [1, {"a": "b"}], "sql": {"a": 1}}),
    ("inspect", {"sql": "select 1"}),
    ("python", {"sql": "select 1"}),
    ("query", None),
]


def call_frame(spark, rows):
    df = spark.createDataFrame([(t, i, tool, json.dumps(a) if a is not None else None, err, text) for t, i, tool, a, err, text in rows], "trace string, call int, tool string, a string, is_error boolean, result_text string")
    return result_text.parse_texts(df.withColumn("args", F.try_parse_json("a")), "result_text")


def test_sql_is_found_wherever_tools_take_it(spark):
    rows = [(f"s{i}", 1, *c, False, "") for i, c in enumerate(SQL_CALLS)] + [(f"p{i}", 1, *c, False, "") for i, c in enumerate(PLAIN_CALLS)]
    got = {r.trace: r.raw_sql for r in calls.trace_flags(call_frame(spark, rows), "trace").collect()}
    assert {t for t, f in got.items() if f} == {f"s{i}" for i in range(len(SQL_CALLS))}


def test_flags_of_traces(spark):
    rows = [
        ("clean", 1, "query", {"query": PLAIN}, False, ""),
        ("busy", 1, "create_model", {"name": "x", "query": PLAIN}, False, ""),
        ("busy", 2, "query", {"query": PLAIN}, True, "Error executing tool query: X: y"),
        ("busy", 3, "sql", {"sql": "select 1"}, False, ""),
        ("busy", 4, "python", {"code": "1"}, False, ""),
        ("harmless", 1, "python", {}, True, "ZeroDivisionError"),
        ("harmless", 2, "submit_answer", {}, True, "no"),
        ("harmless", 3, "inspect", {}, True, "no"),
    ]
    df = call_frame(spark, rows)
    got = {r.trace: tuple(r)[1:] for r in calls.trace_flags(df, "trace").collect()}
    assert got == {"clean": (1, False, False, False, False, False), "busy": (4, True, True, True, True, True), "harmless": (3, True, False, False, True, False)}
    assert {r.trace: r.query_errors for r in calls.trace_flags(df, "trace", surface="sql").collect()} == {"clean": False, "busy": False, "harmless": False}


def test_digest(spark):
    rows = [
        ("t", 1, "query", {"query": [PLAIN, {"source_model": "x", "order": []}]}, False, MARKDOWN),
        ("t", 2, "query", {"query": "monthly", "refine": {"a": 1}}, True, "Error executing tool query: pkg.ReaggregationError: no"),
        ("t", 3, "sql", {"sql": "select\n  1"}, False, json.dumps({"columns": ["a"], "rows": [[1]], "truncated": True})),
        ("t", 4, "python", {}, False, ""),
        ("t", 5, "edit_model", {"name": "n"}, False, "Model edited."),
        ("t", 6, "sql", {"sql": "x" * 500}, True, "failed"),
    ]
    got = [r.line for r in calls.call_digest(call_frame(spark, rows), "trace", "call").orderBy("call").collect()]
    assert got[:4] == [
        '#1 `query` orders measures=[{"formula":"sum(amount)","name":"v"}] ; x → 3 rows',
        '#2 `query` saved query monthly refined by {"a":1} → error ReaggregationError',
        "#3 `sql` select 1 → 1 rows, truncated warning",
        '#5 `edit_model` {"name":"n"} → ok',
    ]
    assert got[4].endswith("x… → error") and len(got) == 5
