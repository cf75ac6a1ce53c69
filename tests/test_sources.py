"""File sources and sinks (A1, A2, A4-A6, A9) in scratch folders."""

import json
import tempfile
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from scales import SF_SMALL
from grainline.sources import files


def _scratch() -> Path:
    return Path(tempfile.mkdtemp(prefix="grainline-test-"))


def test_csv_inferred_and_explicit(spark):
    d = _scratch()
    (d / "stores.csv").write_text("id,name,opened_at,tax_rate\ns1,Brooklyn,2016-09-01 00:00:00,0.04\ns2,Chicago,2017-03-01 00:00:00,0.0625\n")
    inferred = files.read_csv(spark, str(d / "stores.csv"))
    assert dict(inferred.dtypes)["tax_rate"] == "double"
    explicit = files.read_csv(spark, str(d / "stores.csv"), "id string, name string, opened_at timestamp_ntz, tax_rate double")
    assert explicit.where(F.col("name") == "Chicago").first().tax_rate == 0.0625


def test_scan_prunes_columns(spark):
    df = files.scan(spark, f"{SF_SMALL}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_results_jsonl_blank_lines_and_append(spark):
    d = _scratch() / "results"
    d.mkdir()
    line = {"task_id": "q1", "dataset": "bench", "covers": ["Q1"], "profile": "semantic", "model": "m", "trial": 1,
            "verdict": {"correct": True, "single_query": True}, "end_reason": "submitted", "usage": {"input_tokens": 3},
            "cost_usd": None, "duration_s": 2.0, "xfail": None}
    (d / "part-0.json").write_text(json.dumps(line) + "\n\n" + json.dumps({**line, "trial": 2}) + "\n")
    df = files.read_results(spark, str(d))
    assert df.count() == 2 and df.first().verdict.correct
    files.append_results(df.limit(1), str(d))
    assert files.read_results(spark, str(d)).count() == 3
    (d / "part-1.json").write_text(json.dumps({**line, "task_id": None, "trial": 9}) + "\n")
    assert [r.trial for r in files.read_results(spark, str(d)).where("task_id is null").collect()] == [9]
    (d / "part-2.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_results(spark, str(d)).collect()


def test_traces_key_from_file_name(spark):
    d = _scratch() / "traces"
    d.mkdir()
    trace = {"profile": "semantic", "calls": [{"tool": "query", "args": "{}", "result_text": "| a |\n|---|\n| 1 |", "is_error": False}],
             "usage": {"input_tokens": 1}, "turns": 2, "end_reason": "submitted"}
    (d / "q4-prior-year__semantic__model-x__3.json").write_text(json.dumps(trace, indent=2))
    r = files.read_traces(spark, str(d)).first()
    assert (r.task_id, r.trace_profile, r.model, r.trial) == ("q4-prior-year", "semantic", "model-x", 3)
    assert r.calls[0].tool == "query"


def test_snapshots_replace_stale(spark):
    d = str(_scratch() / "truth")
    a = spark.createDataFrame([("t1", 1), ("t2", 2)], "task_id string, v int")
    files.write_snapshots(a, d)
    files.write_snapshots(a.where(F.col("task_id") == "t1"), d)
    assert sorted(p.name for p in Path(d).iterdir() if p.name.startswith("task_id=")) == ["task_id=t1"]
