"""Streaming variants equal their batch operators on the same input."""

import json
import tempfile
from pathlib import Path


from scales import SF_SMALL
from grainline.catalog import all_questions
from grainline.operators.logs import suite_scoreboard
from grainline.sources.bindings import Bench
from grainline.streaming import live_scoreboard, quarter_hour_stream, results_stream


def test_quarter_hour_stream_equals_batch(spark):
    d = Path(tempfile.mkdtemp(prefix="grainline-stream-"))
    events = Bench(spark, SF_SMALL).events
    events.write.parquet(str(d / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(d / "in"))
    q = quarter_hour_stream(stream).writeStream.outputMode("complete").format("memory").queryName("qh_test").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.quarter_hour, r.events, r.total_amount) for r in spark.table("qh_test").collect()}
    want = {(r.quarter_hour, r.events, r.total_amount) for r in all_questions()["f2_quarter_hour_events"].build(spark, SF_SMALL).collect()}
    assert got == want


def test_live_scoreboard_over_results_log(spark):
    d = Path(tempfile.mkdtemp(prefix="grainline-log-"))
    (d / "log").mkdir()
    base = {"dataset": "bench", "profile": "semantic", "model": "m", "end_reason": "submitted", "usage": {}, "duration_s": 1.0}
    lines = [
        {**base, "task_id": "q1", "covers": ["Q1"], "trial": 1, "verdict": {"correct": True, "single_query": True}},
        {**base, "task_id": "t1", "covers": ["Q6", "chasm"], "trial": 1, "verdict": {"correct": False, "single_query": False}},
    ]
    (d / "log" / "a.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    q = live_scoreboard(results_stream(spark, str(d / "log"))).writeStream.outputMode("complete").format("memory").queryName("sb_test").start()
    try:
        q.processAllAvailable()
        (d / "log" / "b.json").write_text(json.dumps({**lines[0], "trial": 2}) + "\n")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.suite, r.trials, r.passed) for r in spark.table("sb_test").collect()}
    batch = suite_scoreboard(spark.read.schema(results_stream(spark, str(d / "log")).schema).json(str(d / "log")))
    assert got == {(r.suite, r.trials, r.passed) for r in batch.collect()} == {("capability", 2, 2), ("trap", 1, 0)}


def test_quarter_hour_stream_append_mode_drops_late_rows(spark):
    import datetime as dt

    d = Path(tempfile.mkdtemp(prefix="grainline-late-"))
    schema = "id bigint, amount double, event_ts timestamp_ntz"

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(d / "in" / name))

    t = dt.datetime
    write("b1", [(1, 1.0, t(2024, 1, 1, 10, 1)), (2, 2.0, t(2024, 1, 1, 10, 20))])
    stream = spark.readStream.schema(schema).parquet(str(d / "in" / "*"))
    q = quarter_hour_stream(stream, watermark="10 minutes").writeStream.outputMode("append").format("memory").queryName("qh_late").start()
    try:
        q.processAllAvailable()
        # on time: closes the 10:00 window (watermark passes 10:15); too late: 09:00 is behind the watermark
        write("b2", [(3, 4.0, t(2024, 1, 1, 10, 50)), (4, 8.0, t(2024, 1, 1, 9, 0))])
        q.processAllAvailable()
        write("b3", [(5, 16.0, t(2024, 1, 1, 11, 30))])  # moves the watermark past 10:45 and 11:00
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.quarter_hour, r.events) for r in spark.table("qh_late").collect()}
    assert (t(2024, 1, 1, 10, 0), 1) in got and (t(2024, 1, 1, 10, 15), 1) in got and (t(2024, 1, 1, 10, 45), 1) in got
    assert all(w != t(2024, 1, 1, 9, 0) for w, _ in got)  # the late row never produced a window
