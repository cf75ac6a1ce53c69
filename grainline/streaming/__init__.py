"""Structured Streaming variants of batch operators.

The reference has no streams; two of its operators map naturally to streaming and are built as
variants whose output equals the batch operator on the same input:

* T1 - events per quarter hour as a tumbling event-time window with a watermark (append mode: a
  window is emitted once the watermark passes its end, late rows beyond it are dropped);
* T2 - the append-only results log as a file stream feeding the suite scoreboard (complete mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.operators.logs import suite_scoreboard
from grainline.sources.files import RESULT_SCHEMA


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def quarter_hour_stream(events: DataFrame, ts: str = "event_ts", value: str = "amount", watermark: str = "30 minutes") -> DataFrame:
    """Events and their total per 15-minute tumbling window of event time.

    Watermarks need a zoned TIMESTAMP; the naive wall clock is mapped to the UTC instant with the same
    reading (microsecond arithmetic, independent of the session zone) and mapped back for the output,
    so the windows equal the batch ``custom_bucket(ts, 'minute', 15, ...)`` buckets.
    """
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts)))
    return (
        events.withColumn("__instant", instant)
        .withWatermark("__instant", watermark)
        .groupBy(F.window("__instant", "15 minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).cast("double").alias("total_amount"))
        .select(F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")), _epoch()).alias("quarter_hour"), "events", "total_amount")
    )


def results_stream(spark, path: str) -> DataFrame:
    """The results log folder as a stream of trial results (new files are picked up as they land)."""
    return spark.readStream.schema(RESULT_SCHEMA).json(path).where(F.col("task_id").isNotNull())


def live_scoreboard(results: DataFrame) -> DataFrame:
    """The suite scoreboard (L1) kept up to date over the stream (complete output mode)."""
    return suite_scoreboard(results)
