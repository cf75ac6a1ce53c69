"""Period transforms on time series.

A *series* is an aggregate keyed by a calendar bucket (and optional other dimensions). Its size is the
number of buckets times the dimension values, independent of the fact rows, so windows over it are
cheap even when unpartitioned. Rules:

* shifts are calendar, not row, based: the previous period is joined on ``bucket - n units`` (S5), so a
  missing period gives NULL instead of silently reading an older one;
* a date range clips the *output*; shifted and rolling values read periods outside it (S3);
* a running total accumulates inside the range only (S4), unless the caller clips after the window (E12);
* rolling windows are half-open durations ending at the bucket's end (S6) and count missing periods as
  calendar time; each fact row is sent to the few buckets whose window holds it, then grouped - an
  equi-aggregate that also works for distinct counts, which Spark's range windows reject.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from grainline.functions.calendar import bucket, check_rebucket, date_add_unit, date_range_bounds
from grainline.operators.grain import null_safe_join
from grainline.plans.model import MetricResult, ResultWarning

_STEP = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def series(df: DataFrame, time_col: str, unit: str, dims: Sequence[str], measures: Mapping[str, Column], name: str = "period") -> DataFrame:
    """Aggregate ``measures`` by calendar bucket ``name`` (DATE) and ``dims``."""
    return df.groupBy(bucket(time_col, unit).alias(name), *dims).agg(*[c.alias(n) for n, c in measures.items()])


def spine(spark: SparkSession, lo: dt.date | str, hi: dt.date | str, unit: str, name: str = "period") -> DataFrame:
    """A10: every bucket start from ``lo`` to ``hi`` inclusive (bounded by the calendar, not the data)."""
    lo_s, hi_s = str(lo), str(hi)
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(lo_s).cast("date"), F.lit(hi_s).cast("date"), F.expr(f"interval {_STEP[unit]}"))).alias(name)
    )


def clip(df: DataFrame, col: str, date_range) -> DataFrame:
    """Keep buckets inside ``date_range`` (half-open on the bucket start)."""
    start, end = date_range_bounds(date_range)
    c = F.col(col)
    return df.filter((c >= F.lit(start.isoformat()).cast("date")) & (c < F.lit(end.isoformat()).cast("date")))


def time_shift(
    s: DataFrame, period: str, value: str, n: int, unit: str, dims: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """The value of the period ``n`` units away (``n = -1``: previous), matched on calendar keys.

    Every row of the series goes to its own period and, as a shifted value, to the period that looks at it;
    the two are brought together by one aggregate. The series is read once, not joined with itself.
    """
    name = name or f"{value}_shift"
    rest = [c for c in s.columns if c != period and c not in dims]
    places = F.array(
        F.struct(F.lit(True).alias("own"), F.col(period).alias("at")),
        F.struct(F.lit(False).alias("own"), date_add_unit(F.col(period), -n, unit).alias("at")),
    )
    both = s.withColumn("__to", F.explode(places))
    own = F.col("__to.own")
    out = both.groupBy(F.col("__to.at").alias(period), *dims).agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in rest],
        F.max(F.when(~own, F.col(value))).alias(name),
        F.bool_or(own).alias("__own"),
    )
    return out.where("__own").select(period, *dims, *rest, name)


def change(s: DataFrame, period: str, value: str, unit: str, dims: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Value minus the previous calendar period's value (NULL when that period is missing)."""
    name = name or f"{value}_change"
    out = time_shift(s, period, value, -1, unit, dims, "__prev")
    return out.withColumn(name, F.col(value) - F.col("__prev")).drop("__prev")


def change_pct(s: DataFrame, period: str, value: str, unit: str, dims: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``value / previous - 1`` (plain meaning; NULL without a previous period or when it is 0)."""
    name = name or f"{value}_change_pct"
    out = time_shift(s, period, value, -1, unit, dims, "__prev")
    pct = F.try_divide(F.col(value).cast("double"), F.col("__prev").cast("double")) - 1
    return out.withColumn(name, pct).drop("__prev")


def cumsum(s: DataFrame, period: str, value: str, dims: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Running sum in period order per ``dims`` over the rows present (clip before for S4)."""
    name = name or f"{value}_cumsum"
    w = Window.partitionBy(*dims).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn(name, F.sum(value).over(w))


def lag_change(s: DataFrame, period: str, value: str, dims: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Value minus the previous *row* (equal to ``change`` only when no period is missing)."""
    name = name or f"{value}_lag_change"
    w = Window.partitionBy(*dims).orderBy(period)
    return s.withColumn(name, F.col(value) - F.lag(value).over(w))


def _duration(window: str) -> tuple[int, str]:
    n, u = int(window[:-1]), window[-1]
    return n, {"d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}[u]


def rolling(
    df: DataFrame,
    time_col: str,
    unit: str,
    window: str,
    measures: Mapping[str, Callable[[Column], Column]],
    values: Mapping[str, str],
    date_range=None,
    name: str = "period",
    distinct_key: str | None = None,
    every_bucket: bool = False,
) -> DataFrame:
    """Aggregates over the half-open window ``[bucket_end - window, bucket_end)`` of every bucket.

    ``measures[name](col)`` builds the aggregate of the column ``values[name]``. Each row goes to the
    buckets whose window holds it (at most ``window / unit + 1`` of them); with ``distinct_key`` rows are
    cut to (day, key) before the explode. Only buckets with rows
    in their window appear; clip with ``date_range``. With ``every_bucket`` (needs ``date_range``) every
    bucket of the range appears, with NULL aggregates where its window is empty (spine semantics).
    """
    n, wunit = _duration(window)
    t = F.col(time_col)
    cols = list({*values.values()})
    base = df.select(t.alias("__t"), *cols)
    if every_bucket and date_range is None:
        raise ValueError("every_bucket needs a date_range")
    if date_range is not None:  # only rows that some window of the range can hold are multiplied
        start, end = date_range_bounds(date_range)
        oldest = date_add_unit(F.lit(start.isoformat()).cast("date"), -n, wunit)
        base = base.where((F.col("__t") >= oldest) & (F.col("__t") < F.lit(end.isoformat()).cast("date")))
    if distinct_key is not None:
        # only the day matters for a distinct count; duplicates are removed by the map-side partial
        # aggregation after the explode, so no extra shuffle is spent on a pre-deduplication
        base = base.select(F.to_date("__t").alias("__t"), *cols)
    first = bucket("__t", unit)
    last = bucket(date_add_unit(F.col("__t"), n, wunit), unit)
    cand = base.withColumn(name, F.explode(F.sequence(first, last, F.expr(f"interval {_STEP[unit]}"))))
    if date_range is not None:
        start, end = date_range_bounds(date_range)
        cand = cand.filter((F.col(name) >= F.lit(start.isoformat()).cast("date")) & (F.col(name) < F.lit(end.isoformat()).cast("date")))
    end_of_bucket = date_add_unit(F.col(name), 1, unit)
    window_start = date_add_unit(end_of_bucket, -n, wunit)
    tt = F.col("__t").cast("timestamp_ntz")
    inside = (tt >= window_start.cast("timestamp_ntz")) & (tt < end_of_bucket.cast("timestamp_ntz"))
    out = cand.filter(inside).groupBy(name).agg(*[fn(F.col(values[m])).alias(m) for m, fn in measures.items()])
    if every_bucket:
        last_start = date_add_unit(F.lit(end.isoformat()).cast("date"), -1, unit)
        grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start.isoformat()).cast("date"), last_start, F.expr(f"interval {_STEP[unit]}"))).alias(name))
        out = grid.join(out, name, "left")
    return out


def fill_periods(
    s: DataFrame, spark: SparkSession, period: str, lo, hi, unit: str, values: Sequence[str], dims_df: DataFrame | None = None, fill=0
) -> DataFrame:
    """every bucket of ``[lo, hi]`` (times each dimension value of ``dims_df``), missing values = ``fill``."""
    grid = spine(spark, lo, hi, unit, period)
    dims: list[str] = []
    if dims_df is not None:
        # every period for every dimension value: each distinct dimension row generates its periods
        dims = dims_df.columns
        seq = F.sequence(F.lit(str(lo)).cast("date"), F.lit(str(hi)).cast("date"), F.expr(f"interval {_STEP[unit]}"))
        grid = dims_df.distinct().select(F.explode(seq).alias(period), *dims)
    out = null_safe_join(grid, s, [period, *dims], "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(v), F.lit(fill)))
    return out


def rebucket(df: DataFrame, col: str, stored: str, wanted: str, name: str | None = None) -> DataFrame:
    """re-bucket a bucketed column to a coarser unit; a finer one raises TimeDimensionColumnError."""
    check_rebucket(stored, wanted)
    return df.withColumn(name or col, bucket(col, wanted))


def whole_periods_only(s: DataFrame, period: str, unit: str, facts: DataFrame, time_col: str, stored: str | None = None) -> MetricResult:
    """drop buckets that the data does not cover fully (an incomplete first or last period).

    A bucket is whole when it starts on or after the first data day and ends on or before the day after
    the last data day; the bounds are a one-row aggregate of ``facts`` (scalar subqueries). Warns when the
    stored unit does not nest in ``unit`` (weeks in months).
    """
    warnings = []
    if stored == "week" and unit in ("month", "quarter", "year"):
        warnings.append(ResultWarning("whole_periods_non_nesting", "whole_periods_only: weeks do not nest in months"))
    bounds = facts.agg(F.to_date(F.min(time_col)).alias("__lo"), F.date_add(F.to_date(F.max(time_col)), 1).alias("__hi"))
    lo, hi = bounds.select("__lo").scalar(), bounds.select("__hi").scalar()  # one merged scalar subquery
    p = F.col(period)
    return MetricResult(s.filter((p >= lo) & (date_add_unit(p, 1, unit) <= hi)), warnings)


def consecutive_periods(s: DataFrame, period: str, cond: Column, dims: Sequence[str] = (), name: str = "streak") -> DataFrame:
    """Length of the run of consecutive periods with ``cond`` true ending at each period (0 when false).

    Gaps and islands: a running count of breaks numbers the islands; the position in the island is the
    run length.
    """
    w = Window.partitionBy(*dims).orderBy(period)
    flagged = s.withColumn("__up", F.coalesce(cond, F.lit(False)))
    flagged = flagged.withColumn("__grp", F.sum(F.when(F.col("__up"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(*dims, "__grp").orderBy(period)
    out = flagged.withColumn(name, F.when(F.col("__up"), F.row_number().over(wi) - F.when(F.col("__grp") > 0, 1).otherwise(0)).otherwise(0))
    return out.drop("__up")
