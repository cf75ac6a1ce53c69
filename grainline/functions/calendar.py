"""Calendar functions: buckets, parts, arithmetic and half-open period filters.

All filters are written as two half-open comparisons on the raw column so that Catalyst pushes them to
the Parquet scan (row-group pruning); no function is wrapped around the filtered column.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainline.plans.model import TimeDimensionColumnError

# Granularities, finest first; a bucket may only be re-bucketed to a later (coarser) entry.
GRANULARITIES = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket(col: Column | str, unit: str) -> Column:
    """the start of the calendar bucket, as DATE for day and coarser, as TIMESTAMP below a day."""
    c = _c(col)
    if unit == "day":
        return F.to_date(c)
    if unit in ("week", "month", "quarter", "year"):
        return F.trunc(c, {"week": "week", "month": "month", "quarter": "quarter", "year": "year"}[unit])
    return custom_bucket(c, unit, 1, "1970-01-01")


def custom_bucket(col: Column | str, base: str, multiple: int, origin: str) -> Column:
    """buckets of ``multiple`` base units counted from ``origin`` (e.g. a fiscal year of 12 months from April).

    Month multiples use ``floor`` so dates before the origin fall into earlier buckets; durations use
    epoch arithmetic on seconds.
    """
    c = _c(col)
    if base in _MONTHS:
        step = multiple * _MONTHS[base]
        o = F.lit(origin).cast("date")
        months = F.floor(F.months_between(F.trunc(c, "month"), o))
        return F.add_months(o, (F.floor(months / step) * step).cast("int"))
    micros = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[base] * multiple * 1_000_000
    # NTZ-native arithmetic: no session time zone is involved (date_trunc would return a zoned TIMESTAMP)
    o = F.lit(origin).cast("timestamp_ntz")
    t = c.cast("timestamp_ntz")
    k = F.floor(F.timestamp_diff("MICROSECOND", o, t) / micros)
    return F.timestamp_add("MICROSECOND", k * micros, o)


def iso_weekday(col: Column | str) -> Column:
    """ISO day of week, Monday 1 .. Sunday 7."""
    return (F.weekday(_c(col)) + 1).cast("long")


def weekday_name(col: Column | str) -> Column:
    """Full weekday name (``Monday``); ``dayname`` would give ``Mon``."""
    return F.date_format(_c(col), "EEEE")


def date_add_unit(col: Column | str, n: int | Column, unit: str) -> Column:
    """Calendar arithmetic by unit."""
    c = _c(col)
    k = n if isinstance(n, Column) else F.lit(n)
    if unit in _MONTHS:
        return F.add_months(c, k * _MONTHS[unit])
    if unit == "day":
        return F.date_add(c, k)
    if unit == "week":
        return F.date_add(c, k * 7)
    return F.timestamp_add(unit.upper(), k, c)


def date_diff_unit(end: Column | str, start: Column | str, unit: str) -> Column:
    """Whole units between two instants (plain meaning: ``timestampdiff``)."""
    return F.timestamp_diff(unit.upper(), _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz"))


_PERIOD = re.compile(r"^(\d{4})(?:-(?:Q([1-4])|(\d{2})(?:-(\d{2}))?))?$")


def period_bounds(literal: str) -> tuple[dt.date, dt.date]:
    """The half-open ``[start, next start)`` of ``'2025'``, ``'2025-Q1'``, ``'2025-03'`` or ``'2025-03-31'``."""
    m = _PERIOD.match(literal.strip())
    if not m:
        raise ValueError(f"not a period literal: {literal!r}")
    y, q, mo, d = m.groups()
    y = int(y)
    if d:
        start = dt.date(y, int(mo), int(d))
        return start, start + dt.timedelta(days=1)
    if mo:
        start = dt.date(y, int(mo), 1)
        return start, _add_months(start, 1)
    if q:
        start = dt.date(y, 3 * (int(q) - 1) + 1, 1)
        return start, _add_months(start, 3)
    return dt.date(y, 1, 1), dt.date(y + 1, 1, 1)


def _add_months(d: dt.date, n: int) -> dt.date:
    k = d.year * 12 + d.month - 1 + n
    return dt.date(k // 12, k % 12 + 1, 1)


def _lit_like(value: dt.date, col_type: str) -> Column:
    return F.lit(value.isoformat()).cast(col_type)


def between_half_open(col: Column | str, start: dt.date, end: dt.date, col_type: str = "date") -> Column:
    c = _c(col)
    return (c >= _lit_like(start, col_type)) & (c < _lit_like(end, col_type))


def in_period(col: Column | str, literal: str, col_type: str = "date") -> Column:
    """``col in '2025-Q1'`` as ``col >= start and col < next start``."""
    start, end = period_bounds(literal)
    return between_half_open(col, start, end, col_type)


def date_range_bounds(date_range: str | tuple[str, str] | list[str]) -> tuple[dt.date, dt.date]:
    """A literal or ``[first, last]``; the pair includes day ``last``."""
    if isinstance(date_range, str):
        return period_bounds(date_range)
    first, last = date_range
    return period_bounds(first)[0], period_bounds(last)[1]


def bucket_start(day: dt.date, unit: str) -> dt.date:
    """The first day of the ``unit`` bucket that holds ``day``."""
    if unit in ("day", "week"):
        return day - dt.timedelta(days=day.weekday() if unit == "week" else 0)
    first = dt.date(day.year, day.month, 1)
    return _add_months(first, -((first.month - 1) % _MONTHS[unit]))


def in_range(col: Column | str, date_range, col_type: str = "date") -> Column:
    start, end = date_range_bounds(date_range)
    return between_half_open(col, start, end, col_type)


def last_complete(col: Column | str, n: int, unit: str, as_of: str, col_type: str = "date") -> Column:
    """The last ``n`` complete ``unit`` periods before ``as_of`` (an explicit anchor, never "now")."""
    anchor = dt.date.fromisoformat(as_of)
    if unit in ("day", "week"):
        cur = anchor - dt.timedelta(days=anchor.weekday() if unit == "week" else 0)
        return between_half_open(col, cur - n * dt.timedelta(days=7 if unit == "week" else 1), cur, col_type)
    step = _MONTHS[unit]
    cur = dt.date(anchor.year, anchor.month, 1)
    cur = _add_months(cur, -((cur.month - 1) % step))  # start of the anchor's (incomplete) period
    return between_half_open(col, _add_months(cur, -n * step), cur, col_type)


def check_rebucket(stored: str, wanted: str) -> None:
    """Only coarser re-bucketing is allowed."""
    if GRANULARITIES.index(wanted) < GRANULARITIES.index(stored):
        raise TimeDimensionColumnError(
            f"column is bucketed by {stored}; it cannot be broken down by {wanted} (finer than its granularity)"
        )
    if stored == "week" and wanted in ("month", "quarter", "year"):
        raise TimeDimensionColumnError("weeks do not nest in months: re-bucketing would mix periods")
