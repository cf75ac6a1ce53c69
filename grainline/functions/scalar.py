"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def band(col: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """``labels[i]`` for ``edges[i-1] <= x < edges[i]``; the last label above the last edge.

    NULL input falls to the last label like a SQL ``CASE`` with ``ELSE``.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    c = _c(col)
    expr = F.when(c < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        expr = expr.when(c < edge, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def ratio(a: Column, b: Column) -> Column:
    """Double division of two aggregates; NULL for a zero denominator (as SQL engines without ANSI errors).

    Both engines give the IEEE quotient of the same operands, so exact inputs give identical results.
    """
    return F.try_divide(a.cast("double"), b.cast("double"))


def dollars(cents: Column | str) -> Column:
    """Integer cents to dollars."""
    return _c(cents).cast("double") / 100.0


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_WHEN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"


def _instant_text(ts: Column) -> Column:
    """A wall-clock time as ISO text; midnight is the date alone."""
    midnight = F.date_format(ts, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    return F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def normalize_value(col: Column | str, kind: str) -> Column:
    """The canonical comparable text of a value column.

    ``kind`` is the column's Spark type name: numbers become DOUBLE text with NaN as NULL; text that is a
    plain decimal number becomes that number; ``YYYY-MM`` text becomes its first day; date-times, also in
    text, become ISO text in UTC, at midnight the date alone.
    """
    c = _c(col)
    if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"):
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(None)).otherwise(d).cast("string")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "timestamp_ntz":
        return _instant_text(c)
    if kind == "timestamp":
        return _instant_text(F.to_utc_timestamp(c, F.current_timezone()))
    if kind == "boolean":
        return c.cast("string")
    s = F.trim(c)
    zoned = F.to_utc_timestamp(s.try_cast("timestamp"), F.current_timezone())
    return (
        F.when(s.rlike(_NUMBER), s.try_cast("double").cast("string"))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01")))
        .when(s.rlike(_WHEN + "$"), F.coalesce(_instant_text(s.try_cast("timestamp_ntz")), c))
        .when(s.rlike(_WHEN + r"\s?(Z|[+-]\d{2}:?\d{2})$"), F.coalesce(_instant_text(zoned), c))
        .otherwise(c)
    )
