"""Aggregate functions (D1-D17): the engine's list mapped to Spark built-ins, plus templates and guards.

Every aggregate here is a Catalyst aggregate, so it runs as a partial (map-side) plus final
``HashAggregate``/``ObjectHashAggregate`` pair. ``median``/``percentile`` are exact and keep a buffer per
group; ``percentile_approx`` is the bounded-memory alternative for very large groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_rows() -> Column:
    """D3: ``count(*)``."""
    return F.count(F.lit(1))


def weighted_avg(value: Column | str, weight: Column | str | None = None) -> Column:
    """``sum(v*w) / sum(w)`` over rows with a value; the default weight is 1 (plain mean).

    Products and sums keep the input types (exact for decimals and integers); only the final quotient
    is taken in DOUBLE.
    """
    v = _c(value)
    w = F.lit(1) if weight is None else _c(weight)
    num = F.sum(F.when(v.isNotNull(), v * w))
    den = F.sum(F.when(v.isNotNull(), w))
    return num.cast("double") / den.cast("double")


def agg_template(template: Callable[[Column], Column]) -> Callable[[Column | str], Column]:
    """A custom aggregation given as a Column formula, e.g. ``lambda v: F.sum(v) / 100.0``."""
    return lambda value: template(_c(value))


def agg_if(fn: Callable[[Column], Column], value: Column | str, cond: Column) -> Column:
    """A filtered aggregate, ``fn(x) FILTER (WHERE cond)``; rows failing ``cond`` add NULL."""
    return fn(F.when(cond, _c(value)))


def first_by_time(value: Column | str, time: Column | str) -> Column:
    """The value at the earliest time (``arg_min``)."""
    return F.min_by(_c(value), _c(time))


def last_by_time(value: Column | str, time: Column | str) -> Column:
    """The value at the latest time (``arg_max``)."""
    return F.max_by(_c(value), _c(time))


# Name -> builder, one per aggregate the reference's engine lists (D1-D14). A two-argument entry takes
# (value, other) - a weight, a time column or a second variable.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": lambda v: F.sum(_c(v)),
    "avg": lambda v: F.avg(_c(v)),
    "count": lambda v=None: count_rows() if v is None else F.count(_c(v)),
    "count_distinct": lambda v: F.count_distinct(_c(v)),
    "count_distinct_approx": lambda v, rsd=0.05: F.approx_count_distinct(_c(v), rsd),
    "min": lambda v: F.min(_c(v)),
    "max": lambda v: F.max(_c(v)),
    "median": lambda v: F.median(_c(v)),
    "percentile": lambda v, p=0.5: F.percentile(_c(v), p),
    "percentile_approx": lambda v, p=0.5, acc=10000: F.percentile_approx(_c(v), p, acc),
    "first": first_by_time,
    "last": last_by_time,
    "stddev_pop": lambda v: F.stddev_pop(_c(v)),
    "stddev_samp": lambda v: F.stddev_samp(_c(v)),
    "var_pop": lambda v: F.var_pop(_c(v)),
    "var_samp": lambda v: F.var_samp(_c(v)),
    "corr": lambda a, b: F.corr(_c(a), _c(b)),
    "covar_pop": lambda a, b: F.covar_pop(_c(a), _c(b)),
    "covar_samp": lambda a, b: F.covar_samp(_c(a), _c(b)),
    "weighted_avg": weighted_avg,
}


def aggregate(name: str, *args, **kwargs) -> Column:
    if name not in AGGREGATES:
        from grainline.plans.model import UnknownReferenceError

        raise UnknownReferenceError(f"unknown aggregation {name!r}")
    return AGGREGATES[name](*args, **kwargs)
