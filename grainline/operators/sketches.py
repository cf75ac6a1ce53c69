"""Mergeable states: distinct counts (HyperLogLog) and quantiles (KLL) at a fine grain, merged for coarser ones.

A state is a bounded sketch per (day, dimensions), built map-side. Coarser grains and rolling windows merge states - never
the facts - so a fact is read once whatever is asked of it later, and a 90-day window multiplies days, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.functions.calendar import bucket
from grainline.operators import periods

#: Registers of a distinct sketch, 2 to this power: a standard error of about 1.04 / sqrt(2 ** 12) = 1.6 %.
LG_K = 12
#: Size of a quantile sketch: a normalized rank error of about 1.33 % at 99 % confidence for one quantile.
KLL_K = 200
KLL_RANK_ERROR = 0.0133


def distinct_states(df: DataFrame, time_col: str, dims: Sequence[str], column: str, lg_k: int = LG_K) -> DataFrame:
    """(day, dims.., state): which values of ``column`` a day has, NULL left out."""
    rows = df.select(F.to_date(time_col).alias("day"), *dims, F.col(column).alias("__v"))
    return rows.groupBy("day", *dims).agg(F.hll_sketch_agg("__v", lg_k).alias("state"))


def distinct_at(states: DataFrame, unit: str | None, dims: Sequence[str], name: str = "n", period: str = "period") -> DataFrame:
    """Distinct values per bucket of ``unit`` (None: over all time) and ``dims``, from merged states."""
    grain = [bucket("day", unit).alias(period)] if unit else []
    return states.groupBy(*grain, *dims).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias(name))


def rolling_distinct(states: DataFrame, unit: str, window: str, date_range=None, name: str = "n", period: str = "period") -> DataFrame:
    """Distinct values of the window before the end of every bucket: days, already merged over their dimensions, meet buckets."""
    days = states.groupBy("day").agg(F.hll_union_agg("state").alias("state"))
    out = periods.rolling(days, "day", unit, window, {"state": F.hll_union_agg}, {"state": "state"}, date_range=date_range, name=period)
    return out.select(period, F.hll_sketch_estimate("state").alias(name))


def quantile_states(df: DataFrame, time_col: str, dims: Sequence[str], column: str, k: int = KLL_K) -> DataFrame:
    """(day, dims.., state): how a day's values of ``column`` are distributed, NULL left out."""
    rows = df.select(F.to_date(time_col).alias("day"), *dims, F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    return rows.groupBy("day", *dims).agg(F.kll_sketch_agg_double("__v", k).alias("state"))


def quantiles_at(states: DataFrame, unit: str | None, dims: Sequence[str], ranks: Sequence[float], period: str = "period") -> DataFrame:
    """(period, dims.., rank, value): values at normalized ranks per bucket, from merged states; the rank is off by about
    ``KLL_RANK_ERROR`` at most."""
    grain = [bucket("day", unit).alias(period)] if unit else []
    merged = states.groupBy(*grain, *dims).agg(F.kll_merge_agg_double("state").alias("state"))
    keys = [*([period] if unit else []), *dims]
    at: Column = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_double("state", F.lit(r)).alias("value")) for r in ranks]))
    return merged.select(*keys, at.alias("q")).select(*keys, "q.rank", "q.value")


def rank_errors(df: DataFrame, time_col: str, unit: str | None, dims: Sequence[str], column: str, quantiles: DataFrame, period: str = "period") -> DataFrame:
    """``quantiles`` with ``rank_error``: how far each value's true rank range in the facts is from the rank asked for."""
    keys = [*([period] if unit else []), *dims]
    grain = [bucket(time_col, unit).alias(period)] if unit else []
    facts = df.select(*grain, *dims, F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    listed = quantiles.groupBy(*keys).agg(F.collect_list(F.struct("rank", "value")).alias("__q"))  # a handful per group
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"q.{c}"))
    # facts are counted per distinct value first; each value then meets its group's few quantiles
    per_value = facts.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    met = per_value.alias("f").join(listed.alias("q"), same).select(*[F.col(f"f.{c}").alias(c) for c in keys], "__v", "__n", F.explode("__q").alias("__a"))
    at = met.groupBy(*keys, F.col("__a.rank").alias("rank"), F.col("__a.value").alias("value")).agg(
        F.sum(F.when(F.col("__v") < F.col("__a.value"), F.col("__n")).otherwise(0)).alias("__below"),
        F.sum(F.when(F.col("__v") <= F.col("__a.value"), F.col("__n")).otherwise(0)).alias("__upto"),
        F.sum("__n").alias("__all"),
    )
    low, high = F.col("__below") / F.col("__all"), F.col("__upto") / F.col("__all")
    return at.select(*keys, "rank", "value", F.greatest(F.lit(0.0), low - F.col("rank"), F.col("rank") - high).alias("rank_error"))
