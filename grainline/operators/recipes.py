"""Business recipes composed from the grain and period operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.functions.calendar import bucket
from grainline.functions.scalar import ratio


def basket_flags(lines: DataFrame, key: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """D29 (first half): one row per basket with a 0/1 flag per condition (``max`` over its lines)."""
    return lines.groupBy(*key).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])


def basket_mix(baskets: DataFrame, a: str, b: str, labels: tuple[str, str, str], name: str = "mix") -> DataFrame:
    """Label baskets 'both' / 'only a' / otherwise (the reference's labelling: else = only b)."""
    both, only_a, other = labels
    lab = F.when((F.col(a) == 1) & (F.col(b) == 1), both).when(F.col(a) == 1, only_a).otherwise(other)
    return baskets.withColumn(name, lab)


def attach_rate(baskets: DataFrame, group: Sequence[str], a: str, b: str, n_name: str, rate_name: str) -> DataFrame:
    """Among baskets with ``a``, how many per group and the share that also has ``b``."""
    with_a = baskets.filter(F.col(a) == 1)
    return with_a.groupBy(*group).agg(F.count(F.lit(1)).alias(n_name), (F.sum(b).cast("double") / F.count(F.lit(1))).alias(rate_name))


def first_seen(df: DataFrame, entity: str, ts: str, name: str = "first_at") -> DataFrame:
    """D31 (first half): each entity's first event time."""
    return df.groupBy(entity).agg(F.min(ts).alias(name))


def new_entities(df: DataFrame, entity: str, ts: str, unit: str, period: str = "period", name: str = "new") -> DataFrame:
    """Entities counted in the period of their first-ever event."""
    f = first_seen(df, entity, ts, "__first")
    return f.groupBy(bucket("__first", unit).alias(period)).agg(F.count(F.lit(1)).alias(name))


def returning_entities(df: DataFrame, entity: str, ts: str, unit: str, period: str = "period", name: str = "returning") -> DataFrame:
    """Distinct active entities in a period minus those new in it."""
    active = df.groupBy(bucket(ts, unit).alias(period)).agg(F.count_distinct(entity).alias("__active"))
    new = new_entities(df, entity, ts, unit, period, "__new")
    out = active.join(new, period, "left")
    return out.select(period, (F.col("__active") - F.coalesce(F.col("__new"), F.lit(0))).alias(name))


def unit_cost(components: DataFrame, sku: str, cost: str, name: str = "unit_cost") -> DataFrame:
    """Cost of one unit = sum of its components' costs (bill of materials roll-up)."""
    return components.groupBy(sku).agg(F.sum(cost).alias(name))


def ytd_bounds(facts: DataFrame, ts: str) -> DataFrame:
    """One row with the year-to-date windows ending after the last day with data.

    ``cur = [Jan 1 of the last year, last day + 1)``; ``prev`` is the same window a year earlier. The
    cut-off comes from ``max(ts)`` in Spark (no round trip through the driver).
    """
    last = F.to_date(F.max(ts))
    agg = facts.agg(last.alias("__last"))
    cur_start = F.trunc("__last", "year")
    cur_end = F.date_add("__last", 1)
    return agg.select(
        cur_start.alias("cur_start"),
        cur_end.alias("cur_end"),
        F.add_months(cur_start, -12).alias("prev_start"),
        F.add_months(cur_end, -12).alias("prev_end"),
    )


def comparable_growth(df: DataFrame, value: str, ts: str, opened: str, cutoff_facts: DataFrame) -> DataFrame:
    """Headline and same-store year-to-date totals (in dollars from cents) and their growth.

    Same-store rows belong to entities opened before the prior window starts. One pass over the facts:
    the bounds are scalar subqueries and four filtered sums (D17) are taken together.
    """
    b = ytd_bounds(cutoff_facts, ts)
    t = F.col(ts)
    bound = {c: b.select(F.col(c).cast("timestamp_ntz")).scalar() for c in b.columns}  # merged into one subquery

    def inside(a: str, z: str) -> Column:
        return (t >= bound[a]) & (t < bound[z])

    same = F.col(opened) < bound["prev_start"]
    v = F.col(value)
    agg = df.agg(
        (F.sum(F.when(inside("prev_start", "prev_end"), v)) / 100.0).alias("ytd_prev"),
        (F.sum(F.when(inside("cur_start", "cur_end"), v)) / 100.0).alias("ytd_cur"),
        (F.sum(F.when(same & inside("prev_start", "prev_end"), v)) / 100.0).alias("ss_prev"),
        (F.sum(F.when(same & inside("cur_start", "cur_end"), v)) / 100.0).alias("ss_cur"),
    )
    return agg.select(
        "ytd_prev",
        "ytd_cur",
        (ratio(F.col("ytd_cur"), F.col("ytd_prev")) - 1).alias("headline_growth"),
        "ss_prev",
        "ss_cur",
        (ratio(F.col("ss_cur"), F.col("ss_prev")) - 1).alias("same_store_growth"),
    )
