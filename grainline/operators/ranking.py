"""Ranking, top-n and tiles.

``rank`` filters on a partitioned window become ``WindowGroupLimit`` in Spark's physical plan: each map
task keeps only its top rows per group before the shuffle, so top-n per group stays cheap even when a
group is huge. Tiles over a whole, growing population (E8/E14) must not use an unpartitioned window
(one task would sort everything); ``ntile_global`` computes the same tile numbers from a range-
partitioned sort plus per-partition counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from grainline.functions.scalar import ratio
from grainline.plans.model import MetricResult, ResultWarning
from grainline.session import ensure_checkpoint_dir


def _order(value: str, direction: str, tiebreak: Sequence[str] = ()) -> list[Column]:
    v = F.col(value)
    cols = [v.desc() if direction == "desc" else v.asc()]
    return cols + [F.col(t).asc() for t in tiebreak]


def rank_within(df: DataFrame, value: str, partition_by: Sequence[str] = (), direction: str = "desc", name: str = "rank") -> DataFrame:
    """Competition rank (ties share a rank) of ``value`` within ``partition_by``.

    With an empty ``partition_by`` the window is global: use it on aggregated series only.
    """
    w = Window.partitionBy(*partition_by).orderBy(*_order(value, direction))
    return df.withColumn(name, F.rank().over(w).cast("long"))


def top_n_per_group(df: DataFrame, value: str, partition_by: Sequence[str], n: int, direction: str = "desc", name: str = "__rk") -> DataFrame:
    """Rows whose rank within the group is at most ``n`` (ties kept); planned as WindowGroupLimit."""
    ranked = rank_within(df, value, partition_by, direction, name)
    out = ranked.filter(F.col(name) <= n)
    return out.drop(name) if name.startswith("__") else out


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """0-based position of every row in the total order, without a single-partition window.

    Rows are range-partitioned and sorted (``orderBy``); ``monotonically_increasing_id`` encodes
    (partition, position); one count per partition gives each partition's offset. The sorted rows are
    checkpointed, once: the counts and the rows must come from the same evaluation, since two plans of the
    same sort, pruned to other columns, draw other partition bounds. Ties are placed arbitrarily, as in
    SQL. Also adds ``__total`` (the row count).
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("__grn_id", F.monotonically_increasing_id()).checkpoint()
    ordered = ordered.withColumn("__grn_part", F.shiftright(F.col("__grn_id"), 33)).withColumn(
        "__grn_pos", F.col("__grn_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = ordered.groupBy("__grn_part").agg(F.count(F.lit(1)).alias("__grn_cnt"))
    w = Window.orderBy("__grn_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__grn_part",
        F.coalesce(F.sum("__grn_cnt").over(w), F.lit(0)).alias("__grn_off"),
        F.sum("__grn_cnt").over(Window.partitionBy(F.lit(1))).alias("__total"),
    )
    out = ordered.join(F.broadcast(offsets), "__grn_part")  # one row per partition
    return out.withColumn(name, F.col("__grn_off") + F.col("__grn_pos")).drop("__grn_id", "__grn_part", "__grn_pos", "__grn_off")


def ntile_global(df: DataFrame, order: Sequence[Column], n: int, name: str = "tile") -> DataFrame:
    """SQL ``ntile(n) over (order by ...)`` computed from ``global_row_number``.

    With ``N`` rows, ``q, m = divmod(N, n)``: the first ``m`` tiles hold ``q + 1`` rows, the rest ``q`` (S17).
    """
    numbered = global_row_number(df, order, "__r")
    r = F.col("__r")
    q = F.floor(F.col("__total") / n)
    m = F.col("__total") % n
    big = m * (q + 1)  # rows held by the larger tiles
    tile = F.when(r < big, F.floor(r / (q + 1)) + 1).otherwise(F.floor((r - big) / F.greatest(q, F.lit(1))) + m + 1)
    return numbered.withColumn(name, tile.cast("long")).drop("__r", "__total")


def top_share(
    df: DataFrame, value: str, n_tiles: int = 10, share_name: str = "top_share", count_name: str = "top_count", key: str | None = None
) -> DataFrame:
    """Share of the total held by the first tile (highest values) and its number of rows.

    One row out; the first tile is the top ``ceil(N / n)`` rows by ``value`` (SQL ``ntile``). Ties are
    broken by ``key`` when given, so a retried task assigns the same positions (the sum is the same
    whichever tied rows are taken).
    """
    order = [F.col(value).desc()] + ([F.col(key).asc()] if key else [])
    tiled = ntile_global(df.select(value, *([key] if key else [])), order, n_tiles, "__tile")
    top = F.col("__tile") == 1
    return tiled.agg(
        ratio(F.sum(F.when(top, F.col(value))), F.sum(value)).alias(share_name),
        F.count(F.when(top, 1)).alias(count_name),
    )


def best_vs_avg(s: DataFrame, group: Sequence[str], value: str, name_avg: str = "avg_value", name_above: str = "above_avg") -> DataFrame:
    """Each group's best period(s) (rank 1, ties kept) with the group's mean and the excess over it."""
    avg = s.groupBy(*group).agg((F.sum(value).cast("double") / F.count(F.lit(1))).alias(name_avg))
    best = top_n_per_group(s, value, group, 1)
    out = best.join(avg, list(group), "left")
    return out.withColumn(name_above, ratio(F.col(value), F.col(name_avg)) - 1)


def order_limit(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0, drop: Sequence[str] = ()) -> DataFrame:
    """Order by (possibly hidden) columns, offset, limit, then drop the hidden ones.

    ``orderBy + limit`` is planned as ``TakeOrderedAndProject``: each task keeps its top rows only.
    """
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.drop(*drop) if drop else out


def bounded(df: DataFrame, n: int) -> MetricResult:
    """At most ``n`` rows and a ``truncated`` warning when more exist.

    Reads ``n + 1`` rows (a limit, not a count of the whole result).
    """
    probe = df.limit(n + 1)
    more = probe.count() > n
    out = df.limit(n)
    warnings = [ResultWarning("truncated", f"showing first {n} rows")] if more else []
    return MetricResult(out, warnings)


def percentile_by_rank(df: DataFrame, group: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """D8/D9 at scale: the exact interpolated percentile (``percentile_cont``) of ``value`` per group.

    An exact percentile aggregate keeps every distinct value of a group in one task's memory; here
    rows are ranked inside their group from a range-partitioned sort (position minus the group's first
    position, both distributed), and only the two rows around ``p * (n - 1)`` per group are aggregated.
    NULL values are ignored, as by the aggregate.
    """
    v = df.select(*group, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    numbered = global_row_number(v, [*[F.col(g).asc_nulls_first() for g in group], F.col("__v").asc()], "__pos").drop("__total")
    stats = numbered.groupBy(*group).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    renamed = stats.select(*[F.col(g).alias(f"__g_{g}") for g in group], "__first", "__n")
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    ranked = numbered.join(renamed, cond).withColumn("__r", F.col("__pos") - F.col("__first"))
    pos = F.lit(p) * (F.col("__n") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    near = ranked.where((F.col("__r") == lo) | (F.col("__r") == hi))
    agg = near.groupBy(*group).agg(
        F.max(F.when(F.col("__r") == lo, F.col("__v"))).cast("double").alias("__lo"),
        F.max(F.when(F.col("__r") == hi, F.col("__v"))).cast("double").alias("__hi"),
        F.first(pos).alias("__p"),
    )
    frac = F.col("__p") - F.floor(F.col("__p"))
    return agg.select(*group, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).alias(name))
