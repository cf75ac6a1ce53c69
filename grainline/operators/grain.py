"""Grain-safe aggregation.

Rules that keep numbers right when tables fan out:

* every measure is aggregated at its own model's grain, then joined on the shared dimensions with
  NULL-safe equality (S8, S9);
* coarser-grain totals are computed from an aggregate at that grain and joined back, not by a window
  over all groups: a window partitioned by a low-cardinality key puts a whole partition in one task,
  while the aggregate is pre-combined map-side and its (small) result is broadcast at runtime by AQE;
* a grand total is a scalar subquery (one aggregate, inlined as a value) instead of an unpartitioned
  window;
* non-additive totals (distinct counts) are recounted from the base rows, never added up (S15).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.functions.scalar import ratio
from grainline.plans.model import MetricResult, ReaggregationError, ResultWarning


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """C14: join on ``on`` with ``<=>`` so that a NULL dimension value matches itself; keeps left's keys."""
    if not on:
        raise ValueError("null_safe_join needs join keys; a grand total is a scalar (with_total with no partition)")
    renamed = right
    for k in on:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in on:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__r_{k}" for k in on])


def aggregate(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Plain grouped aggregate; a query with no measures returns the distinct dimension values (B1)."""
    if not measures:
        return df.select(*dims).distinct()
    cols = [c.alias(n) for n, c in measures.items()]
    return df.groupBy(*dims).agg(*cols) if dims else df.agg(*cols)


def with_total(
    grouped: DataFrame,
    totals: Mapping[str, Column],
    partition_by: Sequence[str],
    source: DataFrame | None = None,
) -> DataFrame:
    """Attach totals at the coarser grain ``partition_by`` to every row of ``grouped``.

    ``totals`` are aggregate Columns evaluated over ``source`` (the base rows, default ``grouped``)
    grouped by ``partition_by``; use the base rows for non-additive measures (distinct counts). An
    empty ``partition_by`` is the grand total (one broadcast row).
    """
    src = grouped if source is None else source
    if not partition_by:
        # a scalar subquery per total: computed once (Catalyst merges those over the same input) and
        # inlined as a value - no join, no single-partition window
        out = grouped
        for n, c in totals.items():
            out = out.withColumn(n, src.agg(c.alias(n)).scalar())
        return out
    agg = aggregate(src, partition_by, totals)
    return null_safe_join(grouped, agg, partition_by, "left")


def share(grouped: DataFrame, value: str, partition_by: Sequence[str], name: str) -> DataFrame:
    """``value / sum(value) over partition_by`` (additive measure), as DOUBLE."""
    tot = f"__tot_{name}"
    out = with_total(grouped, {tot: F.sum(value)}, partition_by)
    return out.withColumn(name, ratio(F.col(value), F.col(tot))).drop(tot)


def calc_dim_rollup(
    df: DataFrame,
    entity: str,
    entity_total: Column,
    classify: Callable[[Column], Column],
    dim_name: str,
    additive: Mapping[str, tuple[Column, str]],
    null_label=None,
) -> DataFrame:
    """A dimension computed from an entity-level aggregate (e.g. spend band), then measures by it.

    Rows are first aggregated per entity (map-side combined, so a hot entity - even the NULL entity - is
    no straggler); the dimension is derived from the entity total; additive measures are re-aggregated.
    ``additive`` maps output name -> (inner aggregate, outer function name: 'sum' | 'min' | 'max').
    Rows whose entity is NULL get ``null_label`` (the ``else`` branch of the classification).
    """
    inner = df.groupBy(entity).agg(entity_total.alias("__entity_total"), *[c.alias(n) for n, (c, _) in additive.items()])
    label = classify(F.col("__entity_total"))
    dim = label if null_label is None else F.when(F.col(entity).isNull(), F.lit(null_label)).otherwise(label)
    outer = {"sum": F.sum, "min": F.min, "max": F.max}
    return inner.withColumn(dim_name, dim).groupBy(dim_name).agg(*[outer[f](n).alias(n) for n, (_, f) in additive.items()])


def reaggregate(
    df: DataFrame,
    inner_dims: Sequence[str],
    inner: Column,
    outer_dims: Sequence[str],
    outer: Callable[[Column], Column],
    name: str,
) -> MetricResult:
    """``outer(inner at inner_dims)`` by ``outer_dims``; warns when the grains coincide."""
    warnings = []
    if set(inner_dims) == set(outer_dims):
        warnings.append(ResultWarning("degenerate_reaggregation", "degenerate re-aggregation: inner grain equals the outer"))
    level = df.groupBy(*inner_dims).agg(inner.alias("__inner"))
    res = level.groupBy(*outer_dims).agg(outer(F.col("__inner")).alias(name))
    return MetricResult(res, warnings)


def multi_fact(population: DataFrame, dims: Sequence[str], facts: Sequence[DataFrame]) -> DataFrame:
    """Facts aggregated at their own grain, aligned on ``dims`` of the root's population.

    ``population`` holds the root's dimension values (duplicates are removed); each fact is an
    aggregate keyed by ``dims``. NULL dimension values match each other (S8).
    """
    out = population.select(*dims).distinct() if dims else population
    for f in facts:
        out = null_safe_join(out, f, dims, "left")
    return out


def sum_once(
    child: DataFrame,
    child_key: str,
    child_measures: Mapping[str, Column],
    parent: DataFrame,
    parent_key: str,
    dims: Sequence[str],
    parent_measures: Mapping[str, Column],
    child_outer: Mapping[str, str] | None = None,
) -> DataFrame:
    """Measures of the one side asked from the many side count each parent once.

    The child is pre-aggregated per parent key (one row per parent), joined 1:1 to the parent, then
    grouped by ``dims``; child measures are re-aggregated with ``child_outer`` (default ``sum``).
    """
    per_parent = child.groupBy(child_key).agg(*[c.alias(n) for n, c in child_measures.items()])
    joined = parent.join(per_parent, F.col(parent_key) == F.col(child_key), "inner")
    outer = child_outer or {}
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    cols = [c.alias(n) for n, c in parent_measures.items()]
    cols += [fns[outer.get(n, "sum")](n).alias(n) for n in child_measures]
    return joined.groupBy(*dims).agg(*cols)


def associate(df: DataFrame, dims: Sequence[str], entity_key: str, value: str, name: str) -> MetricResult:
    """An entity's value counted once per dimension value (``max`` per (dims, entity), then summed)."""
    once = df.groupBy(*dims, entity_key).agg(F.max(value).alias("__v"))
    res = once.groupBy(*dims).agg(F.sum("__v").alias(name))
    msg = f"{name} is associated over {', '.join(dims)}: an entity may count under several values, totals overlap"
    return MetricResult(res, [ResultWarning("associated", msg)])


def broadcast_total(dims_df: DataFrame, dims: Sequence[str], total: DataFrame, name: str) -> MetricResult:
    """A one-row total repeated on every dimension value (a scalar subquery), with a warning."""
    res = dims_df.select(*dims).distinct().withColumn(name, total.select(F.col(total.columns[0])).scalar())
    msg = f"{name} cannot be split by {', '.join(dims)}; the same total is broadcast across every row"
    return MetricResult(res, [ResultWarning("broadcast", msg)])


def refuse_unattributable(measure: str, dims: Sequence[str]) -> None:
    """Error mode of an unattributable dimension."""
    raise ReaggregationError(f"{measure} cannot be attributed to {', '.join(dims)}: the path fans out")


def unattributable(
    mode: str, df: DataFrame, dims: Sequence[str], entity_key: str, value: str, name: str, total: DataFrame | None = None
) -> MetricResult:
    """A measure of a parent asked by a dimension the parent cannot be attributed to.

    ``mode`` is the ``to_many_handling`` choice: ``'associate'`` (each entity once per dimension value,
    warns), ``'broadcast'`` (the parent total repeated on every value, warns; ``total`` is its one-row
    aggregate) or ``'error'`` (refuses).
    """
    if mode == "associate":
        return associate(df, dims, entity_key, value, name)
    if mode == "broadcast":
        if total is None:
            total = df.dropDuplicates([entity_key]).agg(F.sum(value))
        return broadcast_total(df, dims, total, name)
    if mode == "error":
        refuse_unattributable(name, dims)
    raise ValueError(f"unknown to_many_handling {mode!r}")


def eager_aggregate(
    fact: DataFrame,
    key: str,
    lookup: DataFrame,
    lookup_key: str,
    dims: Sequence[str],
    partials: Mapping[str, Column],
    finals: Mapping[str, Column],
    local_dims: Sequence[str] = (),
) -> DataFrame:
    """Aggregate below a many-to-one join (eager aggregation), then finish by the looked-up dimensions.

    ``partials`` are distributive aggregates of the fact rows per (``key``, ``local_dims``); the result,
    one row per key instead of one per fact row, is left-joined to ``lookup`` (its attributes for that
    key) and ``finals`` - aggregates over partial names and lookup columns - are taken by ``dims``.
    The join then shuffles about one row per key and period rather than every fact row. Fact rows with a
    NULL key form one partial row and get NULL attributes, as in a row-level left join.
    """
    pre = fact.groupBy(key, *local_dims).agg(*[c.alias(n) for n, c in partials.items()])
    lk = lookup.withColumnRenamed(lookup_key, "__lk")
    joined = pre.join(lk, F.col(key) == F.col("__lk"), "left")
    return joined.groupBy(*dims).agg(*[c.alias(n) for n, c in finals.items()])
