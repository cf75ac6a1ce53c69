"""Dataset preparation, profiling and invariants.

Each check is an aggregate or an anti/semi join over the whole tables; results are small (one row per
check, per column, per violating key or per gap).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.functions.calendar import bucket
from grainline.operators.periods import spine


def rebase_dates(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], anchor: str) -> dict[str, DataFrame]:
    """Shift date/timestamp columns of several tables by one delta so the latest value falls on ``anchor``.

    The delta (days) comes from one aggregate over all the given columns, inlined as a scalar subquery;
    each table keeps its rows and other columns.
    """
    maxes = None
    for df, cols in tables.values():
        m = df.agg(F.greatest(*[F.to_date(F.max(c)) for c in cols]).alias("__m")) if len(cols) > 1 else df.agg(F.to_date(F.max(cols[0])).alias("__m"))
        maxes = m if maxes is None else maxes.unionByName(m)
    delta = maxes.agg(F.datediff(F.lit(anchor).cast("date"), F.max("__m"))).scalar()
    out = {}
    for name, (df, cols) in tables.items():
        d = df
        for c in cols:
            t = df.schema[c].dataType.typeName()
            if t == "date":
                d = d.withColumn(c, F.date_add(F.col(c), delta))
            else:
                d = d.withColumn(c, F.timestamp_add("DAY", delta, F.col(c)))
        out[name] = d
    return out


def header_vs_lines(header: DataFrame, key: str, amount: str, lines: DataFrame, line_key: str, line_amount: str, tol: float = 0.005) -> DataFrame:
    """Headers whose lines do not add up to the header amount within ``tol`` (lines pre-aggregated per key)."""
    per = lines.groupBy(F.col(line_key).alias("__k")).agg(F.sum(line_amount).alias("lines_total"))
    j = header.select(F.col(key).alias("id"), F.col(amount).alias("header_total")).join(per, F.col("id") == F.col("__k"), "left").drop("__k")
    j = j.withColumn("lines_total", F.coalesce(F.col("lines_total"), F.lit(0)))
    diff = (F.col("header_total") - F.col("lines_total")).cast("double")
    return j.withColumn("diff", diff).where(F.abs(F.col("diff")) > tol)


def census(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named check with its witness count (each DataFrame holds the witnesses)."""
    parts = [df.agg(F.count(F.lit(1)).alias("witnesses")).select(F.lit(name).alias("check"), "witnesses") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar_gaps(spark: SparkSession, df: DataFrame, time_col: str, unit: str, lo: str, hi: str, name: str = "period") -> DataFrame:
    """Buckets of ``[lo, hi]`` with no row (spine anti-joined with the distinct buckets present)."""
    present = df.select(bucket(time_col, unit).alias(name)).distinct()
    return spine(spark, lo, hi, unit, name).join(present, name, "left_anti")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent (``left_anti``)."""
    cond = None
    nn = None
    p = parent.select(*[F.col(k).alias(f"__p_{i}") for i, k in enumerate(pk)])
    for i, k in enumerate(fk):
        c = F.col(k) == F.col(f"__p_{i}")
        cond = c if cond is None else cond & c
        x = F.col(k).isNotNull()
        nn = x if nn is None else nn & x
    return child.where(nn).join(p, cond, "left_anti")


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: rows, non-NULL values, min, max (as text), distinct values and a unique flag.

    Exact: one scan. Every row goes to one grouping set per column and is counted per value before the shuffle; what is left
    of a column are its distinct values with their counts, which a second aggregate sums up. ``exact=False`` uses HyperLogLog
    (``approx_count_distinct``) inside one plain aggregate, without a row for each value.
    """
    cols = list(columns or df.columns)
    n = len(cols)
    if exact:
        sets = df.select(*cols).groupingSets([[F.col(c)] for c in cols], *cols).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__c"))
        of = {c: (1 << n) - 1 - (1 << (n - 1 - i)) for i, c in enumerate(cols)}  # a set's id has a 0 for its own column
        here = {c: F.col("__set") == of[c] for c in cols}
        aggs = [F.sum(F.when(here[cols[0]], F.col("__c"))).alias("__rows")]
        for i, c in enumerate(cols):
            known = here[c] & F.col(c).isNotNull()
            aggs += [F.coalesce(F.sum(F.when(known, F.col("__c"))), F.lit(0)).alias(f"__n{i}"), F.count(F.when(known, 1)).alias(f"__d{i}")]
            aggs += [F.min(c).cast("string").alias(f"__min{i}"), F.max(c).cast("string").alias(f"__max{i}")]
        one = sets.agg(*aggs).withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    else:
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, c in enumerate(cols):
            aggs += [F.count(c).alias(f"__n{i}"), F.min(c).cast("string").alias(f"__min{i}"), F.max(c).cast("string").alias(f"__max{i}"), F.approx_count_distinct(c).alias(f"__d{i}")]
        one = df.agg(*aggs)
    per_column = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"__n{i}").alias("non_null"),
            F.col(f"__min{i}").alias("min_value"),
            F.col(f"__max{i}").alias("max_value"),
            F.col(f"__d{i}").alias("distinct_values"),
        )
        for i, c in enumerate(cols)
    ]
    out = one.select(F.col("__rows").alias("rows"), F.explode(F.array(*per_column)).alias("s")).select("rows", "s.*")
    return out.withColumn("is_unique", (F.col("distinct_values") == F.col("non_null")) & (F.col("non_null") == F.col("rows")))


def low_cardinality(df: DataFrame, candidates: Sequence[str], most: int = 50) -> str | None:
    """The candidate with the fewest values, of those with two to ``most``, from one pass of sketches; None if none has."""
    if not candidates:
        return None
    found = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(candidates)]).first()  # one row
    few = [(found[i], i) for i in range(len(candidates)) if 2 <= found[i] <= most]
    return candidates[min(few)[1]] if few else None


def averages_by_low_cardinality(df: DataFrame, values: Sequence[str], candidates: Sequence[str] | None = None, most: int = 50) -> DataFrame:
    """Rows and averages of ``values`` per value of the column with the fewest (by default of the text columns), and over all.

    Two scans: sketches choose the column, then one aggregate over the grouping sets (column) and (). ``column`` names it;
    ``is_total`` marks the row over all.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"] if candidates is None else list(candidates)
    chosen = low_cardinality(df, texts, most)
    means = [F.avg(v).cast("double").alias(f"avg_{v}") for v in values]
    count = F.count(F.lit(1)).alias("rows")
    if chosen is None:
        return df.agg(count, *means).select(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_total"), "rows", *[f"avg_{v}" for v in values])
    sets = df.groupingSets([[F.col(chosen)], []], chosen).agg(F.grouping_id().alias("__set"), count, *means)
    return sets.select(F.lit(chosen).alias("column"), F.col(chosen).cast("string").alias("value"), (F.col("__set") == 1).alias("is_total"), "rows", *[f"avg_{v}" for v in values])


def allocate(df: DataFrame, key: str, cents: Column, parts: Column, name: str = "part_cents") -> DataFrame:
    """Split an amount in cents into ``parts`` positive parts that add up exactly.

    Every part gets ``amount div n``; the last part also gets the remainder. Deterministic (the
    reference cuts at random points; only the exact-sum property is kept).
    """
    base = df.select(F.col(key), cents.cast("long").alias("__c"), parts.cast("int").alias("__n")).where(F.col("__n") > 0)
    ex = base.select(key, "__c", "__n", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("part_no"))
    share = F.floor(F.col("__c") / F.col("__n"))
    last = F.col("part_no") == F.col("__n")
    amount = F.when(last, F.col("__c") - share * (F.col("__n") - 1)).otherwise(share)
    return ex.select(key, F.col("part_no").cast("long").alias("part_no"), amount.cast("long").alias(name))


def value_sample(df: DataFrame, columns: Sequence[str], limit: int = 50, sep: str = ", ") -> DataFrame:
    """Per column, its distinct non-NULL values in order as text, or ``'<limit>+ distinct'``.

    Each column's distinct values are reduced (map-side), ordered and cut to ``limit + 1`` (a top-k, so
    each task keeps only that many) before they are gathered; nothing unbounded reaches one task.
    """
    parts = []
    for c in columns:
        top = df.select(F.col(c).alias("__v")).where(F.col("__v").isNotNull()).distinct().orderBy("__v").limit(limit + 1)
        ordered = F.array_sort(F.collect_list("__v"))
        text = F.array_join(F.transform(ordered, lambda x: x.cast("string")), sep)
        parts.append(
            top.agg(F.count(F.lit(1)).alias("__n"), text.alias("__t")).select(
                F.lit(c).alias("column"), F.when(F.col("__n") > limit, F.lit(f"{limit}+ distinct")).otherwise(F.col("__t")).alias("sample_values")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
