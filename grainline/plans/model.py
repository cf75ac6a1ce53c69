"""Models over DataFrames: keys, declared joins, time column, saved measures; warnings and refusals.

A ``Model`` is metadata around a DataFrame; nothing here runs a job. ``Catalog.attach`` follows declared
many-to-one joins and adds the requested columns with left joins (C1, C2). Reverse edges (one-to-many)
are implied and are never attached: a measure from the many side is aggregated at its own grain first
(``grainline.operators.grain``), and a filter across it is existential (``grainline.operators.relations``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.plans.sizing import bounded_broadcast


class UnknownReferenceError(ValueError):
    """A column, model or path that the model does not declare."""


class TimeDimensionColumnError(ValueError):
    """A time dimension asked finer than the granularity it is stored at."""


class ReaggregationError(ValueError):
    """A measure that cannot be attributed to the requested dimension (one-to-many path)."""


class AggregationNotAllowedError(ValueError):
    """An aggregation that the column's metadata forbids."""


# Warning kinds, in the order the reference's classifier tries them (fixed values).
WARNING_KINDS = (
    "truncated",
    "broadcast",
    "associated",
    "degenerate_reaggregation",
    "semi_join_pushed",
    "statement_timeout_skipped",
    "normalization",
    "whole_periods_non_nesting",
)


@dataclass(frozen=True)
class ResultWarning:
    kind: str
    message: str


@dataclass
class MetricResult:
    """A result DataFrame plus the warnings its construction raised."""

    df: DataFrame
    warnings: list[ResultWarning] = field(default_factory=list)

    def kinds(self) -> list[str]:
        return [w.kind for w in self.warnings]


@dataclass(frozen=True)
class Join:
    target: str
    pairs: tuple[tuple[str, str], ...]
    cardinality: str = "many_to_one"


@dataclass(frozen=True)
class Measure:
    """A saved, named aggregate formula (D27); ``build`` returns the aggregate Column."""

    name: str
    build: Callable[[], Column]

    def col(self) -> Column:
        return self.build().alias(self.name)


@dataclass(frozen=True)
class Model:
    name: str
    df: DataFrame
    key: tuple[str, ...]
    joins: Mapping[str, Join] = field(default_factory=dict)
    time_col: str | None = None  # the default time column (F6)
    within: Callable[[object], DataFrame] | None = None  # the rows of a date range on ``time_col``, pruned in the scan
    max_rows: int | None = None  # a data-independent row bound (allows a broadcast)
    buckets: Mapping[str, str] = field(default_factory=dict)  # stored granularity of bucketed time columns
    allowed_aggs: Mapping[str, frozenset[str]] = field(default_factory=dict)
    measures: Mapping[str, Measure] = field(default_factory=dict)

    def scan(self, date_range=None, column: str | None = None) -> DataFrame:
        """The rows, or those of a date range on ``column`` (default: the model's time column)."""
        column = column or self.time_col
        if date_range is None:
            return self.df
        if column is None:
            raise UnknownReferenceError(f"model {self.name!r} has no time column")
        if self.within is not None and column == self.time_col:
            return self.within(date_range)
        from grainline.functions.calendar import in_range

        return self.df.where(in_range(column, date_range))

    def extend(self, columns: Mapping[str, Column] | None = None, joins: Mapping[str, Join] | None = None) -> Model:
        """An immutable copy with extra derived columns and/or joins for one query (B2, C17)."""
        df = self.df
        for name, expr in (columns or {}).items():
            df = df.withColumn(name, expr)
        return replace(self, df=df, joins={**self.joins, **(joins or {})})

    def column(self, name: str) -> Column:
        if name not in self.df.columns:
            raise UnknownReferenceError(f"unknown column {name!r} in model {self.name!r}")
        return F.col(name)

    def _by_time(self) -> Column:
        """Where a row stands in time, the key deciding between equal times; null without a time."""
        if self.time_col is None:
            raise UnknownReferenceError(f"model {self.name!r} has no time column")
        return F.when(F.col(self.time_col).isNotNull(), F.struct(self.time_col, *self.key))

    def first(self, column: str) -> Column:
        """The column's value at the model's earliest time."""
        from grainline.functions.aggregates import first_by_time

        return first_by_time(column, self._by_time())

    def last(self, column: str) -> Column:
        """The column's value at the model's latest time."""
        from grainline.functions.aggregates import last_by_time

        return last_by_time(column, self._by_time())

    def series(self, unit: str, measures: Mapping[str, Column], date_range=None, dims: Sequence[str] = (), name: str = "period", filled: Sequence[str] | None = None) -> DataFrame:
        """Measures by calendar bucket of the default time column (F6), of a date range where one is given.

        With ``filled`` every bucket of the range appears (F3), the measures named in it as 0 where there are no rows.
        """
        from grainline.functions.calendar import bucket_start, date_range_bounds
        from grainline.operators import periods

        if self.time_col is None:
            raise UnknownReferenceError(f"model {self.name!r} has no time column")
        rows = self.scan(date_range)
        out = periods.series(rows, self.time_col, unit, list(dims), measures, name=name)
        if filled is None:
            return out
        if date_range is None:
            raise ValueError("a filled series needs a date range")
        start, end = date_range_bounds(date_range)
        last = end - dt.timedelta(days=1)
        return periods.fill_periods(out, rows.sparkSession, name, bucket_start(start, unit), last, unit, list(filled), rows.select(*dims) if dims else None)

    def check_agg(self, column: str, agg: str) -> None:
        """Refuse an aggregation the column does not allow."""
        allowed = self.allowed_aggs.get(column)
        if allowed is not None and agg not in allowed:
            raise AggregationNotAllowedError(f"{agg}({column}) is not allowed; allowed: {sorted(allowed)}")


class Catalog:
    """Models by name and the join graph between them. A model may be given as what builds it; that runs on first use."""

    def __init__(self, *models: Model, lazy: Mapping[str, Callable[[Catalog], Model]] | None = None):
        self.models: dict[str, Model | Callable[[Catalog], Model]] = dict(lazy or {})
        for m in models:
            self.add(m)

    def add(self, model: Model) -> None:
        self.models[model.name] = model

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise UnknownReferenceError(f"unknown model {name!r}")
        model = self.models[name]
        if not isinstance(model, Model):
            model = self.models[name] = model(self)
        return model

    def edge(self, source: str, target: str) -> Join:
        """The join from ``source`` to ``target``: declared, or the reverse of a declared one (one-to-many)."""
        m = self[source]
        if target in m.joins:
            return m.joins[target]
        t = self[target]
        if source in t.joins:
            j = t.joins[source]
            rev = {"many_to_one": "one_to_many", "one_to_one": "one_to_one"}.get(j.cardinality, "many_to_many")
            return Join(source, tuple((b, a) for a, b in j.pairs), rev)
        raise UnknownReferenceError(f"no join from {source!r} to {target!r}")

    def path_cardinality(self, root: str, path: list[str]) -> str:
        """M1: 'many_to_one' when every hop is proven many-to-one, else 'fanning'."""
        cur = root
        for hop in path:
            if self.edge(cur, hop).cardinality not in ("many_to_one", "one_to_one"):
                return "fanning"
            cur = hop
        return "many_to_one"

    def prove_unique(self, model: str, columns: Sequence[str]) -> bool:
        """Is ``columns`` a key of ``model``'s data? One distributed aggregate (duplicate groups
        are counted, nothing is collected but that count)."""
        df = self[model].df
        dup = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        return dup.limit(1).count() == 0

    def cardinalities(self, edges: Sequence[tuple[str, str]]) -> DataFrame:
        """M1: per edge what is declared, how many key values of its target occur twice or more, and what that proves:
        'many_to_one' without any, else 'fanning'. One row an edge, each target counted per key before the shuffle."""
        out = None
        for source, target in edges:
            j = self.edge(source, target)
            keys = [F.col(b) for _, b in j.pairs]
            known = self[target].df.na.drop(subset=[b for _, b in j.pairs])  # a key with a null joins nothing
            twice = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("repeated_keys"))
            row = twice.select(
                F.lit(source).alias("source"),
                F.lit(target).alias("target"),
                F.lit(j.cardinality).alias("declared"),
                "repeated_keys",
                F.when(F.col("repeated_keys") == 0, "many_to_one").otherwise("fanning").alias("proven"),
            )
            out = row if out is None else out.unionByName(row)
        return out

    def proven_cardinality(self, source: str, target: str) -> str:
        """M1: the declared cardinality of an edge, or 'many_to_one' when the target side of an
        undeclared join is proven unique by the data, else 'fanning or unproven'."""
        j = self.edge(source, target)
        if j.cardinality in ("many_to_one", "one_to_one"):
            return j.cardinality
        if self.prove_unique(target, [b for _, b in j.pairs]):
            return "many_to_one"
        return "fanning or unproven"

    def attach(self, root: str, refs: Mapping[str, str], df: DataFrame | None = None) -> DataFrame:
        """The root's rows with each ``alias -> 'model.model.column'`` attached by left joins.

        Hops must be many-to-one (declared or key-unique); otherwise ``ReaggregationError``. A shared
        path prefix is joined once. Targets with a declared row bound are broadcast.
        """
        out = df if df is not None else self[root].df
        joined: dict[tuple[str, ...], str] = {(): ""}  # path -> column prefix
        for alias, ref in refs.items():
            *path, column = ref.split(".")
            cur, prefix = root, ""
            for i, hop in enumerate(path):
                key = tuple(path[: i + 1])
                j = self.edge(cur, hop)
                if j.cardinality not in ("many_to_one", "one_to_one"):
                    raise ReaggregationError(f"{'.'.join(key)} fans out from {root!r}: aggregate it at its own grain")
                if key not in joined:
                    p = "__" + "_".join(key) + "__"
                    t = self[hop]
                    right = t.df.select(*[F.col(c).alias(p + c) for c in t.df.columns])
                    right = bounded_broadcast(right, t.max_rows)
                    cond = None
                    for a, b in j.pairs:
                        c = F.col(prefix + a) == F.col(p + b)
                        cond = c if cond is None else cond & c
                    out = out.join(right, cond, "left")
                    joined[key] = p
                cur, prefix = hop, joined[key]
            target = self[cur]
            if column not in target.df.columns:
                raise UnknownReferenceError(f"unknown column {column!r} in model {cur!r}")
            out = out.withColumn(alias, F.col(prefix + column))
        return out.drop(*[c for c in out.columns if c.startswith("__")])
