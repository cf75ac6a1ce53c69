"""Saved queries (H2-H5): keep the *specification*, not the result, so a refinement rebuilds the plan.

A ``QuerySpec`` names a source model, a time dimension with its bucket, dimensions reached through
declared joins, measures, filters and post-aggregation transforms. ``refine`` returns a new spec with
additions; ``build`` turns it into one DataFrame plan for Catalyst to optimize as a whole (filters on the
source are pushed to the scan). ``as_model`` registers the result as a query-backed model whose time
column remembers its bucket, so a later query cannot break it down finer (S14).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.functions.calendar import bucket, check_rebucket, in_range
from grainline.operators.periods import cumsum
from grainline.operators.relations import where_exists
from grainline.plans.model import Catalog, MetricResult, Model, ReaggregationError, ResultWarning, UnknownReferenceError


@dataclass(frozen=True)
class QuerySpec:
    source: str
    measures: Mapping[str, Callable[[], Column]]
    time: tuple[str, str] | None = None  # (column, granularity)
    dims: Mapping[str, str] = field(default_factory=dict)  # alias -> column or 'model.model.column'
    filters: tuple[Callable[[], Column], ...] = ()
    date_range: object = None
    running: Mapping[str, str] = field(default_factory=dict)  # output name -> measure accumulated (E1)
    # output name -> ("sum", column) or ("count", "*"): decomposable measures, which let ``build``
    # aggregate the source per join key before looking up dimensions (eager aggregation)
    additive: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    # ('model.column', predicate on that column) on a joined model; across a to-many join it is existential
    where: tuple[tuple[str, Callable[[Column], Column]], ...] = ()

    def result(self, catalog: Catalog) -> MetricResult:
        """M2: the query with its joined predicates applied, and a warning for each that became a semi-join.

        A predicate on a model that the source has one row of filters the attached column. On one that the source has many
        rows of, a join would repeat the source's rows: the source is cut by a semi-join instead.
        """
        model, warnings = catalog[self.source], []
        df = model.scan(self.date_range, self.time[0]) if self.time is not None else model.df
        for ref, predicate in self.where:
            hop, _, column = ref.partition(".")
            edge = catalog.edge(self.source, hop)
            if edge.cardinality in ("many_to_one", "one_to_one"):
                df = catalog.attach(self.source, {"__where": ref}, df).where(predicate(F.col("__where"))).drop("__where")
                continue
            target = catalog[hop]
            if column not in target.df.columns:
                raise UnknownReferenceError(f"unknown column {column!r} in model {hop!r}")
            child = target.df.where(predicate(F.col(column)))
            df = where_exists(df, [a for a, _ in edge.pairs], child, [b for _, b in edge.pairs])
            warnings.append(ResultWarning("semi_join_pushed", f"the filter on {ref!r} keeps rows of {self.source!r} with a match, by semi-join"))
        cut = Catalog(lazy=catalog.models)
        cut.add(replace(model, df=df, within=None))
        return MetricResult(replace(self, where=()).build(cut), warnings)

    def refine(
        self,
        dims: Mapping[str, str] | None = None,
        measures: Mapping[str, Callable[[], Column]] | None = None,
        filters: tuple[Callable[[], Column], ...] = (),
        date_range=None,
        running: Mapping[str, str] | None = None,
    ) -> QuerySpec:
        return replace(
            self,
            dims={**self.dims, **(dims or {})},
            measures={**self.measures, **(measures or {})},
            filters=self.filters + tuple(filters),
            date_range=date_range if date_range is not None else self.date_range,
            running={**self.running, **(running or {})},
        )

    def _additive_cols(self) -> dict[str, Column]:
        return {n: (F.count(F.lit(1)) if f == "count" else F.sum(c)) for n, (f, c) in self.additive.items()}

    def build(self, catalog: Catalog) -> DataFrame:
        if self.where:
            return self.result(catalog).df
        model = catalog[self.source]
        refs = {a: r for a, r in self.dims.items() if "." in r}
        hops = {r.split(".")[0] for r in refs.values()}
        if self.additive and not self.measures and len(hops) == 1:
            return self._build_eager(catalog, model, refs, hops.pop())
        if refs:
            df = catalog.attach(self.source, refs)
        else:
            df = model.scan(self.date_range, self.time[0]) if self.time is not None else model.df
        for a, r in self.dims.items():
            if "." not in r and a != r:
                df = df.withColumn(a, F.col(r))
        for f in self.filters:
            df = df.filter(f())
        keys = self._time_keys(model)
        if self.time is not None:
            df = self._bucketed(df)
        keys += list(self.dims)
        measures = {**{n: m() for n, m in self.measures.items()}, **self._additive_cols()}
        out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
        return self._running(out)

    def _time_keys(self, model: Model) -> list[str]:
        if self.time is None:
            return []
        col, unit = self.time
        stored = model.buckets.get(col)
        if stored is not None:
            check_rebucket(stored, unit)
        return [col]

    def _bucketed(self, df: DataFrame) -> DataFrame:
        col, unit = self.time
        if self.date_range is not None:  # a running total starts at the range (S4)
            df = df.filter(in_range(col, self.date_range))
        return df.withColumn(col, bucket(col, unit))

    def _running(self, out: DataFrame) -> DataFrame:
        if self.running and self.time is not None:
            for name, measure in self.running.items():
                out = cumsum(out, self.time[0], measure, list(self.dims), name)
        return out

    def _build_eager(self, catalog: Catalog, model: Model, refs: Mapping[str, str], hop: str) -> DataFrame:
        """Decomposable measures through one many-to-one hop: aggregate the source per join key (and
        time bucket and local dimensions) first, then look the dimensions up on the partials. Filters
        must use the source's own columns here."""
        join = catalog.edge(self.source, hop)
        if join.cardinality not in ("many_to_one", "one_to_one"):
            raise ReaggregationError(f"{hop} fans out from {self.source!r}")
        df = model.scan(self.date_range, self.time[0]) if self.time is not None else model.df
        for f in self.filters:
            df = df.filter(f())
        time_keys = self._time_keys(model)
        if self.time is not None:
            df = self._bucketed(df)
        local = [a for a, r in self.dims.items() if "." not in r]
        for a in local:
            if self.dims[a] != a:
                df = df.withColumn(a, F.col(self.dims[a]))
        fact_keys = [a for a, _ in join.pairs]
        pre = df.groupBy(*fact_keys, *time_keys, *local).agg(*[c.alias(n) for n, c in self._additive_cols().items()])
        lookup = catalog.attach(hop, {a: r.split(".", 1)[1] for a, r in refs.items()})
        lookup = lookup.select(*[F.col(b).alias(f"__lk_{b}") for _, b in join.pairs], *refs)
        cond = None
        for a, b in join.pairs:
            c = F.col(a) == F.col(f"__lk_{b}")
            cond = c if cond is None else cond & c
        joined = pre.join(lookup, cond, "left")
        out = joined.groupBy(*time_keys, *self.dims).agg(*[F.sum(n).alias(n) for n in self.additive])
        return self._running(out)

    def as_model(self, catalog: Catalog, name: str) -> Model:
        """H3: the saved query as a model; its time column keeps the bucket it was built at."""
        buckets = {self.time[0]: self.time[1]} if self.time else {}
        return Model(name=name, df=self.build(catalog), key=tuple([*([self.time[0]] if self.time else []), *self.dims]), buckets=buckets)


def sql_model(spark, name: str, text: str, key: tuple[str, ...] = (), args: dict | None = None, time_col: str | None = None, tables: Mapping[str, DataFrame] | None = None) -> Model:
    """H4/H5: a model backed by SQL text over registered views and the frames ``tables`` (as ``{name}`` in the text); ``args``
    binds named parameters (``:name`` markers) without string formatting."""
    return Model(name=name, df=spark.sql(text, args=args or {}, **(tables or {})), key=key, time_col=time_col)
