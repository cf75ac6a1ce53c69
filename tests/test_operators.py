"""Unit tests of the metric operators on small literal frames and the sf0.001 bindings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scales import SF_SMALL
from grainline.catalog import bench as bench_q
from grainline.functions.aggregates import weighted_avg
from grainline.functions.calendar import custom_bucket, in_period, iso_weekday, last_complete, period_bounds
from grainline.functions.scalar import band
from grainline.operators import grain, periods, ranking
from grainline.plans.model import (
    AggregationNotAllowedError,
    Model,
    ReaggregationError,
    TimeDimensionColumnError,
    UnknownReferenceError,
)
from grainline.plans.spec import QuerySpec
from grainline.sources.bindings import Bench


def test_period_literals_are_half_open():
    assert period_bounds("2025-Q1") == (dt.date(2025, 1, 1), dt.date(2025, 4, 1))
    assert period_bounds("2025-03") == (dt.date(2025, 3, 1), dt.date(2025, 4, 1))
    assert period_bounds("2025") == (dt.date(2025, 1, 1), dt.date(2026, 1, 1))
    assert period_bounds("2025-03-31") == (dt.date(2025, 3, 31), dt.date(2025, 4, 1))


def test_period_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where(in_period("o_orderdate", "1998-Q1", "timestamp_ntz"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_last_complete_months(spark):
    df = spark.createDataFrame([(dt.date(1998, m, 15),) for m in range(8, 13)] + [(dt.date(1999, 1, 3),)], "d date")
    got = sorted(r.d.month for r in df.where(last_complete("d", 3, "month", "1999-01-15")).collect())
    assert got == [10, 11, 12]


def test_iso_weekday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")  # Monday, Sunday
    assert [r.w for r in df.select(iso_weekday("d").alias("w")).collect()] == [1, 7]


def test_band_null_falls_to_else(spark):
    df = spark.createDataFrame([(None,), (5.0,), (15.0,), (25.0,)], "x double")
    got = [r.b for r in df.select(band("x", [10, 20], ["low", "mid", "high"]).alias("b")).collect()]
    assert got == ["high", "low", "mid", "high"]


@pytest.mark.parametrize("n_rows,tiles", [(23, 10), (10, 10), (7, 10), (101, 4)])
def test_ntile_global_matches_sql_ntile(spark, n_rows, tiles):
    df = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(n_rows)], "id int, v double").repartition(3)
    mine = {r.id: r.tile for r in ranking.ntile_global(df, [F.col("v").desc(), F.col("id")], tiles).collect()}
    df.createOrReplaceTempView("nt")
    sql = {r.id: r.t for r in spark.sql(f"select id, ntile({tiles}) over (order by v desc, id) as t from nt").collect()}
    assert mine == sql


def test_top_n_uses_window_group_limit(spark):
    b = Bench(spark, SF_SMALL)
    g = b.orders_flat.groupBy("region", "customer_id").agg(F.sum("amount").alias("rev"))
    plan = ranking.top_n_per_group(g, "rev", ["region"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rolling_equals_brute_force(spark):
    b = Bench(spark, SF_SMALL)
    got = {
        r.month: r.n
        for r in periods.rolling(b.orders, "order_date", "month", "90d", {"n": F.count_distinct}, {"n": "customer_id"}, date_range="1998", name="month", distinct_key="customer_id").collect()
    }
    rows = b.orders.select("order_date", "customer_id").collect()
    for m in range(1, 13):
        start = dt.date(1998, m, 1)
        end = dt.date(1998 + m // 12, m % 12 + 1, 1)
        lo = end - dt.timedelta(days=90)
        want = len({r.customer_id for r in rows if lo <= r.order_date < end and r.customer_id is not None})
        assert got[start] == want


def test_rolling_months_count_calendar_gaps(spark):
    b = Bench(spark, SF_SMALL)
    r = periods.rolling(b.orders, "order_date", "month", "3m", {"v": F.sum}, {"v": "amount"}, date_range=["1997-09-01", "1997-09-30"], name="month")
    got = r.first().v
    want = b.orders.where((F.col("order_date") >= "1997-07-01") & (F.col("order_date") < "1997-10-01")).agg(F.sum("amount")).first()[0]
    assert got == want


def test_time_shift_is_calendar_based(spark):
    s = spark.createDataFrame([(dt.date(2024, 7, 1), 10), (dt.date(2024, 9, 1), 30)], "p date, v int")
    out = {r.p: r.prev for r in periods.time_shift(s, "p", "v", -1, "month", name="prev").collect()}
    assert out[dt.date(2024, 9, 1)] is None  # August is missing: no silent row shift


def test_consecutive_periods(spark):
    vals = [True, True, False, True, True, True, False]
    s = spark.createDataFrame([(dt.date(2024, i + 1, 1), v) for i, v in enumerate(vals)], "p date, up boolean")
    out = [r.streak for r in periods.consecutive_periods(s, "p", F.col("up")).orderBy("p").collect()]
    assert out == [1, 2, 0, 1, 2, 3, 0]


def test_fill_periods_and_gaps(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 1), 5)], "p date, v int")
    out = periods.fill_periods(s, spark, "p", "2024-01-01", "2024-03-01", "month", ["v"]).orderBy("p").collect()
    assert [r.v for r in out] == [5, 0, 0]


def test_rebucket_only_coarser(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 1),)], "m date")
    assert periods.rebucket(df, "m", "month", "quarter").first().m == dt.date(2024, 1, 1)
    with pytest.raises(TimeDimensionColumnError):
        periods.rebucket(df, "m", "month", "day")
    with pytest.raises(TimeDimensionColumnError):
        periods.rebucket(df, "m", "week", "month")


def test_saved_query_refuses_finer_breakdown(spark):
    cat = bench_q.models(spark, SF_SMALL)
    spec = QuerySpec(source="monthly_rev", measures={"revenue": lambda: F.sum("revenue")}, time=("order_date", "day"))
    with pytest.raises(TimeDimensionColumnError):
        spec.build(cat)


def test_whole_periods_only(spark):
    facts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 30, 9),)], "t timestamp_ntz")
    s = periods.series(facts, "t", "week", [], {"n": F.count(F.lit(1))}, name="w")
    out = periods.whole_periods_only(s, "w", "week", facts, "t")
    assert [r.w for r in out.df.collect()] == [dt.date(2024, 1, 1)]
    assert periods.whole_periods_only(s, "w", "month", facts, "t", stored="week").kinds() == ["whole_periods_non_nesting"]


def test_custom_buckets(spark):
    df = spark.createDataFrame([(dt.date(1995, 3, 31),), (dt.date(1995, 4, 1),), (dt.date(1996, 3, 31),)], "d date")
    fy = [r.fy for r in df.select(custom_bucket("d", "year", 1, "1995-04-01").alias("fy")).collect()]
    assert fy == [dt.date(1994, 4, 1), dt.date(1995, 4, 1), dt.date(1995, 4, 1)]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 44, 59),)], "t timestamp_ntz")
    assert ts.select(custom_bucket("t", "minute", 15, "2000-01-01").alias("q")).first().q == dt.datetime(2024, 1, 1, 10, 30)


def test_null_safe_join_matches_null_groups(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    got = {(r.k, r.a, r.b) for r in grain.null_safe_join(a, b, ["k"]).collect()}
    assert got == {(None, 1, 10), ("x", 2, 20)}


def test_calc_dim_rollup_null_entity_is_else(spark):
    df = spark.createDataFrame([(None, 5000.0), (None, 5000.0), (1, 3000.0), (2, 10.0)], "c int, amount double")
    out = grain.calc_dim_rollup(df, "c", F.sum("amount"), lambda t: F.when(t > 2000, "high").otherwise("other"), "band", {"rev": (F.sum("amount"), "sum")}, null_label="other")
    assert {r.band: r.rev for r in out.collect()} == {"high": 3000.0, "other": 10010.0}


def test_reaggregation_warnings_and_refusals(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "g string, k int, v double")
    res = grain.reaggregate(df, ["g"], F.sum("v"), ["g"], F.avg, "x")
    assert res.kinds() == ["degenerate_reaggregation"]
    assert grain.associate(df, ["g"], "k", "v", "t").kinds() == ["associated"]
    assert grain.broadcast_total(df, ["g"], df.agg(F.sum("v")), "t").kinds() == ["broadcast"]
    with pytest.raises(ReaggregationError):
        grain.refuse_unattributable("sum(credit)", ["status"])


def test_attach_refuses_fan_out_and_unknown(spark):
    cat = bench_q.models(spark, SF_SMALL)
    with pytest.raises(ReaggregationError):
        cat.attach("customers", {"amount": "orders.amount"})
    with pytest.raises(UnknownReferenceError):
        cat.attach("orders", {"x": "customers.nope"})
    assert cat.path_cardinality("orders", ["customers", "regions"]) == "many_to_one"
    assert cat.path_cardinality("customers", ["orders"]) == "fanning"


def test_allowed_aggregation_guard(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, price double")
    m = Model("items", df, ("id",), allowed_aggs={"price": frozenset({"avg", "min", "max"})})
    m.check_agg("price", "avg")
    with pytest.raises(AggregationNotAllowedError):
        m.check_agg("price", "sum")


def test_bounded_truncates_with_warning(spark):
    df = spark.range(30)
    res = ranking.bounded(df, 20)
    assert res.df.count() == 20 and res.kinds() == ["truncated"]
    assert ranking.bounded(df, 100).kinds() == []


def test_weighted_avg_default_weight(spark):
    df = spark.createDataFrame([(2.0, 1), (4.0, 3), (None, 5)], "v double, w int")
    r = df.agg(weighted_avg("v", "w").alias("a"), weighted_avg("v").alias("b")).first()
    assert r.a == pytest.approx(3.5) and r.b == pytest.approx(3.0)


def test_order_limit_offset_and_hidden_columns(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(10)], "k int, v int")
    out = ranking.order_limit(df, [F.col("v").desc()], limit=3, offset=2, drop=["v"])
    assert out.columns == ["k"] and [r.k for r in out.collect()] == [2, 3, 4]


def test_sql_backed_model_with_parameters(spark):
    from grainline.plans.spec import sql_model

    spark.range(10).createOrReplaceTempView("nums")
    m = sql_model(spark, "big_nums", "select id from nums where id >= :lo", ("id",), {"lo": 7})
    assert sorted(r.id for r in m.df.collect()) == [7, 8, 9]


def test_rolling_every_bucket_keeps_empty_windows(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10), 5.0)], "d date, v double")
    r = periods.rolling(df, "d", "month", "1m", {"s": F.sum}, {"s": "v"}, date_range=["2024-01-01", "2024-03-31"], name="m", every_bucket=True)
    assert {x.m: x.s for x in r.collect()} == {dt.date(2024, 1, 1): 5.0, dt.date(2024, 2, 1): None, dt.date(2024, 3, 1): None}


def test_unattributable_modes(spark):
    df = spark.createDataFrame([("ok", 1, 10.0), ("bad", 1, 10.0), ("ok", 2, 5.0)], "status string, cid int, credit double")
    assoc = grain.unattributable("associate", df, ["status"], "cid", "credit", "t")
    assert {r.status: r.t for r in assoc.df.collect()} == {"ok": 15.0, "bad": 10.0} and assoc.kinds() == ["associated"]
    bc = grain.unattributable("broadcast", df, ["status"], "cid", "credit", "t")
    assert {r.status: r.t for r in bc.df.collect()} == {"ok": 15.0, "bad": 15.0} and bc.kinds() == ["broadcast"]
    with pytest.raises(ReaggregationError):
        grain.unattributable("error", df, ["status"], "cid", "credit", "t")


def test_normalize_values(spark):
    from grainline.functions.scalar import normalize_value

    df = spark.createDataFrame([(float("nan"), " 12.5 ", "2025-03", dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 2, 3, 4, 5))], "x double, s string, m string, t0 timestamp_ntz, t1 timestamp_ntz")
    r = df.select(
        normalize_value("x", "double").alias("x"), normalize_value("s", "string").alias("s"), normalize_value("m", "string").alias("m"),
        normalize_value("t0", "timestamp_ntz").alias("t0"), normalize_value("t1", "timestamp_ntz").alias("t1"),
    ).first()
    assert r.x is None and r.s == "12.5" and r.m == "2025-03-01" and r.t0 == "2025-01-02" and r.t1.startswith("2025-01-02T03:04:05")


def test_default_row_cap(spark):
    res = ranking.bounded(spark.range(25), 20)
    assert res.df.count() == 20 and res.kinds() == ["truncated"]


@pytest.mark.parametrize("p", [0.5, 0.9, 0.0, 1.0, 0.37])
def test_percentile_by_rank_equals_percentile(spark, p):
    rows = [(g, float((i * 7919) % 101)) for g in ("a", "b", None) for i in range(1 + (13 if g == "a" else 6 if g == "b" else 1))]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double").repartition(4)
    mine = {r.g: r.q for r in ranking.percentile_by_rank(df, ["g"], "v", p, "q").collect()}
    ref = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
    assert mine.keys() == ref.keys()
    for k in ref:
        assert mine[k] == pytest.approx(ref[k], rel=1e-12, abs=1e-12)


def test_proven_cardinality(spark):
    from grainline.plans.model import Catalog, Join

    a = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id int, b_id int")
    b_unique = spark.createDataFrame([(10, "x"), (20, "y")], "id int, name string")
    b_dup = spark.createDataFrame([(10, "x"), (10, "z")], "id int, name string")
    cat = Catalog(Model("a", a, ("id",), joins={"b": Join("b", (("b_id", "id"),), "unknown")}), Model("b", b_unique, ("id",)))
    assert cat.proven_cardinality("a", "b") == "many_to_one"
    cat.add(Model("b", b_dup, ("id",)))
    assert cat.proven_cardinality("a", "b") == "fanning or unproven"


def test_eager_spec_equals_row_level_spec(spark):
    cat = bench_q.models(spark, SF_SMALL)
    common = dict(source="orders", time=("order_date", "month"), dims={"region": "customers.regions.name", "status": "status"},
                  filters=(lambda: F.col("amount") > 1000,), date_range="1998-Q1")
    eager = QuerySpec(measures={}, additive={"revenue": ("sum", "amount"), "n": ("count", "*")}, **common).build(cat)
    rows = QuerySpec(measures={"revenue": lambda: F.sum("amount"), "n": lambda: F.count(F.lit(1))}, **common).build(cat)
    key = lambda r: (str(r.order_date), str(r.region), r.status)
    assert sorted(map(tuple, eager.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert eager.count() > 0 and key(eager.first())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_positions_of_a_large_frame_with_payload(spark, adaptive):
    """Dense unique positions and SQL tiles although columns outside the sort order are kept."""
    n = 1_000_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("v"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        tiled = ranking.ntile_global(df, [F.col("v"), F.col("id")], 7, "tile")
        got = {r.tile: r.n for r in tiled.groupBy("tile").agg(F.count("payload").alias("n")).collect()}
        assert got == {k + 1: n // 7 + (k < n % 7) for k in range(7)}
        numbered = ranking.global_row_number(df, [F.col("v"), F.col("id")], "r")
        r = numbered.agg(F.count_distinct("r").alias("d"), F.max("r").alias("m"), F.max(F.length("payload")).alias("p")).first()
        assert (r.d, r.m, r.p) == (n, n - 1, 64)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.exchange.reuse")
