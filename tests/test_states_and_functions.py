from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from scales import SF_SMALL

from grainline.catalog import answers, bench
from grainline.functions import sql as sql_functions
from grainline.operators import checks, recon, sketches
from grainline.plans.model import UnknownReferenceError
from grainline.plans.spec import QuerySpec, sql_model


def facts(spark, n=6000):
    day = "date_add(date'2024-01-01', cast(id % 120 as int))"
    return spark.range(n).selectExpr(f"{day} as day_of", "if(id % 11 = 0, null, (id * 7919) % 997) as who", "id % 3 as kind", "cast((id * 31) % 1000 as double) as amount")


def test_distinct_states_merge_to_any_grain(spark):
    df = facts(spark)
    states = sketches.distinct_states(df, "day_of", ["kind"], "who")
    for unit, dims in ((None, []), ("month", []), ("month", ["kind"]), (None, ["kind"])):
        keys = [*([F.trunc("day_of", "month").alias("period")] if unit else []), *dims]
        exact = df.groupBy(*keys).agg(F.count_distinct("who").alias("n")).collect()
        got = sketches.distinct_at(states, unit, dims).collect()
        assert len(got) == len(exact)
        want = {tuple(r)[:-1]: r.n for r in exact}
        assert all(abs(r.n - want[tuple(r)[:-1]]) <= 0.05 * want[tuple(r)[:-1]] for r in got)


def test_a_state_of_nothing_counts_zero(spark):
    nothing = spark.createDataFrame([("2024-01-01", None)], "d string, who long").selectExpr("cast(d as date) as d", "who")
    assert sketches.distinct_at(sketches.distinct_states(nothing, "d", [], "who"), None, []).first().n == 0
    assert sketches.distinct_at(sketches.distinct_states(nothing.where("false"), "d", [], "who"), "month", []).collect() == []


def test_quantile_states(spark):
    df = facts(spark)
    found = sketches.quantiles_at(sketches.quantile_states(df, "day_of", ["kind"], "amount"), "month", ["kind"], [0.0, 0.25, 0.5, 1.0])
    checked = sketches.rank_errors(df, "day_of", "month", ["kind"], "amount", found).collect()
    assert len(checked) == 4 * 3 * 4 and max(r.rank_error for r in checked) <= 2 * sketches.KLL_RANK_ERROR
    ends = df.groupBy(F.trunc("day_of", "month").alias("p"), "kind").agg(F.min("amount"), F.max("amount")).collect()
    assert {(r.period, r.kind, r.value) for r in checked if r.rank == 0.0} == {(r[0], r[1], r[2]) for r in ends}


def test_profile_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.5), (3, None, 1.5), (3, "b", 0.5)], "k int, s string, x double")
    got = {r.column: tuple(r)[2:] for r in checks.profile(df).select("rows", "column", "non_null", "min_value", "max_value", "distinct_values", "is_unique").collect()}
    assert got == {"k": (4, "1", "3", 3, False), "s": (3, "a", "b", 2, False), "x": (3, "0.5", "1.5", 2, False)}
    assert [tuple(r) for r in checks.profile(df.where("false"), ["k"]).select("rows", "non_null", "min_value", "distinct_values").collect()] == [(0, 0, None, 0)]
    plan = checks.profile(spark.read.parquet(f"{SF_SMALL}/orders.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_averages_by_the_column_with_fewest_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 6.0), ("d", None, 3.0)], "many string, few string, v double")
    got = sorted(map(tuple, checks.averages_by_low_cardinality(df, ["v"]).collect()), key=repr)
    assert got == sorted([("few", "x", False, 2, 1.5), ("few", "y", False, 1, 6.0), ("few", None, False, 1, 3.0), ("few", None, True, 4, 3.0)], key=repr)
    assert [tuple(r)[2:] for r in checks.averages_by_low_cardinality(df, ["v"], ["many"], most=3).collect()] == [(True, 4, 3.0)]


def test_sql_functions_are_inlined(spark):
    names = sql_functions.register(spark)
    assert "gl_ratio" in names
    df = spark.sql("SELECT gl_ratio(1, 4) a, gl_ratio(1, 0) b, gl_change_pct(3, 2) c, gl_cents(1.255) d, gl_close(100, 100.00001, 1e-6) e, gl_close(NULL, 1, 1) f, gl_half_year(DATE'2024-07-01') g")
    assert tuple(df.first()) == (0.25, None, 50.0, 126, True, False, "2024-H2")
    plan = answers.udf_sql_functions(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "gl_" not in plan.replace("gl_orders", "") and "Python" not in plan
    with pytest.raises(ValueError):
        sql_functions.register_table(spark, "x; drop", "", "a INT", "SELECT 1")


def test_a_sql_models_parameter_reaches_the_scan(spark):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    m = sql_model(spark, "m", "SELECT l_suppkey FROM {t} WHERE l_quantity >= :least", args={"least": 25}, tables={"t": lines})
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,25.0)]" in m.df._jdf.queryExecution().toString()


def test_a_filter_across_a_to_many_join_is_a_semi_join(spark):
    cat = bench.models(spark, SF_SMALL)
    count = {"n": lambda: F.count(F.lit(1))}
    many = QuerySpec("customers", count, where=(("orders.status", lambda c: c == "P"),)).result(cat)
    assert many.kinds() == ["semi_join_pushed"]
    one = QuerySpec("customers", count, where=(("regions.name", lambda c: c == "ASIA"),)).result(cat)
    assert one.kinds() == []
    b_orders, customers = cat["orders"].df, cat["customers"].df
    bad = {r.customer_id for r in b_orders.where("status = 'P'").collect()}
    assert many.df.first().n == sum(r.id in bad for r in customers.collect())
    with pytest.raises(UnknownReferenceError):
        QuerySpec("customers", count, where=(("orders.nope", lambda c: c == 1),)).result(cat)


def test_models_are_built_on_first_use(spark):
    cat = bench.models(spark, SF_SMALL)
    assert not any(hasattr(m, "df") for m in cat.models.values())
    assert cat["orders"] is cat["orders"] and sum(hasattr(m, "df") for m in cat.models.values()) == 1


def test_content_md5_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, s string")
    a, b = recon.content_md5(df).first(), recon.content_md5(df.orderBy(F.desc("k")).repartition(3)).first()
    assert a == b and a.rows == 3
    assert recon.content_md5(df.distinct()).first().hash != a.hash and recon.content_md5(df.where("false")).first().hash == "0"
