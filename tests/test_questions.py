"""Every registered question equals its independent DuckDB oracle (sf0.001 by default, or the folder in
``GRAINLINE_TEST_SF``); the rest run and return rows."""

import os

import pytest

import __spark_entry__ as entry_mod
from scales import SF_SMALL
from grainline.catalog import all_questions
from oracle import compare, duck

SF = os.environ.get("GRAINLINE_TEST_SF", SF_SMALL)

QUESTIONS = all_questions()
WITH_ORACLE = sorted(n for n, q in QUESTIONS.items() if q.oracle)
WITHOUT = sorted(n for n, q in QUESTIONS.items() if not q.oracle)


@pytest.fixture(scope="module")
def oracle_con():
    return duck(SF)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_question_matches_oracle(spark, oracle_con, name):
    q = QUESTIONS[name]
    assert compare(q.build(spark, SF), oracle_con, q.oracle) is None


@pytest.mark.parametrize("name", WITHOUT)
def test_question_without_oracle_runs(spark, name):
    df = QUESTIONS[name].build(spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert df.columns == ["region", "city", "revenue", "region_total"]


def test_every_question_covers_operators():
    assert all(q.covers for q in QUESTIONS.values())


@pytest.mark.parametrize("name", ["f2_quarter_hour_events", "t_march_events", "j_c01_peak_weekday_hour", "j_q04_monthly_orders_2026", "f5_whole_weeks_events"])
def test_time_questions_do_not_depend_on_the_session_zone(spark, oracle_con, name):
    q = QUESTIONS[name]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert compare(q.build(spark, SF), oracle_con, q.oracle) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_every_oracle_runs_quickly_at_sf001(duck_mid):
    """The driver runs each oracle at sf0.01; none may be pathologically slow (e.g. a text cross product)."""
    import time

    slow = []
    for name in WITH_ORACLE:
        t0 = time.perf_counter()
        duck_mid.sql(QUESTIONS[name].oracle).fetchall()
        if time.perf_counter() - t0 > 20:
            slow.append(name)
    assert not slow
