"""Movable days against an independent almanac, observed days, effects, and their queries' fixed cases."""

import datetime as dt

import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from tidecast.functions.feasts import easter_sunday, nth_weekday
from tidecast.operators.feasts import FEASTS, Feast, feast_calendar, feast_effect

D = dt.date


def test_easter_of_every_year_from_1583(spark):
    got = dict(spark.range(1583, 4000).select("id", easter_sunday(F.col("id").cast("int"))).collect())
    assert got == {y: easter(y) for y in range(1583, 4000)}


def test_easter_before_1583_and_of_no_year_is_null(spark):
    rows = spark.createDataFrame([(1582,), (None,)], "y int").select(easter_sunday("y").alias("e")).collect()
    assert [r.e for r in rows] == [None, None]


@pytest.mark.parametrize("weekday, n", [(0, 1), (3, 4), (6, 5), (4, -1), (2, -2)])
def test_nth_weekday(spark, weekday, n):
    got = dict(spark.range(1990, 2051).select("id", nth_weekday(F.col("id").cast("int"), 2, weekday, n)).collect())
    for y in range(1990, 2051):
        days = [D(y, 2, 1) + dt.timedelta(k) for k in range(29) if (D(y, 2, 1) + dt.timedelta(k)).month == 2]
        days = [d for d in days if d.weekday() == weekday]
        assert got[y] == (days[n - 1] if 0 < n <= len(days) else days[n] if n < 0 else None)


def span(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "ds date")


def rows(df):
    return sorted((r.ds, r.holiday, r.rule_ds, r.observed) for r in df.collect())


def test_a_sunday_is_observed_on_the_next_free_day(spark):
    # Christmas 2022 is a Sunday and Boxing Day the Monday after it
    got = rows(feast_calendar(span(spark, D(2022, 3, 1)), (Feast("Christmas Day", 12, 25), Feast("Boxing Day", 12, 26)), years_ahead=0))
    c, b = D(2022, 12, 25), D(2022, 12, 26)
    assert got == [(c, "Christmas Day", c, False), (b, "Boxing Day", b, False), (D(2022, 12, 27), "Christmas Day", c, True)]


def test_stated_days_inside_the_years_and_repeats(spark):
    stated = spark.createDataFrame([(D(2024, 2, 10), "Lunar", 1), (D(2024, 2, 10), "Lunar", 2), (D(2031, 1, 1), "Lunar", 3), (None, "Lunar", 4)], "ds date, holiday string, year int")
    got = rows(feast_calendar(span(spark, D(2024, 1, 1), D(2024, 5, 1)), (Feast("Leap", 2, 29),), stated, years_ahead=1))
    assert got == [(D(2024, 2, 10), "Lunar", D(2024, 2, 10), False), (D(2024, 2, 29), "Leap", D(2024, 2, 29), False)]


def test_no_days_no_calendar(spark):
    assert feast_calendar(span(spark)).count() == 0
    assert feast_calendar(span(spark, None)).count() == 0


def test_a_rule_states_one_way(spark):
    for bad in (Feast("x"), Feast("x", 1, 1, easter=2), Feast("x", 5, nth=1), Feast("x", easter=1, month=3)):
        with pytest.raises(ValueError, match="x: state"):
            bad.of("year")


def test_no_nested_loop_and_no_python(spark):
    plan = feast_calendar(span(spark, D(2022, 3, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan and len(FEASTS) == 9


def test_effect_against_brute_force(spark):
    days = [D(2023, 1, 1) + dt.timedelta(k) for k in range(500)]
    data = [(s, d, None if i % 41 == 0 else float((i * 7 + len(s)) % 23)) for s in ("a", "bb") for i, d in enumerate(days)]
    series = spark.createDataFrame(data, "series_id string, ds date, y double")
    cal = feast_calendar(series)
    names = {}
    for r in cal.collect():
        names.setdefault(r.ds, set()).add(r.holiday)
    got = {(r.series_id, r.holiday): (r.n_days, r.mean_y, r.mean_plain) for r in feast_effect(series, cal).collect()}
    want = {}
    for s in ("a", "bb"):
        mine = [(d, y) for t, d, y in data if t == s and y is not None]
        for name in {n for v in names.values() for n in v}:
            on = [(d, y) for d, y in mine if name in names.get(d, ())]
            if on:
                plain = [[y for d, y in mine if d.weekday() == e.weekday() and d not in names] for e, _ in on]
                want[s, name] = (len(on), round(sum(y for _, y in on) / len(on), 6), round(sum(sum(p) / len(p) for p in plain) / len(on), 6))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
