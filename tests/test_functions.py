import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import metrics as M
from tidecast.functions.dates import (bucket_label, date_from_text, day_first_date, month_end, week_end_monday,
                                      week_end_sunday, weekday0)
from tidecast.functions.holidays import clean_holiday_name, holiday_code
from tidecast.functions.numeric import floor_zero, parse_grouped_number, round_half_even


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_kpi_golden(spark):
    df = spark.createDataFrame([(110.0, 100.0), (120.0, 100.0)], "actual double, fcst double")
    r = df.agg(M.kpi("actual", "fcst").alias("k"), M.weighted_kpi("actual", "fcst").alias("w")).first()
    assert r["k"] == pytest.approx(12.867720738, abs=1e-8)
    assert r["w"] == pytest.approx(13.032288938, abs=1e-8)


def test_kpi_zero_actual_and_perfect(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0)], "actual double, fcst double")
    r = df.agg(M.kpi("actual", "fcst").alias("k"), M.weighted_kpi("actual", "fcst").alias("w"),
               M.mape("actual", "fcst").alias("m")).first()
    assert r["k"] == pytest.approx(100 * np.mean([5 / 0.1, 0]))  # plain KPI explodes on zeros
    assert r["w"] is None  # Σ actual = 0
    assert r["m"] is None  # every actual is zero
    perfect = spark.createDataFrame([(3.0, 3.0), (7.0, 7.0)], "actual double, fcst double")
    assert perfect.agg(M.weighted_kpi("actual", "fcst")).first()[0] == 0.0


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, f = rng.integers(1, 50, 40).astype(float), rng.normal(20, 5, 40)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, f)], "actual double, fcst double")
    r = df.agg(M.mae("actual", "fcst"), M.rmse("actual", "fcst"), M.mape("actual", "fcst")).first()
    assert r[0] == pytest.approx(np.mean(np.abs(a - f)))
    assert r[1] == pytest.approx(np.sqrt(np.mean((a - f) ** 2)))
    assert r[2] == pytest.approx(np.mean(np.abs((a - f) / a)) * 100)


def test_missing_forecast_is_skipped(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, None)], "actual double, fcst double")
    r = df.agg(M.mae("actual", "fcst"), M.matched("actual", "fcst")).first()
    assert r[0] == 1.0 and r[1] == 1


def test_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (0.49,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x")).collect()]
    assert got == [2.0, 4.0, 0.0, 0.0]


def test_floor_zero_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(floor_zero("x")).collect()] == [0.0, None, 2.0]


def test_weekday_and_buckets(spark):
    d = dt.date(2024, 1, 3)  # Wednesday
    assert one(spark, weekday0(F.lit(d))) == 2
    assert one(spark, week_end_sunday(F.lit(d))) == dt.date(2024, 1, 7)
    assert one(spark, week_end_monday(F.lit(d))) == dt.date(2024, 1, 8)
    assert one(spark, week_end_monday(F.lit(dt.date(2024, 1, 8)))) == dt.date(2024, 1, 8)
    assert one(spark, week_end_sunday(F.lit(dt.date(2024, 1, 7)))) == dt.date(2024, 1, 7)
    assert one(spark, month_end(F.lit(dt.date(2024, 2, 10)))) == dt.date(2024, 2, 29)
    with pytest.raises(ValueError):
        bucket_label("ds", "Q")


def test_text_dates_and_numbers(spark):
    assert one(spark, date_from_text(F.lit("2025-06-30T10:11:12.000+0000"))) == dt.date(2025, 6, 30)
    assert one(spark, date_from_text(F.lit("garbage"))) is None
    assert one(spark, day_first_date(F.lit("7/1/2022"))) == dt.date(2022, 1, 7)
    assert one(spark, day_first_date(F.lit("31/13/2022"))) is None
    assert one(spark, parse_grouped_number(F.lit("2,431"))) == 2431.0
    assert one(spark, parse_grouped_number(F.lit("1,234,567.5"))) == 1234567.5
    assert one(spark, parse_grouped_number(F.lit("n/a"))) is None


def test_holiday_names(spark):
    df = spark.createDataFrame([("National Day (Observed)",), ("Hari Raya Haji* (*estimated)",), ("Vesak Day",),
                                (None,), ("Unknown Day",)], "h string")
    out = df.select(clean_holiday_name("h").alias("c")).select("c", holiday_code("c").alias("k")).collect()
    assert [(r["c"], r["k"]) for r in out] == [("National Day", 10), ("Hari Raya Haji", 9), ("Vesak Day", 8),
                                               (None, 0), ("Unknown Day", None)]
