"""Settled semantics of SURVEY §2.13 on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from tidecast.operators import counting, features, filters, folds, scoring, series

D = dt.date


def test_q6_lags_come_from_the_whole_series(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=i), i + 1) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y bigint")
    sliced = features.lag_features(df, "y", 3).where(F.col("ds") >= D(2024, 1, 21)).orderBy("ds").first()
    assert (sliced.count_lag1, sliced.count_lag2, sliced.count_lag3) == (20, 19, 18)  # not zeros


def test_q20_bounds_from_the_wider_set(spark):
    cases = spark.createDataFrame(
        [("a", 1, D(2024, 1, 1), "x"), ("a", 2, D(2024, 1, 3), "agent"), ("a", 3, D(2024, 1, 6), "x")],
        "series_id string, case_id bigint, receipt_date date, handler string")
    bounds = counting.date_bounds(cases, "receipt_date")  # before routing
    routed = cases.where(F.col("handler") == "agent")
    dense = series.densify_zero(counting.daily_count(routed), bounds).orderBy("ds").toPandas()
    assert dense.ds.min() == D(2024, 1, 1) and dense.ds.max() == D(2024, 1, 6)
    assert dense.y.tolist() == [0, 0, 1, 0, 0, 0]


def test_q25_minimum_training_length(spark):
    b = spark.createDataFrame([(D(2022, 1, 1), D(2025, 4, 30))], "start date, end date")
    assert folds.folds_cutoff(b, 60).count() == 38
    assert folds.folds_cutoff(b, 60, drop_first=0, min_train_days=730).orderBy("fold").first().cutoff == D(2024, 1, 1)


def test_q8_pooled_and_fold_mean_differ_and_are_named_apart(spark):
    rows = [("a", 1, 10.0, 9.0), ("a", 1, 10.0, 11.0), ("a", 2, 100.0, 50.0)]
    fr = spark.createDataFrame(rows, "series_id string, fold int, actual double, fcst double")
    per_fold = scoring.metric_table(fr, ["series_id", "fold"])
    mean = scoring.cv_mean(per_fold, ["series_id"]).first()
    pooled = scoring.cv_pooled(fr, ["series_id"]).first()
    assert mean.cv_mean_wkpi != pooled.cv_pooled_wkpi


def test_routing_none_is_text_not_null(spark):
    df = spark.createDataFrame([("1", "None", "Desk"), ("2", None, "Desk"), ("3", "None", "Service Centre A")],
                               "handler string, department string, queue string")
    kept = filters.filter_routing(df, ["9"], "None", "Service Centre").select("handler").collect()
    assert [r.handler for r in kept] == ["1"]
    agents = spark.createDataFrame([("3",), ("3",)], "agent string")  # duplicates must not multiply rows
    kept2 = sorted(r.handler for r in filters.filter_routing(df, agents, "None", "Service Centre").collect())
    assert kept2 == ["1", "3"]
