import datetime as dt

import numpy as np

from tidecast.operators import scoring

D = dt.date


def test_best_params_ties_to_lowest_id(spark):
    s = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("a", 3, 0.5), ("b", 1, 2.0), ("b", 2, None)],
                              "series_id string, param_id int, score double")
    got = sorted((r.series_id, r.param_id) for r in scoring.best_params(s, ["series_id"], "score").collect())
    assert got == [("a", 3), ("b", 1)]
    s2 = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0)], "series_id string, param_id int, score double")
    assert scoring.best_params(s2, ["series_id"], "score").first().param_id == 1


def test_cv_mean_empty_is_inf(spark):
    s = spark.createDataFrame([("a", 1, None), ("b", 1, 2.0), ("b", 1, 4.0)], "series_id string, p int, wkpi double")
    got = {r.series_id: r.cv_mean_wkpi for r in scoring.cv_mean(s, ["series_id"]).collect()}
    assert got == {"a": float("inf"), "b": 3.0}


def test_blend_rounds_then_floors(spark):
    d = D(2024, 1, 1)
    rows = [("a", d, "m1", 10.0, 2.5), ("a", d, "m2", 10.0, -7.4), ("a", d, "m1", 10.0, 3.5),
            ("a", D(2024, 1, 2), "m1", 5.0, 1.6)]
    fc = spark.createDataFrame(rows, "series_id string, ds date, model string, actual double, fcst double")
    out = {r.ds: r for r in scoring.blend(fc, ["m1", "m2"]).collect()}
    r = out[d]
    # m1: mean(round(2.5)=2, round(3.5)=4) = 3; m2: round(-7.4) = -7 → hybrid round((3-7)/2) = -2 → floored 0
    assert (r.m1, r.m2, r.hybrid, r.actual) == (3.0, 0.0, 0.0, 10.0)
    r2 = out[D(2024, 1, 2)]
    assert (r2.m1, r2.m2, r2.hybrid) == (2.0, None, 2.0)  # a missing model is skipped in the mean


def test_metric_table_perfect_is_zero(spark):
    fc = spark.createDataFrame([("a", 1.0, 1.0), ("a", 4.0, 4.0)], "series_id string, actual double, fcst double")
    r = scoring.metric_table(fc, ["series_id"]).first()
    assert (r.mae, r.rmse, r.mape, r.kpi, r.wkpi, r.n_matched) == (0.0, 0.0, 0.0, 0.0, 0.0, 2)
