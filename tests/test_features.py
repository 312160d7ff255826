import datetime as dt

import numpy as np
import pandas as pd

from tidecast.operators import features

D = dt.date


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def _flags_brute(pdf, hol_days):
    """The holiday-flag rules stated step by step on a sorted daily frame."""
    pdf = pdf.sort_values("ds").reset_index(drop=True)
    ph = np.array([1 if d in hol_days else 0 for d in pdf.ds])
    wday = np.array([d.weekday() for d in pdf.ds])
    shift = lambda a, k: np.concatenate([np.zeros(k, dtype=int), a[:-k]])
    lag1 = shift(ph, 1)
    helper = ((wday == 0) & ((shift(ph, 3) == 1) | (shift(ph, 2) == 1)) & (ph != 1)).astype(int)
    lag1 = np.where(helper == 1, 1, lag1)
    lag1 = np.where(((wday == 5) | (wday == 6)) & (lag1 == 1), 0, lag1)
    lag1 = np.where(ph == 1, 0, lag1)
    return ph, helper, lag1


def test_holiday_flags_match_rules(spark):
    ds = days(D(2024, 1, 1), 120)
    # Friday, Saturday, Sunday, two consecutive days, and a Monday holiday
    hol_days = {D(2024, 1, 5), D(2024, 1, 13), D(2024, 1, 21), D(2024, 2, 7), D(2024, 2, 8), D(2024, 3, 4)}
    hol = spark.createDataFrame([(d, "X Day", 1) for d in sorted(hol_days)], "ds date, holiday string, is_ph int")
    rows = [("a", d, i) for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y bigint")
    out = features.holiday_flags(df, hol).orderBy("ds").toPandas()
    ph, helper, lag1 = _flags_brute(pd.DataFrame(rows, columns=["series_id", "ds", "y"]), hol_days)
    assert out["is_ph"].tolist() == ph.tolist()
    assert out["helper"].tolist() == helper.tolist()
    assert out["is_ph_lag1"].tolist() == lag1.tolist()


def test_lags_equal_self_join(spark):
    ds = days(D(2024, 1, 1), 40)
    rows = [("a", d, i * i) for i, d in enumerate(ds)] + [("b", d, 3 * i) for i, d in enumerate(ds[:20])]
    df = spark.createDataFrame(rows, "series_id string, ds date, y bigint")
    out = features.lag_features(df, "y", 14).toPandas()
    look = {(s, d): y for s, d, y in rows}
    for r in out.itertuples():
        for k in range(1, 15):
            assert getattr(r, f"count_lag{k}") == look.get((r.series_id, r.ds - dt.timedelta(days=k)), 0)


def test_holiday_calendar_and_dim(spark):
    series = spark.createDataFrame([(D(2022, 3, 1),), (D(2023, 6, 1),)], "ds date")
    raw = features.holiday_calendar(series, years_ahead=0).toPandas()
    # 2022-01-01 is a Saturday, 2022-12-25 a Sunday → observed Monday 2022-12-26
    assert ((raw.ds == D(2022, 12, 26)) & (raw.holiday == "Christmas Day (Observed)")).any()
    dim = features.holiday_dim(features.holiday_calendar(series, years_ahead=0)).toPandas()
    assert dim.ds.is_unique
    assert dim.loc[dim.ds == D(2022, 12, 26), "holiday"].item() == "Christmas Day"


def test_yearend_window(spark):
    df = spark.createDataFrame([("a", D(2022, 1, 1)), ("a", D(2023, 5, 1))], "series_id string, ds date")
    out = features.yearend_window(df).toPandas()
    assert len(out) == 5 * 46  # anchors 2022 … 2026, 46 days each
    first = out[out.anchor == D(2022, 12, 10)].ds
    assert first.min() == D(2022, 11, 26) and first.max() == D(2023, 1, 10)


def test_fourier_shape(spark):
    df = spark.createDataFrame([(D(1970, 1, 8),)], "ds date")
    r = features.fourier_features(df, 7.0, 2, "w").first()
    assert abs(r["w_sin1"]) < 1e-9 and abs(r["w_cos1"] - 1.0) < 1e-9  # t = 7 is a full weekly period
