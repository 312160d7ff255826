import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidecast.models import arx, gbt, structural
from tidecast.models.trend_weekday import trend_weekday
from tidecast.operators import features

D = dt.date


def series_rows(n=500, seed=0, noise=2.0):
    rng = np.random.default_rng(seed)
    ds = [D(2021, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    week = np.array([5, 3, 0, -2, -4, -6, 4], dtype=float)
    y = 100 + 0.05 * np.arange(n) + np.array([week[d.weekday()] for d in ds]) + rng.normal(0, noise, n)
    return ds, y


def split_frame(spark, ds, y, n_test=60, sid="s1"):
    roles = ["train"] * (len(ds) - n_test) + ["test"] * n_test
    return spark.createDataFrame([(sid, d, float(v), r) for d, v, r in zip(ds, y, roles)],
                                 "series_id string, ds date, y double, role string")


def test_structural_recovers_trend_and_week(spark):
    ds, y = series_rows()
    rows = split_frame(spark, ds, y)
    spec = structural.StructuralSpec(seasonalities=(("weekly", 7.0, 3),), mode="additive")
    grid = [{"changepoint_prior_scale": 0.05, "param_id": 1}, {"changepoint_prior_scale": 0.5, "param_id": 2}]
    out = structural.forecast_structural(rows, grid, ["series_id"], spec).toPandas()
    assert len(out) == 120 and set(out.param_id) == {1, 2}
    err = np.abs(out.actual - out.fcst).mean()
    assert err < 3.0, err
    assert (out.lo <= out.fcst).all() and (out.fcst <= out.hi).all()


def test_structural_multiplicative_runs(spark):
    ds, y = series_rows(noise=1.0)
    spec = structural.StructuralSpec(seasonalities=(("weekly", 7.0, 3), ("yearly", 365.25, 2)))
    out = structural.forecast_structural(split_frame(spark, ds, y), [{"param_id": 1}], ["series_id"], spec).toPandas()
    assert np.abs(out.actual - out.fcst).mean() < 4.0


def test_arx_recursive_uses_no_future_actuals(spark):
    rng = np.random.default_rng(2)
    n = 400
    ds = [D(2021, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 20 + 0.6 * y[t - 1] + rng.normal(0, 1)
    df = spark.createDataFrame([("s", d, float(v), "train" if i < n - 30 else "test", 0, 0, d.weekday(),
                                 d.timetuple().tm_yday) for i, (d, v) in enumerate(zip(ds, y))],
                               "series_id string, ds date, y double, role string, is_ph int, is_ph_lag1 int, "
                               "wday int, yearday int")
    out = arx.forecast_arx(arx.with_lags(df), ["series_id"]).toPandas().sort_values("ds")
    assert len(out) == 30
    # recursive: far steps converge to the mean 20 / (1 - 0.6) = 50
    assert abs(out.fcst.iloc[-1] - 50) < 3
    # changing the test actuals must not change the forecast
    df2 = df.withColumn("y", F.when(F.col("role") == "test", F.lit(1e6)).otherwise(F.col("y")))
    out2 = arx.forecast_arx(arx.with_lags(df2), ["series_id"]).toPandas().sort_values("ds")
    assert np.allclose(out.fcst.to_numpy(), out2.fcst.to_numpy())


TREE = {"max_depth": 2, "min_data_in_leaf": 5, "learning_rate": 0.5, "num_leaves": 3, "num_iterations": 8, "param_id": 1}


def test_binned_features_keep_the_order_and_missing_values_apart(spark):
    rows = spark.createDataFrame([(i, float(i % 200), None if i % 10 == 0 else i % 3) for i in range(1000)], "k int, x double, c int")
    out = gbt.binned(rows, ["x", "c"]).toPandas().sort_values("k")
    x, c = (np.array([v[j] for v in out.features]) for j in (0, 1))
    true = np.arange(1000) % 200
    assert list(out.columns) == ["k", "features"] and len(set(x)) <= 63
    assert all(x[true == a].max() <= x[true == b].min() for a, b in ((0, 60), (60, 130), (130, 199)))
    assert set(c[::10]).isdisjoint(c[np.arange(1000) % 10 != 0]) and c.max() < gbt.BINS


def test_tree_folds_fit_each_set_on_its_train_rows_only(spark):
    """Levels that change between folds: a fold's forecasts follow its own training rows."""
    days = [D(2021, 1, 4) + dt.timedelta(days=i) for i in range(120)]
    rows = [(s, d, d.weekday(), level + 5.0 * d.weekday() + (40.0 if i >= 60 else 0.0)) for s, level in (("a", 10), ("b", 80)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows + [("new", days[55], 1, None)], "series_id string, ds date, wday int, y double")

    def halves(x):
        i = F.datediff("ds", F.lit("2021-01-04").cast("date"))
        return x.withColumn("fold", F.floor(i / 60).cast("int") + 1).withColumn("role", F.when(i % 60 < 50, "train").otherwise("test"))

    grid = [TREE, dict(TREE, param_id=7, num_iterations=1)]
    out = gbt.forecast_folds(df, grid, halves, ["wday"]).toPandas()
    assert out.groupby(["fold", "param_id"]).size().to_dict() == {(1, 1): 21, (1, 7): 21, (2, 1): 20, (2, 7): 20}  # a series without history too
    best = out[(out.param_id == 1) & (out.series_id != "new")]
    assert (best.fcst - best.actual).abs().max() < 6 and (best.fcst - best.actual).abs().mean() < 2.5
    assert out[out.param_id == 1].fcst.tolist() != out[out.param_id == 7].fcst.tolist()
    empty = gbt.forecast_folds(df.limit(0), grid, halves, ["wday"])
    assert empty.columns == ["series_id", "fold", "param_id", "ds", "actual", "fcst"] and empty.count() == 0
    try:
        gbt.forecast_folds(df, [dict(TREE, learning_rate=1.5, param_id=3)], halves, ["wday"])
    except ValueError as e:
        assert "1.5" in str(e) and "3" in str(e)
        return
    raise AssertionError("a step size above 1 must be refused")


def test_tree_fits_have_tasks_by_their_rows_not_by_the_shuffle_settings(spark, monkeypatch):
    """Many shuffle partitions and files: small fits keep one partition, more rows get more, forecasts stay
    (values without equally good splits: the order of sums decides those)."""
    days = [D(2021, 1, 4) + dt.timedelta(days=i) for i in range(120)]
    df = spark.createDataFrame([(f"s{s}", d, d.weekday(), 11.0 * s * s + (3.0, 17.0, 8.5, 29.0, 1.0, 41.0, 22.0)[d.weekday()]) for s in range(8) for d in days],
                               "series_id string, ds date, wday int, y double").repartition(16, "series_id", "ds")

    def halves(x):
        i = F.datediff("ds", F.lit("2021-01-04").cast("date"))
        return x.withColumn("fold", F.floor(i / 60).cast("int") + 1).withColumn("role", F.when(i % 60 < 50, "train").otherwise("test"))

    seen, plain = [], gbt.GBTRegressor.fit
    monkeypatch.setattr(gbt.GBTRegressor, "fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), plain(self, rows))[1])
    grid = [dict(TREE, num_iterations=3), dict(TREE, num_iterations=2, param_id=7)]
    keys = ["fold", "param_id", "series_id", "ds"]

    def forecasts():
        seen.clear()
        return gbt.forecast_folds(df, grid, halves, ["wday"]).toPandas().sort_values(keys).reset_index(drop=True)

    one = forecasts()
    assert seen == [(1, 400)] * 4 and len(one) == 2 * 2 * 8 * 10
    gbt.fit(df.withColumn("holiday_code", F.lit(0)), TREE, ["wday"])
    assert seen[4:] == [(1, 960)]
    monkeypatch.setattr(gbt, "ROWS_PER_TASK", 150)
    many = forecasts()
    assert seen == [(3, 400)] * 4
    assert one[keys].equals(many[keys]) and np.allclose(one.fcst, many.fcst)


def test_tree_sets_are_numbered_as_the_grid(spark):
    from tidecast.operators import folds
    from tidecast.plans import catalog

    keys = spark.createDataFrame([("s",)], "series_id string")
    grid = {r.param_id: r for r in folds.tree_grid(keys, catalog.TREE_GRID).collect()}
    assert len(grid) == 180 and len(catalog.TREE_SETS) == 8
    for p in catalog.TREE_SETS:
        assert all(grid[p["param_id"]][k] == p[k] for k in ("max_depth", "min_data_in_leaf", "learning_rate", "num_iterations"))


def test_sparse_fit_minimises_its_objective():
    rng = np.random.default_rng(2)
    X, pen, h = rng.normal(size=(80, 9)), np.full(9, 0.3), slice(2, 7)
    y = X @ np.array([1, -2, 0, 0, 3, 0, 0, 0.5, 1]) + rng.normal(0, 0.3, 80)

    def cost(b, weight):
        rest = np.delete(b, np.r_[h])
        return ((y - X @ b) ** 2).sum() / 2 + (0.3 * rest ** 2).sum() / 2 + weight * np.abs(b[h]).sum()

    for weight in (0.0, 20.0, 1e6):
        b = structural.sparse_fit(X.T @ X, X.T @ y, pen, h, weight)
        assert all(cost(b, weight) <= cost(b + 1e-3 * rng.normal(size=9) * (b != 0), weight) + 1e-9 for _ in range(50))
        assert all(cost(b, weight) <= cost(b + e, weight) + 1e-9 for e in np.eye(9) * 1e-3)
    assert np.flatnonzero(structural.sparse_fit(X.T @ X, X.T @ y, pen, h, 20.0)[h]).tolist() == [2]
    assert not structural.sparse_fit(X.T @ X, X.T @ y, pen, h, 1e6)[h].any()


def test_one_planted_bend_is_found_and_hinges_away_from_it_are_zero():
    n, spec = 1000, structural.StructuralSpec(seasonalities=(("weekly", 7.0, 3),), mode="additive")
    ts = np.arange(n) / (n - 1)
    knots = np.linspace(0, spec.changepoint_range, spec.n_changepoints + 1)[1:]
    rng = np.random.default_rng(5)
    y = 100 + 40 * ts + 90 * np.maximum(0, ts - knots[11]) + 3 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"ds": [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "t": np.arange(n) + 18262.0, "y": y, "role": "train"})
    _, _, _, changes = next(structural._solve(structural._group(pdf, spec, []), [{"changepoint_prior_scale": 0.0003, "param_id": 1}], spec))
    # neighbours of the planted hinge, 32 days apart, take some of the bend; the other 22 are exactly 0
    assert set(np.flatnonzero(changes)) <= {10, 11, 12} and changes.argmax() == 11
    assert abs(changes.sum() - 90) < 9 and changes[11] > 55


def test_bands_widen_and_cover(spark):
    """Random-walk slopes: the band at 60 days is wider than at 10, and holds about 80 % of the actuals."""
    n, series_n, h = 700, 60, 60
    rows = []
    for k in range(series_n):
        rng = np.random.default_rng(k)
        days = np.arange(n)  # rates change in the part of the training that has hinges, and again from its end on
        slope = np.cumsum(rng.laplace(0, 0.25, n) * (rng.random(n) < 0.04) * ((days < 0.8 * (n - h)) | (days >= n - h)))
        y = 200 + np.cumsum(slope) + rng.normal(0, 3, n)
        rows += [(f"s{k}", D(2020, 1, 1) + dt.timedelta(days=i), float(v), "train" if i < n - h else "test") for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, role string")
    spec = structural.StructuralSpec(seasonalities=(), mode="additive")
    out = structural.forecast_structural(df, [{"changepoint_prior_scale": 0.5, "param_id": 1}], ["series_id"], spec).toPandas()
    out["ahead"] = out.groupby("series_id").ds.rank()
    near, far = out[out.ahead <= 10], out[out.ahead > 50]
    assert (far.hi - far.lo).mean() > 1.5 * (near.hi - near.lo).mean()
    inside = lambda x: ((x.actual >= x.lo) & (x.actual <= x.hi)).mean()
    assert 0.65 <= inside(near) <= 0.95 and 0.6 <= inside(far) <= 0.95, (inside(near), inside(far))


def test_trend_weekday_exact_on_clean_data(spark):
    ds = [D(2022, 1, 3) + dt.timedelta(days=i) for i in range(56)]
    f = [1.2, 1.1, 1.0, 1.0, 0.9, 0.8, 1.0]
    rows = [("s", d, (10 + 0.5 * i) * f[d.weekday()]) for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")
    out = trend_weekday(df.where(F.col("ds") < D(2022, 2, 21)), df.where(F.col("ds") >= D(2022, 2, 21)),
                        ["series_id"], "mul").toPandas()
    assert np.abs(out.actual - out.fcst).max() < 1.5


def test_trend_weekday_rows_equals_joined_form(spark):
    from tidecast.models.trend_weekday import trend_weekday_rows
    rng = np.random.default_rng(4)
    rows = []
    for s in ("a", "b"):
        for fold in (1, 2):
            for i in range(80):
                d = D(2022, 1, 1) + dt.timedelta(days=i + 10 * fold)
                rows.append((s, fold, d, int(rng.integers(0, 30)), "train" if i < 60 else "test"))
    df = spark.createDataFrame(rows, "series_id string, fold int, ds date, y bigint, role string")
    keys = ["series_id", "fold"]
    a = trend_weekday(df.where("role = 'train'"), df.where("role = 'test'"), keys, "both").toPandas()
    b = trend_weekday_rows(df, keys, "both").toPandas()
    cols = keys + ["ds", "model"]
    a, b = a.sort_values(cols).reset_index(drop=True), b.sort_values(cols).reset_index(drop=True)
    assert len(a) == len(b) == 2 * 2 * 20 * 2
    assert (a.fcst.to_numpy() == b.fcst.to_numpy()).all()  # bit-identical forecasts
    assert np.allclose(a.lo, b.lo) and np.allclose(a.hi, b.hi)


SHORT = (0, 1, 5, 9, 27, 120)


def short_rows(spark, n_test=4):
    """One series per length of its training part; a week's pattern and the calendar columns."""
    rows = []
    for n in SHORT:
        for i in range(n + n_test):
            d = D(2022, 1, 3) + dt.timedelta(days=i)
            role, y = ("train", 50.0 + 3 * d.weekday()) if i < n else ("test", 50.0 + 3 * d.weekday())
            rows.append((f"s{n:03d}", d, y, role, 0, 0, d.weekday(), d.timetuple().tm_yday))
    return spark.createDataFrame(rows, "series_id string, ds date, y double, role string, is_ph int, is_ph_lag1 int, "
                                       "wday int, yearday int")


def check_short(out):
    """Every test row of every series is there; a null forecast only where nothing was trained on."""
    assert out.groupby("series_id").size().to_dict() == {f"s{n:03d}": 4 for n in SHORT}
    for sid, part in out.groupby("series_id"):
        n = int(sid[1:])
        assert (part.n_train == n).all()
        assert part.fcst.isna().all() == (n == 0) and part.fcst.notna().all() == (n > 0), sid
        assert (part.status == "no_train").all() == (n == 0)


def test_short_series_keep_their_test_rows(spark):
    rows = short_rows(spark)
    ax = arx.forecast_arx(arx.with_lags(rows), ["series_id"]).toPandas()
    check_short(ax)
    assert set(ax[ax.series_id == "s120"].status) == {"fitted"} and set(ax[ax.series_id == "s005"].status) == {"mean"}
    assert (ax[ax.series_id == "s120"].fcst - ax[ax.series_id == "s120"].actual).abs().max() < 1e-3
    check_short(structural.forecast_structural(rows, [{"param_id": 1}], ["series_id"]).toPandas())


def test_components_recombine_to_the_forecast(spark):
    ds, y = series_rows(400)
    rows = split_frame(spark, ds, y * (1 + 0.3 * np.sin(np.arange(400) / 20)))
    hol = spark.createDataFrame([(D(2021, 5, 1), "Labour Day", 0), (D(2022, 1, 10), "Labour Day", 0)],
                                "ds date, holiday string, offset int")
    hol = structural.HolidayWindows(hol, ("Labour Day",), 0, 0)
    for mode in ("additive", "multiplicative"):
        spec = structural.StructuralSpec(mode=mode)
        p = {"changepoint_prior_scale": 0.05, "param_id": 1}
        fc = structural.forecast_structural(rows, [p], ["series_id"], spec, hol).toPandas().set_index("ds").fcst
        parts = structural.components(rows, p, ["series_id"], spec, hol).toPandas().pivot(index="ds", columns="component", values="value")
        effect = parts.drop(columns="trend").sum(axis=1)
        fit = parts.trend + effect if mode == "additive" else parts.trend * (1 + effect)
        assert np.allclose(fit.loc[fc.index], fc, rtol=1e-9), mode


def test_structural_fits_only_the_chosen_set(spark):
    ds, y = series_rows(200)
    rows = split_frame(spark, ds, y)
    grid = [{"changepoint_prior_scale": 0.01, "param_id": 1}, {"changepoint_prior_scale": 0.5, "param_id": 2}]
    every = structural.forecast_structural(rows, grid, ["series_id"]).where("param_id = 2").orderBy("ds").toPandas()
    one = structural.forecast_structural(rows.withColumn("best", F.lit(2)), grid, ["series_id"], chosen="best").orderBy("ds").toPandas()
    assert every.equals(one)
    first = structural.forecast_structural(rows.withColumn("best", F.lit(None).cast("int")), grid, ["series_id"], chosen="best")
    assert {r.param_id for r in first.collect()} == {1}


def test_global_trees_take_any_number_of_series(spark):
    ds, y = series_rows(40)
    base = spark.createDataFrame([(f"s{k:03d}", d, int(v) + 100 * k) for k in range(70) for d, v in zip(ds, y)],
                                 "series_id string, ds date, y bigint")
    hol = spark.createDataFrame([(D(2021, 1, 20), "Labour Day", 1)], "ds date, holiday string, is_ph int")
    ff = features.feature_frame(base, hol)
    p = {"max_depth": 2, "min_data_in_leaf": 5, "learning_rate": 0.25, "num_leaves": 3, "num_iterations": 3}
    out = gbt.fit_predict(ff.where(F.col("ds") < D(2021, 2, 1)), ff.where(F.col("ds") >= D(2021, 2, 1)), p)
    assert out.count() == 70 * 9
    try:
        gbt.fit_predict(ff, ff, dict(p, learning_rate=1.5))
    except ValueError:
        return
    raise AssertionError("a learning rate above 1 must be refused")


def test_recursive_trees_use_their_own_forecasts(spark):
    feats = ["wday", "count_lag1", "count_lag2"]
    p = {"max_depth": 2, "min_data_in_leaf": 5, "learning_rate": 0.5, "num_leaves": 3, "num_iterations": 4}
    ds = [D(2021, 1, 4) + dt.timedelta(days=i) for i in range(66)]
    rows = [(s, d, d.weekday(), float(level + 5 * d.weekday() + i % 3) if i < 60 else None)
            for s, level in (("a", 10), ("b", 80)) for i, d in enumerate(ds)]
    rows += [("new", d, d.weekday(), None) for d in ds[60:]]
    df = features.lag_features(spark.createDataFrame(rows, "series_id string, ds date, wday int, y double"), n=2)
    df = df.withColumn("holiday_code", F.lit(0))
    past, ahead = df.where("y is not null"), df.where("y is null")
    model, level = gbt.fit(past, p, feats)
    out = gbt.forecast_recursive(model, level, past, ahead, 5, feats, steps_per_write=2).toPandas()
    assert out.groupby("series_id").size().to_dict() == {"a": 5, "b": 5, "new": 5}  # a series without history too
    levels = {r.series_id: (r.series_mean, r.series_spread) for r in level.collect()}
    trees = model.stages[-1]
    from pyspark.ml.linalg import Vectors
    for sid in ("a", "b"):
        last = [r[3] for r in rows if r[0] == sid and r[3] is not None][-2:]
        got = out[out.series_id == sid].sort_values("ds")
        assert list(got.ds) == ds[60:65] and list(got.step) == [1, 2, 3, 4, 5]
        for d, fc in zip(got.ds, got.fcst):
            want = trees.predict(Vectors.dense([d.weekday(), last[-1], last[-2], *levels[sid]]))
            assert abs(want - fc) < 1e-9
            last.append(want)


def test_balance_model_on_weeks_and_months_has_the_yearly_term_only(spark):
    assert [n for n, _, _ in structural.balance_spec("D").seasonalities] == ["weekly", "monthly", "quarterly", "yearly"]
    assert [n for n, _, _ in structural.balance_spec("W").seasonalities] == ["yearly"]
    assert structural.INTAKE_SPEC.mode == "additive" and len(structural.INTAKE_SPEC.season_columns()) == 26


def test_holiday_windows_state_their_columns(spark):
    days = spark.createDataFrame([(D(2021, 5, 1), "Labour Day", 0), (D(2021, 5, 2), "Labour Day", 1), (D(2021, 5, 3), "Other", 0),
                                  (D(2021, 5, 1), "Labour Day", 0)], "ds date, holiday string, offset int")
    df = spark.createDataFrame([(D(2021, 5, i),) for i in range(1, 5)], "ds date")
    out, cols = structural.holiday_indicators(df, structural.HolidayWindows(days, ("Labour Day", "Absent"), 0, 1))
    assert cols == ["hol_LabourDay_0", "hol_LabourDay_1", "hol_Absent_0", "hol_Absent_1"]
    assert [tuple(r)[1:] for r in out.orderBy("ds").collect()] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
