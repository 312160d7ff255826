"""Registered queries: name → ``(spark, sf_dir) -> DataFrame`` over the driver's tables.

Each key is one operator (or composite) of the inventory, run over whole tables. Model keys,
which SQL cannot state, come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_from_text
from ..functions.holidays import clean_holiday_name, holiday_code
from ..functions.numeric import floor_zero, round_half_even
from ..models.trend_weekday import trend_weekday, trend_weekday_rows
from ..operators import counting, feasts, features, filters, folds, scoring, series
from ..session import cut_lineage, scratch_path, ship_package
from ..sources.cases import cases_a_from_tpch, cases_b_from_tpch
from ..sources.metric_log import compare_runs, log_metrics, read_log
from ..sources.sinks import write_series
from ..sources.tables import read_table
from ..sources.cases import routing_agents_from_tpch
from . import intake, testbed
from .intake import P
from .testbed import T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            with testbed.query_scope():
                return fn(spark, sf_dir)

        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


S = "series_id"

# ------------------------------------------------------------------ scans and filters --


@register("scan_cases")
def q_scan_cases(spark, sf):
    return cases_a_from_tpch(spark, sf).drop("receipt_ts")


@register("scan_cases_b")
def q_scan_cases_b(spark, sf):
    return cases_b_from_tpch(spark, sf).select(S, "case_no", "receipt_text")


@register("filter_contains")
def q_filter_contains(spark, sf):
    a = filters.filter_contains(cases_a_from_tpch(spark, sf), "queue", P.workbasket_needle)
    return a.select(S, "case_id", "queue")


@register("filter_date_from")
def q_filter_date_from(spark, sf):
    a = filters.filter_date_from(cases_a_from_tpch(spark, sf), "receipt_date", P.date_from, "receipt_ts")
    return a.select(S, "case_id", "receipt_date")


@register("filter_routing")
def q_filter_routing(spark, sf):
    return intake.routed_cases(spark, sf).select(S, "case_id", "handler", "department", "queue")


@register("filter_channel")
def q_filter_channel(spark, sf):
    b = filters.filter_channel(cases_b_from_tpch(spark, sf), P.b_dept, P.b_excluded_origin)
    return b.select(S, "case_no", "channel_dept", "origin")


@register("date_from_text")
def q_date_from_text(spark, sf):
    b = cases_b_from_tpch(spark, sf)
    return b.select("case_no", "receipt_text", date_from_text("receipt_text").alias("receipt_date"))


@register("flag_child")
def q_flag_child(spark, sf):
    """Lines after the first of an order are children of it; count rows per flag."""
    li = read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("parent_casenumber"))
    flagged = filters.flag_child(li, "parent_casenumber")
    return flagged.groupBy("is_child").agg(F.count(F.lit(1)).alias("row_count"))


# ------------------------------------------------------------------------- counting --


@register("dedupe_case")
def q_dedupe_case(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.to_date("l_shipdate").alias("receipt_date"), "l_linenumber")
    return counting.dedupe_case(li, "case_id", ["receipt_date", "l_linenumber"])


@register("daily_count")
def q_daily_count(spark, sf):
    cases = intake.routed_cases(spark, sf).select(S, "case_id", "receipt_date")
    return counting.daily_count(counting.dedupe_case(cases, "case_id", ["receipt_date", S]), "receipt_date")


@register("daily_count_b")
def q_daily_count_b(spark, sf):
    return counting.daily_count(intake.cases_b_dated(spark, sf), "receipt_date")


@register("filter_window")
def q_filter_window(spark, sf):
    return filters.filter_window(q_daily_count_b(spark, sf), *P.b_window)


@register("date_bounds")
def q_date_bounds(spark, sf):
    return intake.source_a_bounds(spark, sf)


@register("stage_funnel")
def q_stage_funnel(spark, sf):
    a = intake.cases_a_filtered(spark, sf)
    agents = routing_agents_from_tpch(spark, sf, P.routing_min_balance)
    return counting.stage_funnel(filters.flag_routing(a, agents, P.routing_dept, P.routing_exclude), "routed")


# --------------------------------------------------------------------------- series --


def _a_counts(spark, sf):
    return q_daily_count(spark, sf)


@register("missing_days")
def q_missing_days(spark, sf):
    return series.missing_days(_a_counts(spark, sf), q_date_bounds(spark, sf))


@register("densify_zero")
def q_densify_zero(spark, sf):
    return intake.source_a_daily(spark, sf)


def _b_daily(spark, sf):
    """Daily counts of source B, written once for all that a query reads from them."""
    return testbed._scoped(("b_daily", sf), lambda: cut_lineage(intake.b_daily_both(spark, sf), "b_daily"))


@register("combine_sources")
def q_combine_sources(spark, sf):
    return series.combine_sources(intake.source_a_daily(spark, sf), intake.source_b_daily(spark, sf, both=_b_daily(spark, sf)))


@register("patch_dim")
def q_patch_dim(spark, sf):
    return intake.patch_table(spark, sf)


@register("patch_values")
def q_patch_values(spark, sf):
    return series.patch_values(q_combine_sources(spark, sf), intake.patch_table(spark, sf, both=_b_daily(spark, sf)))


@register("patch_copy")
def q_patch_copy(spark, sf):
    return series.patch_copy(q_patch_values(spark, sf), list(P.patch_rules))


@register("intake_series")
def q_intake_series(spark, sf):
    return intake.intake_series(spark, sf)


# --------------------------------------------------------------------- text series --


def _parsed(spark, sf):
    return series.parse_series_text(testbed.balance_lines(spark, sf))


@register("parse_grouped_number")
def q_parse_grouped_number(spark, sf):
    from ..functions.numeric import parse_grouped_number
    lines = testbed.balance_lines(spark, sf)
    return lines.select(S, "Date", parse_grouped_number("Open Balances").alias("y"))


@register("load_series_text")
def q_load_series_text(spark, sf):
    """Write the derived text series as tab-separated files, detect the separator, read and parse it."""
    path = scratch_path(spark, "series_text")
    testbed.balance_lines(spark, sf).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return series.parse_series_text(series.read_series_text(spark, path))


@register("drop_nulls")
def q_drop_nulls(spark, sf):
    return filters.drop_nulls(_parsed(spark, sf), ["ds", "y"])


@register("trim_plateau")
def q_trim_plateau(spark, sf):
    return series.trim_plateau(q_drop_nulls(spark, sf))


@register("interpolate")
def q_interpolate(spark, sf):
    return series.interpolate(q_drop_nulls(spark, sf))


@register("clean_series")
def q_clean_series(spark, sf):
    return testbed.balance_series(spark, sf)


def _resample(freq):
    def q(spark, sf):
        return series.resample_all(testbed.balance_series(spark, sf), freq)
    return q


register("resample_week")(_resample("W"))
register("resample_week_mon")(_resample("W-MON"))
register("resample_month")(_resample("M"))


@register("weekday_profile")
def q_weekday_profile(spark, sf):
    x = features.calendar_features(testbed.balance_series(spark, sf))
    return x.groupBy(S, "wday", "weekday_name").agg(F.round(F.avg("y"), 6).alias("y_mean"))


@register("split_fixed")
def q_split_fixed(spark, sf):
    return testbed.fixed_split(testbed.modelling_series(spark, sf))


@register("split_tail")
def q_split_tail(spark, sf):
    return filters.split_tail(testbed.balance_series(spark, sf), T.validation_days)


@register("preview_head")
def q_preview_head(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy(S).orderBy("ds")
    x = testbed.balance_series(spark, sf).withColumn("rn", F.row_number().over(w))
    return x.where(F.col("rn") <= 5)


@register("extend_horizon")
def q_extend_horizon(spark, sf):
    return series.extend_horizon(testbed.balance_series(spark, sf), series.default_horizon("D"), "D")


@register("sink_horizon")
def q_sink_horizon(spark, sf):
    hist = testbed.balance_series(spark, sf)
    return series.horizon_only(series.extend_horizon(hist, series.default_horizon("D"), "D"), hist)


@register("yearend_window")
def q_yearend_window(spark, sf):
    return features.yearend_window(testbed.balance_series(spark, sf))


@register("fourier_features")
def q_fourier_features(spark, sf):
    x = testbed.balance_series(spark, sf).select(S, "ds")
    x = features.fourier_features(x, 7.0, 3, "weekly", digits=6)
    return features.fourier_features(x, 365.25, 3, "yearly", digits=6)


# ------------------------------------------------------------------------- features --


@register("calendar")
def q_calendar(spark, sf):
    return series.calendar(counting.date_bounds(testbed.modelling_series(spark, sf)))


@register("calendar_features")
def q_calendar_features(spark, sf):
    return features.calendar_features(testbed.modelling_series(spark, sf))


def _series_holidays(spark, sf):
    """Holidays of the years of the intake series."""
    return testbed.holidays(spark, sf, testbed.modelling_series(spark, sf))


@register("holiday_clean")
def q_holiday_clean(spark, sf):
    raw = testbed.holidays_raw(spark, sf)
    return raw.select("ds", F.col("holiday").alias("raw_name"), clean_holiday_name("holiday").alias("holiday"), "is_ph")


@register("holiday_code")
def q_holiday_code(spark, sf):
    x = features.holiday_join(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))
    return x.select(S, "ds", "holiday", holiday_code("holiday").alias("holiday_code"))


@register("holiday_join")
def q_holiday_join(spark, sf):
    return features.holiday_join(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))


@register("holiday_range")
def q_holiday_range(spark, sf):
    bounds = counting.date_bounds(testbed.modelling_series(spark, sf))
    return features.holiday_range(bounds, testbed.holidays(spark, sf))


@register("holiday_window")
def q_holiday_window(spark, sf):
    return features.holiday_window(testbed.holidays(spark, sf), 0, 1)


def _feasts(spark, sf):
    return feasts.feast_calendar(testbed.modelling_series(spark, sf))


@register("feast_calendar")
def q_feast_calendar(spark, sf):
    return _feasts(spark, sf)


@register("feast_effect")
def q_feast_effect(spark, sf):
    return feasts.feast_effect(testbed.modelling_series(spark, sf), _feasts(spark, sf))


@register("holiday_flags")
def q_holiday_flags(spark, sf):
    return features.holiday_flags(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))


@register("lag_flag")
def q_lag_flag(spark, sf):
    x = features.holiday_join(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))
    return features.lag_flag(x, "is_ph", 1).select(S, "ds", "is_ph", "is_ph_lag1")


@register("lag_features")
def q_lag_features(spark, sf):
    return features.lag_features(testbed.modelling_series(spark, sf), "y", 14)


@register("feature_frame")
def q_feature_frame(spark, sf):
    return features.feature_frame(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))


# --------------------------------------------------------------------- folds, grids --


def _bounds(spark, sf):
    return testbed.cv_bounds(testbed.modelling_series(spark, sf))


@register("folds_rolling")
def q_folds_rolling(spark, sf):
    return folds.folds_rolling(_bounds(spark, sf), T.roll_train, T.roll_horizon, T.roll_step)


@register("cutoffs_monthly")
def q_cutoffs_monthly(spark, sf):
    b = _bounds(spark, sf)
    return b.select(F.posexplode(folds.month_starts(b, T.cutoff_horizon)).alias("i", "cutoff"))


@register("folds_cutoff")
def q_folds_cutoff(spark, sf):
    return folds.folds_cutoff(_bounds(spark, sf), T.cutoff_horizon)


@register("fold_expand")
def q_fold_expand(spark, sf):
    x = testbed.cv_slice(testbed.modelling_series(spark, sf))
    return folds.fold_expand(x, q_folds_rolling(spark, sf)).select(S, "ds", "y", "fold", "role")


# --- fixed values (grids of the original programs) -----------------------------------------
BALANCE_CPS_GRID = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5]
STRUCTURAL_GRID = {"changepoint_prior_scale": [0.001], "seasonality_prior_scale": [0.01, 0.05],
                   "holidays_prior_scale": [0.01]}
TREE_GRID = {"max_depth": [2, 3, 4, 5, 6], "min_data_in_leaf": [10, 15, 20, 25, 30, 35, 40, 45, 50],
             "learning_rate": [0.25, 0.5, 1.0, 1.5], "objective": ["regression"]}
# ---------------------------------------------------------------------------------------------


def _series_keys(spark, sf):
    return testbed.modelling_series(spark, sf).select(S).distinct()


@register("grid_params")
def q_grid_params(spark, sf):
    return folds.grid_params(_series_keys(spark, sf), {"changepoint_prior_scale": BALANCE_CPS_GRID})


@register("grid_tree")
def q_grid_tree(spark, sf):
    return folds.tree_grid(_series_keys(spark, sf), TREE_GRID)


# ------------------------------------------------- checkable model, scoring and blend --

TW_MODELS = ["trend_weekday_add", "trend_weekday_mul"]


def _tw(spark, sf, mode):
    x = testbed.modelling_series(spark, sf)
    return trend_weekday(testbed.cv_slice(x), testbed.test_slice(x), [S], mode)


@register("trend_weekday")
def q_trend_weekday(spark, sf):
    return _tw(spark, sf, "mul")


@register("all_forecasts")
def q_all_forecasts(spark, sf):
    return _tw(spark, sf, "both")


@register("round_forecast")
def q_round_forecast(spark, sf):
    return _tw(spark, sf, "mul").select(S, "ds", "fcst", round_half_even("fcst").alias("fcst_round"))


@register("clip_forecast")
def q_clip_forecast(spark, sf):
    return _tw(spark, sf, "add").select(S, "ds", "fcst", floor_zero("fcst").alias("fcst_clipped"))


@register("pivot_models")
def q_pivot_models(spark, sf):
    return scoring.pivot_models(q_all_forecasts(spark, sf), TW_MODELS)


@register("blend")
def q_blend(spark, sf):
    return scoring.blend(q_all_forecasts(spark, sf), TW_MODELS)


@register("score_join")
def q_score_join(spark, sf):
    actual = testbed.test_slice(testbed.modelling_series(spark, sf))
    return scoring.score_join(actual, _tw(spark, sf, "mul"))


@register("forecast_with_actuals")
def q_forecast_with_actuals(spark, sf):
    hist = testbed.modelling_series(spark, sf)
    future = series.extend_horizon(hist, series.default_horizon("D"), "D")
    fc = trend_weekday(hist, future, [S], "mul").select(S, "ds", "fcst", "lo", "hi")
    return scoring.forecast_with_actuals(fc, hist)


def _metric(name):
    def q(spark, sf):
        return scoring.single_metric(q_all_forecasts(spark, sf), [S, "model"], name)
    return q


for _m in ("mae", "rmse", "mape", "kpi", "wkpi"):
    register(f"metric_{_m}")(_metric(_m))


def _fold_rows(spark, sf):
    """Both checkable models backtested on the rolling folds (one fit per series × fold)."""
    x = folds.expand_rolling(testbed.cv_slice(testbed.modelling_series(spark, sf)), T.cv_start, T.cv_end,
                             T.roll_train, T.roll_horizon, T.roll_step)
    return trend_weekday_rows(x.select(S, "fold", "ds", "y", "role"), [S, "fold"], "both")


@register("fold_metrics")
def q_fold_metrics(spark, sf):
    m = scoring.metric_table(_fold_rows(spark, sf), ["model", S, "fold"])
    return m.withColumn("run", F.lit("rolling_730_60_30"))


MEASURES = ["mae", "rmse", "mape", "kpi", "wkpi"]


def _metric_log(spark, sf):
    """The rolling folds are logged twice (as by a restarted job) around a run of the validation tail."""
    path = scratch_path(spark, "metric_log")
    rolling = cut_lineage(q_fold_metrics(spark, sf), "fold_scores")
    log_metrics(rolling.where("fold % 2 = 0"), path, "rolling_730_60_30", MEASURES)
    log_metrics(scoring.metric_table(_validation_scores(spark, sf), [S, "model"]), path, "validation_tail", MEASURES)
    log_metrics(rolling, path, "rolling_730_60_30", MEASURES)
    return read_log(spark, path)


@register("metric_log")
def q_metric_log(spark, sf):
    """Two runs and one repeat leave two runs."""
    return _metric_log(spark, sf)


@register("compare_runs")
def q_compare_runs(spark, sf):
    return compare_runs(_metric_log(spark, sf), "rolling_730_60_30", "validation_tail")


@register("cv_mean")
def q_cv_mean(spark, sf):
    return scoring.cv_mean(q_fold_metrics(spark, sf), [S, "model"], "wkpi")


@register("cv_pooled")
def q_cv_pooled(spark, sf):
    return scoring.cv_pooled(_fold_rows(spark, sf), [S, "model"])


@register("metrics_by_horizon")
def q_metrics_by_horizon(spark, sf):
    x = testbed.cv_slice(testbed.modelling_series(spark, sf))
    fx = folds.fold_expand(x, q_folds_cutoff(spark, sf)).withColumn("cutoff", F.date_sub("test_start", 1))
    rows = trend_weekday_rows(fx.select(S, "fold", "cutoff", "ds", "y", "role"), [S, "fold", "cutoff"], "mul")
    return scoring.metrics_by_horizon(rows, [S, "model"])


def _validation_scores(spark, sf):
    x = filters.split_tail(testbed.modelling_series(spark, sf), T.validation_days)
    tr, va = x.where(F.col("split") == "train"), x.where(F.col("split") == "valid")
    fc = trend_weekday(tr, va, [S], "both")
    return fc.withColumn("param_id", F.when(F.col("model") == "trend_weekday_mul", 1).otherwise(2))


@register("grid_scores")
def q_grid_scores(spark, sf):
    m = scoring.metric_table(_validation_scores(spark, sf), [S, "param_id", "model"])
    return m.select(S, "param_id", "model", "mae", "rmse", "mape")


@register("best_params")
def q_best_params(spark, sf):
    return scoring.best_params(q_grid_scores(spark, sf), [S], "mae")


@register("scoreboard")
def q_scoreboard(spark, sf):
    test = scoring.single_metric(q_all_forecasts(spark, sf), [S, "model"], "wkpi")
    cv = q_cv_mean(spark, sf).select(S, "model", F.col("cv_mean_wkpi"))
    return test.withColumnRenamed("wkpi", "test_wkpi").join(cv, [S, "model"], "full")


@register("sink_full")
def q_sink_full(spark, sf):
    """Write history + forecast partitioned by series, read it back."""
    path = scratch_path(spark, "forecast_full")
    write_series(q_forecast_with_actuals(spark, sf), path)
    return spark.read.parquet(path)


# ------------------------------------------------------------- models (rows-only checks) --
# The three fitted models of the original programs, re-aimed as Spark jobs over every
# series at once. SQL cannot state their solvers, so they carry no oracle.

from ..models import arx as arx_model  # noqa: E402
from ..models import gbt as gbt_model  # noqa: E402
from ..models import sarima as sarima_model  # noqa: E402
from ..models import structural  # noqa: E402

# --- fixed values (the original's live tree parameters) -------------------------------------
LIVE_TREE = {"max_depth": 2, "min_data_in_leaf": 10, "learning_rate": 0.25, "objective": "regression",
             "num_leaves": 3, "num_iterations": 300}
# ---------------------------------------------------------------------------------------------


#: Set of the recursive forecast.
RECURSIVE_TREE = dict(LIVE_TREE, max_depth=3, num_leaves=5, num_iterations=100)


def tree_sets(**picked) -> list[dict]:
    """The sets of ``TREE_GRID`` with the picked values, numbered as in ``grid_tree``."""
    import itertools
    out = []
    for i, combo in enumerate(itertools.product(*TREE_GRID.values()), 1):
        p = dict(zip(TREE_GRID, combo), param_id=i)
        if all(p[k] in v for k, v in picked.items()):
            out.append(dict(p, num_iterations={0.25: 300, 0.5: 200}.get(p["learning_rate"], 100)))
    return out


#: Sets that the tree backtest compares: eight of the grid, of 100 rounds each.
TREE_SETS = tree_sets(learning_rate=[1.0], max_depth=[2, 3], min_data_in_leaf=[10, 20, 30, 50])


def _structural_grid():
    import itertools
    keys = list(STRUCTURAL_GRID)
    return [dict(zip(keys, combo), param_id=i)
            for i, combo in enumerate(itertools.product(*[STRUCTURAL_GRID[k] for k in keys]), 1)]


def _split_rows(spark, sf):
    """Intake series with ``role`` train (CV window) / test (hold-out window)."""
    return testbed.fixed_split(testbed.modelling_series(spark, sf)).withColumn(
        "role", F.when(F.col("split") == "train", "train").otherwise("test")).drop("split")


HOLIDAY_NAMES = tuple(name for _, _, name in features.FIXED_HOLIDAYS)


def _windows(spark, sf):
    days = features.holiday_window(_series_holidays(spark, sf), 0, 1)
    return structural.HolidayWindows(days, HOLIDAY_NAMES, 0, 1)


@register("forecast_structural")
def q_forecast_structural(spark, sf):
    return structural.forecast_structural(_split_rows(spark, sf), _structural_grid(), [S],
                                          structural.INTAKE_SPEC, _windows(spark, sf))


def _arx_rows(spark, sf):
    return arx_model.with_lags(_calendar_rows(spark, sf))


@register("forecast_arx")
def q_forecast_arx(spark, sf):
    rows = testbed.fixed_split(_arx_rows(spark, sf)).withColumn("role", F.col("split")).drop("split")
    return arx_model.forecast_arx(rows, [S])


def _rolling(x):
    """The CV window of a frame expanded to the rolling folds."""
    return folds.expand_rolling(testbed.cv_slice(x), T.cv_start, T.cv_end, T.roll_train, T.roll_horizon, T.roll_step)


def _fold_scores(fc, keys):
    return scoring.cv_mean(scoring.metric_table(fc, [*keys, "fold"]), keys, "wkpi")


@register("backtest_arx")
def q_backtest_arx(spark, sf):
    """Autoregression over the rolling folds: mean of the fold scores and pooled score per series."""
    fc = cut_lineage(arx_model.forecast_arx(_rolling(_arx_rows(spark, sf)), [S, "fold"]))
    return _fold_scores(fc, [S]).join(scoring.cv_pooled(fc, [S]), S)


def _calendar_rows(spark, sf):
    return features.calendar_features(features.holiday_flags(testbed.modelling_series(spark, sf),
                                                             _series_holidays(spark, sf)).drop("wday"))


@register("forecast_sarima")
def q_forecast_sarima(spark, sf):
    """Seasonal ARIMA by stepwise search, fitted on the CV window, forecast over the test window."""
    rows = testbed.fixed_split(_calendar_rows(spark, sf)).withColumn("role", F.col("split")).drop("split")
    return sarima_model.forecast_sarima(rows, [S])


def _gbt_frames(spark, sf):
    ff = features.feature_frame(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))
    return testbed.cv_slice(ff), testbed.test_slice(ff)


def _tree_frame(spark, sf):
    return features.feature_frame(testbed.modelling_series(spark, sf), _series_holidays(spark, sf))


def _hold_out(x):
    """One fold: the CV window to train on, the test window to score."""
    return testbed.fixed_split(x).withColumn("role", F.col("split")).drop("split").withColumn("fold", F.lit(1))


@register("forecast_gbt")
def q_forecast_gbt(spark, sf):
    """The live tree set on binned features, fitted on the CV window, scored on the test window."""
    fc = gbt_model.forecast_folds(_tree_frame(spark, sf), [dict(LIVE_TREE, param_id=1)], _hold_out)
    return fc.drop("param_id", "fold")


@register("forecast_gbt_global")
def q_forecast_gbt_global(spark, sf):
    """One ``pyspark.ml`` model over all series (series index as a feature)."""
    train, test = _gbt_frames(spark, sf)
    return gbt_model.fit_predict(train, test, LIVE_TREE)


@register("forecast_gbt_recursive")
def q_forecast_gbt_recursive(spark, sf):
    """One ``pyspark.ml`` model over all series, fitted on all history; the next 90 days, each
    step from the forecasts before it."""
    hist, n = testbed.modelling_series(spark, sf), series.default_horizon("D")
    long = series.extend_horizon(hist, n, "D")
    ff = features.feature_frame(long, testbed.holidays(spark, sf, long))
    model, level = gbt_model.fit(ff.where(F.col("y").isNotNull()), RECURSIVE_TREE)
    return gbt_model.forecast_recursive(model, level, hist, ff.where(F.col("y").isNull()), n)


def _wide_folds(x):
    """The CV window expanded to a few rolling folds, half a year apart, for models with costly fits."""
    return folds.expand_rolling(testbed.cv_slice(x), T.cv_start, T.cv_end, T.roll_train, T.roll_horizon, T.wide_step)


@register("backtest_gbt")
def q_backtest_gbt(spark, sf):
    """Tree sets of the grid over rolling folds: mean fold KPI per series and set (no scored fold
    → inf), lowest chosen. Each fold and set is one ``pyspark.ml`` fit over all series."""
    fc = cut_lineage(gbt_model.forecast_folds(_tree_frame(spark, sf), TREE_SETS, _wide_folds))
    mean = _fold_scores(fc, [S, "param_id"])
    best = scoring.best_params(mean, [S], "cv_mean_wkpi").select(S, F.col("param_id").alias("_best"))
    return mean.join(best, S).withColumn("is_best", F.col("param_id") == F.col("_best")).drop("_best")


def _model_forecasts(spark, sf):
    """Each model's hold-out forecast in the ``series_id, ds, model, actual, fcst`` shape."""
    st = q_forecast_structural(spark, sf).where(F.col("param_id") == 1)
    ax = q_forecast_arx(spark, sf)
    gb = q_forecast_gbt(spark, sf)
    cols = [S, "ds", "model", "actual", "fcst"]
    return (st.withColumn("model", F.lit("structural")).select(*cols)
            .unionByName(ax.withColumn("model", F.lit("arx")).select(*cols))
            .unionByName(gb.withColumn("model", F.lit("gbt")).select(*cols)))


ENSEMBLE = ["arx", "gbt", "structural"]


@register("ensemble_forecast")
def q_ensemble_forecast(spark, sf):
    return scoring.blend(_model_forecasts(spark, sf), ENSEMBLE)


def _cv_boards(spark, sf):
    """Mean fold score of each model over the same wide folds (trees: the first set of the backtest)."""
    parts = {"structural": _structural_folds(spark, sf, _structural_grid()[:1], _wide_folds),
             "arx": arx_model.forecast_arx(_wide_folds(_arx_rows(spark, sf)), [S, "fold"]),
             "gbt": gbt_model.forecast_folds(_tree_frame(spark, sf), TREE_SETS[:1], _wide_folds)}
    rows = [fc.select(S, F.lit(name).alias("model"), "fold", "actual", "fcst") for name, fc in parts.items()]
    return _fold_scores(cut_lineage(rows[0].unionByName(rows[1]).unionByName(rows[2])), [S, "model"])


@register("model_scoreboard")
def q_model_scoreboard(spark, sf):
    """Hold-out measures of the three models next to their mean score over the rolling folds."""
    fc = cut_lineage(_model_forecasts(spark, sf))  # each model fitted once
    raw = scoring.metric_table(fc, [S, "model"])
    rounded = scoring.single_metric(fc.withColumn("fcst", round_half_even("fcst")), [S, "model"], "wkpi")
    board = raw.join(rounded.withColumnRenamed("wkpi", "wkpi_rounded"), [S, "model"])
    return board.join(_cv_boards(spark, sf), [S, "model"], "left")


def _structural_folds(spark, sf, grid, folds_of=_rolling):
    rows = folds_of(testbed.modelling_series(spark, sf)).select(S, "fold", "ds", "y", "role")
    return structural.forecast_structural(rows, grid, [S, "fold"], structural.INTAKE_SPEC, _windows(spark, sf))


@register("backtest")
def q_backtest(spark, sf):
    """Structural model over rolling folds × grid → per series and parameter set: mean of
    fold scores, pooled score and fold count, plus the chosen set."""
    fc = cut_lineage(_structural_folds(spark, sf, _structural_grid()))
    board = _fold_scores(fc, [S, "param_id"]).join(scoring.cv_pooled(fc, [S, "param_id"]), [S, "param_id"])
    best = scoring.best_params(board, [S], "cv_mean_wkpi").select(S, F.col("param_id").alias("_best"))
    out = board.join(best, S).withColumn("is_best", F.col("param_id") == F.col("_best")).drop("_best")
    return scoring.with_grid_mean(out, [S], "cv_mean_wkpi")


def _cutoff_folds(spark, sf, grid):
    """Forecasts of the structural model refitted at every month-start cutoff, without holidays
    as in the original's loop."""
    x = testbed.cv_slice(testbed.modelling_series(spark, sf))
    rows = folds.fold_expand(x, folds.folds_cutoff(_bounds(spark, sf), T.cutoff_horizon))
    rows = rows.withColumn("cutoff", F.date_sub("test_start", 1)).select(S, "fold", "cutoff", "ds", "y", "role")
    return structural.forecast_structural(rows, grid, [S, "fold", "cutoff"], structural.INTAKE_SPEC)


@register("backtest_cutoff")
def q_backtest_cutoff(spark, sf):
    """The original's live tuning loop: structural model refitted at every month-start cutoff
    (train on all days up to it, score the next 60), pooled weighted KPI per parameter set over
    all cutoff rows, arg-min chosen, plus the mean over the grid."""
    pooled = scoring.cv_pooled(cut_lineage(_cutoff_folds(spark, sf, _structural_grid())), [S, "param_id"])
    best = scoring.best_params(pooled, [S], "cv_pooled_wkpi").select(S, F.col("param_id").alias("_best"))
    out = pooled.join(best, S).withColumn("is_best", F.col("param_id") == F.col("_best")).drop("_best")
    return scoring.with_grid_mean(out, [S], "cv_pooled_wkpi")


@register("horizon_structural")
def q_horizon_structural(spark, sf):
    """Errors and band coverage of the structural model by days ahead over the cutoff folds."""
    return scoring.metrics_by_horizon(_cutoff_folds(spark, sf, _structural_grid()), [S, "param_id"])


@register("tuned_forecast")
def q_tuned_forecast(spark, sf):
    """Refit on all history with each series' best set and forecast the next 90 days."""
    rows = series.extend_horizon(testbed.modelling_series(spark, sf), 90, "D").withColumn(
        "role", F.when(F.col("y").isNotNull(), "train").otherwise("test"))
    best = q_backtest(spark, sf).where("is_best").select(S, F.col("param_id").alias("best"))
    return structural.forecast_structural(rows.join(best, S, "left"), _structural_grid(), [S],
                                          structural.INTAKE_SPEC, _windows(spark, sf), chosen="best")


# ------------------------------------------------------------------------ balance flow --

BALANCE_GRID = [{"changepoint_prior_scale": c, "param_id": i} for i, c in enumerate(BALANCE_CPS_GRID, 1)]


def _yearend(bal):
    days = features.yearend_window(bal).select("ds", "holiday", "offset").distinct()
    return structural.HolidayWindows(days, ("year_end_spike",), -14, 31)


@register("components")
def q_components(spark, sf):
    bal = testbed.balance_series(spark, sf)
    rows = bal.withColumn("role", F.lit("train"))
    return structural.components(rows, BALANCE_GRID[1], [S], structural.balance_spec("D"), _yearend(bal))


def _grid_scores(spark, sf, freq):
    """Last 90 days held out, both sides resampled to ``freq``, every changepoint scale scored."""
    bal = testbed.balance_series(spark, sf)
    split = series.resample_split(bal, T.validation_days, freq)
    rows = split.withColumn("role", F.when(F.col("split") == "train", "train").otherwise("test"))
    val = structural.forecast_structural(rows, BALANCE_GRID, [S], structural.balance_spec(freq), _yearend(bal))
    return scoring.metric_table(val, [S, "param_id"]).select(S, "param_id", "mae", "rmse", "mape")


@register("balance_grid_scores")
def q_balance_grid_scores(spark, sf):
    """Score table of the balance grid on days, weeks and months."""
    tables = [_grid_scores(spark, sf, f).withColumn("freq", F.lit(f)) for f in ("D", "W", "M")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _tuned_balance(freq):
    def q(spark, sf):
        bal = testbed.balance_series(spark, sf)
        hist = series.resample(bal, freq)
        best = scoring.best_params(_grid_scores(spark, sf, freq), [S], "mae").select(S, F.col("param_id").alias("best"))
        rows = series.extend_horizon(hist, series.default_horizon(freq), freq).withColumn(
            "role", F.when(F.col("y").isNotNull(), "train").otherwise("test"))
        final = structural.forecast_structural(rows.join(best, S, "left"), BALANCE_GRID, [S],
                                               structural.balance_spec(freq), _yearend(bal), chosen="best")
        return scoring.forecast_with_actuals(final.select(S, "ds", "fcst", "lo", "hi"), hist)

    q.__doc__ = f"""Balance flow at frequency {freq}: last 90 days held out, six changepoint scales scored by MAE,
    the best refitted on all history and forecast {series.default_horizon(freq)} steps, joined back to the history."""
    return q


for _key, _freq in (("tune_balance", "D"), ("tune_balance_week", "W"), ("tune_balance_month", "M")):
    register(_key)(_tuned_balance(_freq))
