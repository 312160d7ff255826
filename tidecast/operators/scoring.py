"""Scoring: joins of forecasts to actuals, metric tables, fold averages, best settings, blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.numeric import floor_zero, round_half_even
from .common import SERIES


def score_join(actuals: DataFrame, forecasts: DataFrame, keys=(SERIES, "ds")) -> DataFrame:
    """Actuals left-joined to forecasts on (series, day): a missing forecast stays null."""
    return actuals.select(*keys, F.col("y").cast("double").alias("actual")).join(
        forecasts.select(*keys, "fcst"), list(keys), "left")


def forecast_with_actuals(forecasts: DataFrame, history: DataFrame, keys=(SERIES, "ds")) -> DataFrame:
    """Forecast rows left-joined to history; future rows get a null ``y``."""
    return forecasts.join(history.select(*keys, F.col("y").cast("double").alias("y")), list(keys), "left")


def metric_table(scored: DataFrame, keys: list[str], actual="actual", fcst="fcst", digits: int | None = 6) -> DataFrame:
    """MAE, RMSE, MAPE, plain KPI, weighted KPI and matched rows per key, in one aggregate."""
    return scored.groupBy(*keys).agg(*M.all_measures(actual, fcst, digits))


def single_metric(scored: DataFrame, keys: list[str], name: str, digits: int = 6) -> DataFrame:
    fn = {"mae": M.mae, "rmse": M.rmse, "mape": M.mape, "kpi": M.kpi, "wkpi": M.weighted_kpi}[name]
    return scored.groupBy(*keys).agg(F.round(fn("actual", "fcst"), digits).alias(name))


def cv_mean(fold_scores: DataFrame, keys: list[str], score: str = "wkpi", digits: int = 6) -> DataFrame:
    """Mean of per-fold scores per key; a key with no scored fold gets +inf."""
    return fold_scores.groupBy(*keys).agg(
        F.round(F.coalesce(F.avg(score), F.lit(float("inf"))), digits).alias(f"cv_mean_{score}"),
        F.count(score).alias("n_folds"))


def with_grid_mean(scores: DataFrame, keys: list[str], score: str, digits: int = 6) -> DataFrame:
    """Add the mean of ``score`` over every parameter set of a key (the grid-wide average)."""
    from pyspark.sql import Window
    return scores.withColumn(f"grid_mean_{score}", F.round(F.avg(score).over(Window.partitionBy(*keys)), digits))


def cv_pooled(fold_rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Weighted KPI over all fold rows of a key at once (folds ignored)."""
    return fold_rows.groupBy(*keys).agg(F.round(M.weighted_kpi("actual", "fcst"), digits).alias("cv_pooled_wkpi"))


def best_params(scores: DataFrame, keys: list[str], score: str, param_id: str = "param_id") -> DataFrame:
    """Lowest score per key; ties go to the lowest ``param_id``."""
    best = F.min(F.struct(F.col(score), F.col(param_id))).alias("_b")
    return scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(best).select(
        *keys, F.col(f"_b.{param_id}").alias(param_id), F.col(f"_b.{score}").alias(score))


def metrics_by_horizon(fold_rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Per key and days-ahead ``h``: MAE, RMSE, MAPE and the share of actuals inside the band."""
    x = fold_rows.withColumn("h", F.datediff("ds", "cutoff"))
    inside = F.when(F.col("actual").isNotNull() & F.col("lo").isNotNull(),
                    F.when(F.col("actual").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0))
    return x.groupBy(*keys, "h").agg(
        F.round(M.mae("actual", "fcst"), digits).alias("mae"),
        F.round(M.rmse("actual", "fcst"), digits).alias("rmse"),
        F.round(M.mape("actual", "fcst"), digits).alias("mape"),
        F.round(F.avg(inside), digits).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def pivot_models(forecasts: DataFrame, models: list[str], keys=(SERIES, "ds"), value: str = "fcst") -> DataFrame:
    """One column per model holding the mean of that model's rows per key (listed models only,
    so the pivot needs no extra pass to find them)."""
    return forecasts.groupBy(*keys).pivot("model", models).agg(F.avg(value))


def blend(forecasts: DataFrame, models: list[str], keys=(SERIES, "ds")) -> DataFrame:
    """Hybrid forecast: per key, mean over models of each model's (rounded) mean forecast,
    rounded half-even, then every model column and the hybrid floored at 0. The actual is
    attached once per key (its largest value if rows disagree).

    One aggregate does the pivot and the actual together (a single shuffle on the key).
    """
    f = round_half_even("fcst")
    aggs = [F.avg(F.when(F.col("model") == F.lit(m), f)).alias(m) for m in models]
    wide = forecasts.groupBy(*keys).agg(*aggs, F.max(F.col("actual").cast("double")).alias("actual"))
    vals = [F.col(f"`{m}`") for m in models]
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    wide = wide.withColumn("hybrid", round_half_even(F.when(n > 0, total / n)))
    return wide.select(*keys, *[floor_zero(F.col(f"`{c}`")).alias(c) for c in models + ["hybrid"]], "actual")
