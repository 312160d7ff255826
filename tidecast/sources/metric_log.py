"""Metric log: one row per run, model, series, fold and metric, in a table of Parquet files.

A run's rows for a model are one partition. Logging replaces the partitions that the new rows
name and no others, so a repeated or restarted job leaves the log as if it had run once, and
jobs of other runs or models may log at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run", "model", "series_id", "fold")
#: Stated, so that a run named "2024" or a fold numbered 7 comes back as it was written.
SCHEMA = "series_id string, fold string, metric string, value double, run string, model string"


def long_metrics(scores: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """Scores of a wide metric table as ``run, model, series_id, fold, metric, value``.

    A missing ``fold`` column is the fold "all". Null scores are rows with a null value; columns
    that are neither keys nor named metrics are left out.
    """
    fold = F.col("fold").cast("string") if "fold" in scores.columns else F.lit("all")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return scores.select(F.lit(run).alias("run"), F.col("model").cast("string").alias("model"), F.col("series_id").cast("string").alias("series_id"),
                         fold.alias("fold"), F.inline(pairs))


def log_metrics(scores: DataFrame, path: str, run: str, metrics: list[str]) -> None:
    """Write the scores of ``run`` into the log at ``path``, in place of what it holds for the
    same run and models. Scores must not be read from the same log. An empty table changes nothing.
    """
    if not run:
        raise ValueError("a run needs a name")
    rows = long_metrics(scores, run, metrics)
    checked = rows.withColumn("model", F.when(F.length("model") > 0, F.col("model")).otherwise(F.raise_error(F.lit("a logged score needs a model name"))))
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "model").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``run, model, series_id, fold, metric, value``; filters on run and model prune folders."""
    return spark.read.schema(SCHEMA).parquet(path).select(*KEYS, "metric", "value")


def compare_runs(log: DataFrame, base: str, other: str, digits: int = 6) -> DataFrame:
    """Per model, series and metric: scored folds and mean value in two runs, and the change.

    One pass over the two runs' partitions; what only one run has is kept, with nulls beside it.
    """
    part = log.where(F.col("run").isin(base, other))

    def of(run: str, agg) -> Column:
        return agg(F.when(F.col("run") == run, F.col("value")))

    out = part.groupBy("model", "series_id", "metric").agg(
        of(base, F.count).alias("n_base"), of(other, F.count).alias("n_other"),
        F.round(of(base, F.avg), digits).alias("base"), F.round(of(other, F.avg), digits).alias("other"))
    return out.withColumn("change", F.round(F.col("other") - F.col("base"), digits))
