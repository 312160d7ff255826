"""Backtest folds, parameter grids and the expansion of series rows into folds.

A fold table has ``fold, train_start, train_end, test_start, test_end`` with half-open
ranges ``[train_start, train_end)`` and ``[test_start, test_end)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SERIES, lit_date
from .intervals import interval_join


def folds_rolling(bounds: DataFrame, train_days: int, horizon: int, step: int) -> DataFrame:
    """Rolling folds from ``start``: train ``train_days``, test ``horizon`` right after, move by
    ``step``; a fold is kept while its test end is on or before ``end``.

    ``bounds`` is a one-row frame ``start, end`` (e.g. from ``date_bounds``).
    """
    n = F.floor((F.datediff("end", "start") - train_days - horizon) / step) + 1
    k = F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    x = bounds.select("start", k.alias("k"))
    ts = F.date_add("start", F.col("k") * step)
    return x.select(
        (F.col("k") + 1).alias("fold"),
        ts.alias("train_start"),
        F.date_add(ts, train_days).alias("train_end"),
        F.date_add(ts, train_days).alias("test_start"),
        F.date_add(ts, train_days + horizon).alias("test_end"),
    )


def month_starts(bounds: DataFrame, horizon: int, min_train_days: int = 0):
    """Array of first days of months from ``start`` to ``end - horizon`` (``MS`` dates) that
    have at least ``min_train_days`` days of history."""
    last = F.date_sub("end", horizon)
    seq = F.sequence(F.trunc("start", "MM"), last, F.expr("INTERVAL 1 MONTH"))
    seq = F.when(F.trunc("start", "MM") <= last, seq).otherwise(F.array().cast("array<date>"))
    return F.filter(seq, lambda c: (c >= F.col("start")) & (F.datediff(c, F.col("start")) >= min_train_days))


def folds_cutoff(bounds: DataFrame, horizon: int, drop_first: int = 1, min_train_days: int = 0) -> DataFrame:
    """Expanding folds at month starts: train on every day up to the cutoff, test the
    ``horizon`` days after it. The first ``drop_first`` cutoffs are skipped, and so are
    cutoffs with fewer than ``min_train_days`` days of history."""
    x = bounds.select("start", F.posexplode(month_starts(bounds, horizon, min_train_days)).alias("_i", "cutoff"))
    x = x.where(F.col("_i") >= drop_first)
    return x.select(
        (F.col("_i") - drop_first + 1).alias("fold"),
        F.col("start").alias("train_start"),
        F.date_add("cutoff", 1).alias("train_end"),
        F.date_add("cutoff", 1).alias("test_start"),
        F.date_add("cutoff", horizon + 1).alias("test_end"),
        F.col("cutoff"),
    )


def fold_expand(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row into every fold whose train or test range holds its day, tagged ``role``: one
    interval join by day buckets."""
    f = folds.select("fold", "train_start", "train_end", "test_start", "test_end")
    f = f.withColumns({"_train_last": F.date_sub("train_end", 1), "_test_last": F.date_sub("test_end", 1)})
    j = interval_join(df, f, [("train_start", "_train_last"), ("test_start", "_test_last")]).drop("_train_last", "_test_last")
    return j.withColumn("role", F.when(F.col("ds") < F.col("train_end"), F.lit("train")).otherwise(F.lit("test")))


def expand_rolling(df: DataFrame, start, end, train_days: int, horizon: int, step: int) -> DataFrame:
    """Rolling-fold expansion without a join: a day ``d`` days after ``start`` lies in folds
    ``k`` with ``k·step ≤ d < k·step + train + horizon``, so the fold numbers are computed and
    exploded per row. Output rows = input rows × folds per row; no pairs are compared.

    ``start`` / ``end`` are the backtest window: ISO date strings (the usual case, as in the
    original program) or date Columns.
    """
    start = lit_date(start) if isinstance(start, str) else start
    end = lit_date(end) if isinstance(end, str) else end
    d = F.datediff(F.col("ds"), start)
    n = F.floor((F.datediff(end, start) - train_days - horizon) / step) + 1
    k_lo = F.greatest(F.lit(0), F.ceil((d - (train_days + horizon) + 1) / step))
    k_hi = F.least(n - 1, F.floor(d / step))
    ks = F.when((d >= 0) & (k_lo <= k_hi), F.sequence(k_lo.cast("int"), k_hi.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    x = df.withColumn("_k", F.explode(ks))
    ts = F.date_add(start, F.col("_k") * step)
    x = x.withColumns({
        "fold": F.col("_k") + 1,
        "train_start": ts,
        "train_end": F.date_add(ts, train_days),
        "test_start": F.date_add(ts, train_days),
        "test_end": F.date_add(ts, train_days + horizon),
    }).drop("_k")
    return x.withColumn("role", F.when(F.col("ds") < F.col("train_end"), F.lit("train")).otherwise(F.lit("test")))


def grid_column(params: dict[str, list]):
    """Array of structs holding the Cartesian product of ``params`` plus a ``param_id``.

    Explode it next to the rows that need it (e.g. one row per series); no join is made.
    """
    import itertools
    keys = list(params)
    rows = []
    for pid, combo in enumerate(itertools.product(*[params[k] for k in keys]), 1):
        rows.append(F.struct(F.lit(pid).alias("param_id"), *[F.lit(v).alias(k) for k, v in zip(keys, combo)]))
    return F.array(*rows)


def grid_params(keys_df: DataFrame, params: dict[str, list], key_cols=(SERIES,)) -> DataFrame:
    """One row per key row and parameter set (the work list of a tuning run)."""
    x = keys_df.select(*key_cols, F.explode(grid_column(params)).alias("_p"))
    return x.select(*key_cols, "_p.*")


def tree_grid(keys_df: DataFrame, params: dict[str, list], key_cols=(SERIES,)) -> DataFrame:
    """Tree grid with derived columns: ``num_leaves = round_half_even(2^depth · 0.8)`` and
    ``num_iterations`` 300 / 200 / 100 for learning rates 0.25 / 0.5 / other."""
    g = grid_params(keys_df, params, key_cols)
    lr = F.col("learning_rate")
    return g.withColumns({
        "num_leaves": F.bround(F.pow(F.lit(2.0), F.col("max_depth")) * 0.8, 0).cast("int"),
        "num_iterations": F.when(lr == 0.25, F.lit(300)).when(lr == 0.5, F.lit(200)).otherwise(F.lit(100)),
    })
