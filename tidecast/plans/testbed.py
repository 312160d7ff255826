"""Inputs in the reference's roles, derived from the driver tables, and the time settings.

* ``balance_lines``: a text series like the balances file (``Date`` day-first text,
  ``Open Balances`` comma-grouped text), one line per segment and order day, built from
  orders. Lines dated the 31st carry an unreadable date and lines dated the 15th an
  unreadable value, so parsing has rows to drop; days without orders are gaps.
* ``holidays``: fixed-date holidays for every year of a daily series (of the orders where no
  series is given).
* ``modelling_series``: the intake series (counts per segment and day).
"""

from __future__ import annotations

import contextlib
import contextvars
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import holiday_calendar, holiday_dim
from ..operators.filters import split_fixed
from ..operators.series import clean_series
from ..session import cut_lineage
from ..sources.tables import read_table
from . import intake


@dataclass(frozen=True)
class TimeParams:
    """Backtest and hold-out windows on the driver tables (our dates, the original's shape)."""

    cv_start: str = "1996-02-05"
    cv_end: str = "2001-03-25"
    test_start: str = "2001-03-26"
    test_end: str = "2001-06-10"
    validation_days: int = 90
    roll_train: int = 730
    roll_horizon: int = 60
    roll_step: int = 30
    wide_step: int = 480
    cutoff_horizon: int = 60


T = TimeParams()


def balance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    d = F.to_date("o_orderdate")
    # every order counts; those without a customer are series "unknown", as in the case tables
    keyed = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn("series_id", F.coalesce("series_id", F.lit("unknown")))
    daily = keyed.groupBy("series_id", d.alias("d")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100, 0).cast("bigint")).alias("cents"))
    date_txt = F.when(F.dayofmonth("d") == 31, F.lit("TBC")).otherwise(F.date_format("d", "d/M/yyyy"))
    value_txt = F.when(F.dayofmonth("d") == 15, F.lit("n/a")).otherwise(
        F.format_number(F.col("cents") / 100.0, 2))
    return daily.select("series_id", date_txt.alias("Date"), value_txt.alias("Open Balances"))


def balance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned daily balances per segment (parse, drop, trim, grid, interpolate), written to
    the checkpoint folder once: every consumer reads the small daily table, not the orders."""
    return _scoped(("balance", sf_dir), lambda: cut_lineage(clean_series(balance_lines(spark, sf_dir))))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ds"))


def holidays_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holiday_calendar(order_days(spark, sf_dir))


def holidays(spark: SparkSession, sf_dir: str, series: DataFrame | None = None) -> DataFrame:
    """The years come from the small daily ``series`` where one is given, else from the orders."""
    return holiday_dim(holidays_raw(spark, sf_dir) if series is None else holiday_calendar(series))


_SCOPE: contextvars.ContextVar[dict | None] = contextvars.ContextVar("tidecast_query_scope", default=None)


@contextlib.contextmanager
def query_scope():
    """Materialised inputs live for one query call: built once inside it, never shared
    between calls."""
    token = _SCOPE.set({})
    try:
        yield
    finally:
        _SCOPE.reset(token)


def _scoped(key, build):
    scope = _SCOPE.get()
    if scope is None:
        return build()
    if key not in scope:
        scope[key] = build()
    return scope[key]


def modelling_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake series, materialised once per query in the checkpoint folder. Models read
    it several times (fit, apply, spread); without the cut each read would redo the scans,
    joins and patches over the raw cases."""
    return _scoped(("intake", sf_dir), lambda: cut_lineage(intake.intake_series(spark, sf_dir)))


def cv_slice(df: DataFrame, t: TimeParams = T) -> DataFrame:
    return df.where(F.col("ds").between(F.lit(t.cv_start).cast("date"), F.lit(t.cv_end).cast("date")))


def test_slice(df: DataFrame, t: TimeParams = T) -> DataFrame:
    return df.where(F.col("ds").between(F.lit(t.test_start).cast("date"), F.lit(t.test_end).cast("date")))


def fixed_split(df: DataFrame, t: TimeParams = T) -> DataFrame:
    return split_fixed(df, (t.cv_start, t.cv_end), (t.test_start, t.test_end))


def cv_bounds(series_df: DataFrame, t: TimeParams = T) -> DataFrame:
    """One row ``start, end``: the data's first day (not before cv_start) to cv_end (not after
    the data's last day)."""
    return series_df.agg(
        F.greatest(F.min("ds"), F.lit(t.cv_start).cast("date")).alias("start"),
        F.least(F.max("ds"), F.lit(t.cv_end).cast("date")).alias("end"),
    )
