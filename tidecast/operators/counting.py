"""Case-level aggregations: dedupe, daily counts, bounds, stage funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SERIES


def dedupe_case(df: DataFrame, key: str = "case_id", order_by: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row first in ``order_by``, ties broken by every other column.

    Written as ``min(struct(...))`` so Spark aggregates partially before the shuffle: a key
    that holds a third of the rows is folded map-side to one row per task, and the kept row
    no longer depends on task order.
    """
    order_by = order_by or ["receipt_date"]
    rest = [c for c in df.columns if c != key and c not in order_by]
    packed = F.min(F.struct(*[F.col(c) for c in order_by + rest])).alias("_row")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"_row.{c}").alias(c) for c in order_by + rest])


def daily_count(df: DataFrame, date_col: str = "receipt_date", series: str = SERIES) -> DataFrame:
    """Rows per (series, day) → ``series_id, ds, y`` (bigint)."""
    return df.groupBy(series, F.col(date_col).alias("ds")).agg(F.count(F.lit(1)).alias("y"))


def date_bounds(df: DataFrame, date_col: str = "ds", series: str = SERIES) -> DataFrame:
    """First and last day per series, kept as a DataFrame (nothing collected)."""
    return df.groupBy(series).agg(F.min(date_col).alias("start"), F.max(date_col).alias("end"))


def stage_funnel(df: DataFrame, routed: str, key: str = "case_id", series: str = SERIES) -> DataFrame:
    """Rows scanned, rows routed and distinct routed cases per series in one pass.

    ``routed`` is the name of a boolean column marking rows that pass the routing filter.
    """
    r = F.col(routed)
    return df.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_scanned"),
        F.count_if(r).alias("n_routed"),
        F.count_distinct(F.when(r, F.col(key))).alias("n_unique"),
    )
