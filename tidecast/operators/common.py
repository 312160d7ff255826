"""Shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series_id"

def series_window(series: str = SERIES, order: str = "ds") -> Window:
    """One window spec per series ordered by day; every lag shares its sort."""
    return Window.partitionBy(series).orderBy(order)


def lit_date(value: str):
    return F.lit(value).cast("date")


def fit_partitions(spark) -> int:
    """Partitions for per-group model fits: a few per core, never fewer than the shuffle setting."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism * 4, shuffle)


def spread_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by the group keys into a fixed number of partitions before a grouped
    pandas fit. The groups are small but costly; a fixed-number repartition is not merged by
    adaptive coalescing, so fits stay spread over every core, and the following ``groupBy``
    reuses this partitioning (no second exchange)."""
    return df.repartition(fit_partitions(df.sparkSession), *keys)
