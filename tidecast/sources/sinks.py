"""Sinks: history + forecast tables and the next-horizon extract."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.series import horizon_only


def write_series(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "series_id",
                 mode: str = "overwrite", order_by: str = "ds") -> None:
    """Write a forecast frame, one folder per series (later reads prune by series); every file is
    in day order, by a sort within the tasks."""
    w = df.sortWithinPartitions(*[c for c in (partition_by, order_by) if c]).write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)


def write_horizon(forecast: DataFrame, history: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Only the rows after each series' last observed day."""
    write_series(horizon_only(forecast, history), path, fmt)
