"""Row filters and splits (predicates the reference applies to cases and series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SERIES, lit_date


def filter_contains(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Keep rows whose ``col`` contains ``needle`` (case-sensitive; null is dropped)."""
    return df.where(F.col(col).contains(needle))


def filter_date_from(df: DataFrame, date_col: str, lower: str, raw_ts_col: str | None = None) -> DataFrame:
    """Keep ``date_col >= lower``.

    ``date_col`` is usually derived (``to_date`` of a timestamp) and cannot reach the Parquet
    reader; when the raw timestamp is at hand the same bound is stated on it as well so it
    becomes a pushed filter and row groups are skipped.
    """
    out = df.where(F.col(date_col) >= lit_date(lower))
    if raw_ts_col is not None:
        out = out.where(F.col(raw_ts_col) >= F.lit(lower).cast("timestamp_ntz"))
    return out


def flag_routing(
    df: DataFrame,
    agents: DataFrame,
    dept_value: str,
    exclude_substring: str,
    agent_col: str = "handler",
    dept_col: str = "department",
    workbasket_col: str = "queue",
) -> DataFrame:
    """``df`` with a boolean ``routed``: the predicate of ``filter_routing`` for each row."""
    other = (F.col(dept_col) == F.lit(dept_value)) & ~F.col(workbasket_col).contains(exclude_substring)
    flagged = agents.select(F.col("agent").alias("_agent")).distinct().withColumn("_routed", F.lit(True))
    joined = df.join(flagged, F.col(agent_col) == F.col("_agent"), "left")
    hit = F.coalesce(F.col("_routed") | other, other, F.col("_routed"), F.lit(False))
    return joined.withColumn("routed", hit).drop("_agent", "_routed")


def filter_routing(
    df: DataFrame,
    agents: DataFrame | list[str],
    dept_value: str,
    exclude_substring: str,
    agent_col: str = "handler",
    dept_col: str = "department",
    workbasket_col: str = "queue",
) -> DataFrame:
    """Keep ``agent ∈ agents`` OR (``dept == dept_value`` AND NOT ``workbasket`` contains …).

    ``dept_value`` is compared as text (the string "None" is not null). A short Python list
    becomes ``isin``; a DataFrame routing set (column ``agent``) is de-duplicated and joined
    on the agent, broadcast only where adaptive execution measures it as small.
    """
    other = (F.col(dept_col) == F.lit(dept_value)) & ~F.col(workbasket_col).contains(exclude_substring)
    if isinstance(agents, (list, tuple, set)):
        return df.where(F.col(agent_col).isin(list(agents)) | other)
    flagged = agents.select(F.col("agent").alias("_agent")).distinct().withColumn("_routed", F.lit(True))
    joined = df.join(flagged, F.col(agent_col) == F.col("_agent"), "left")
    return joined.where(F.coalesce(F.col("_routed"), F.lit(False)) | other).drop("_agent", "_routed")


def filter_channel(
    df: DataFrame,
    dept_value: str,
    excluded_origin: str,
    dept_col: str = "channel_dept",
    origin_col: str = "origin",
) -> DataFrame:
    """``dept == dept_value`` AND ``origin != excluded_origin`` (null origin is dropped)."""
    return df.where((F.col(dept_col) == F.lit(dept_value)) & (F.col(origin_col) != F.lit(excluded_origin)))


def filter_window(df: DataFrame, lo: str, hi: str, col: str = "ds") -> DataFrame:
    """Half-open window ``lo < col <= hi``."""
    return df.where((F.col(col) <= lit_date(hi)) & (F.col(col) > lit_date(lo)))


def split_fixed(
    df: DataFrame, train: tuple[str, str], test: tuple[str, str], col: str = "ds"
) -> DataFrame:
    """Label rows ``train`` / ``test`` by closed date ranges; rows in neither are dropped."""
    in_train = F.col(col).between(lit_date(train[0]), lit_date(train[1]))
    in_test = F.col(col).between(lit_date(test[0]), lit_date(test[1]))
    labelled = df.withColumn("split", F.when(in_train, F.lit("train")).when(in_test, F.lit("test")))
    return labelled.where(F.col("split").isNotNull())


def split_tail(df: DataFrame, days: int, series: str = SERIES, col: str = "ds") -> DataFrame:
    """Last ``days`` calendar days of each series are ``valid``, the rest ``train``."""
    last = F.max(col).over(Window.partitionBy(series))
    cutoff = F.date_sub(last, days)
    return df.withColumn("split", F.when(F.col(col) <= cutoff, F.lit("train")).otherwise(F.lit("valid")))


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def flag_child(df: DataFrame, parent_col: str, flag_col: str = "is_child") -> DataFrame:
    """1 where a parent reference is present, else 0."""
    return df.withColumn(flag_col, F.when(F.col(parent_col).isNotNull(), F.lit(1)).otherwise(F.lit(0)))
