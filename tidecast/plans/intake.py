"""Daily intake flow: cases → filters → dedupe → daily counts → densify → combine → patch.

``IntakeParams`` holds what the original notebook hard-codes (substrings, bounds, windows,
patch ranges, rules); ``intake_series`` wires the operators into one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_from_text
from ..operators.counting import date_bounds, daily_count, dedupe_case
from ..operators.filters import filter_channel, filter_contains, filter_date_from, filter_routing, filter_window
from ..operators.series import combine_sources, densify_zero, patch_copy, patch_values
from ..session import cut_lineage
from ..sources.cases import (attach_segment, cases_a_from_tpch, cases_b_from_tpch, orders_cases,
                             routing_agents_from_tpch)


@dataclass(frozen=True)
class IntakeParams:
    """Parameters of the intake flow on the driver tables (our values, same shapes)."""

    workbasket_needle: str = "E"
    date_from: str = "1996-01-01"
    routing_min_balance: float = 9500.0
    routing_dept: str = "F"
    routing_exclude: str = "LOW"
    b_dept: str = "R"
    b_excluded_origin: str = "O"
    b_window: tuple[str, str] = ("1998-03-02", "2000-10-15")
    patch_ranges: tuple[tuple[str, str], ...] = (
        ("1996-04-08", "1996-05-05"),
        ("1996-09-02", "1996-09-11"),
        ("1997-01-13", "1997-01-19"),
    )
    # (target_start, target_end, source_start, source_end): a 12-day target with a 10-day
    # source, a source after its target, and a short pair.
    patch_rules: tuple[tuple[str, str, str, str], ...] = field(default=(
        ("1999-08-09", "1999-08-20", "1999-07-19", "1999-07-28"),
        ("1998-10-05", "1998-10-11", "1998-11-02", "1998-11-08"),
        ("1999-03-16", "1999-03-18", "1999-03-09", "1999-03-11"),
    ))


P = IntakeParams()


def cases_a_filtered(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    a = cases_a_from_tpch(spark, sf_dir)
    a = filter_contains(a, "queue", p.workbasket_needle)
    return filter_date_from(a, "receipt_date", p.date_from, raw_ts_col="receipt_ts")


def source_a_bounds(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    """First and last filtered receipt day per series (before routing and dedupe).

    Aggregated per customer first (partial aggregation, one row per customer), then joined to
    the customer dimension and reduced per series: the join sees customers, not orders."""
    raw = filter_contains(orders_cases(spark, sf_dir), "queue", p.workbasket_needle)
    raw = filter_date_from(raw, "receipt_date", p.date_from, raw_ts_col="receipt_ts")
    per_cust = raw.groupBy("_custkey").agg(F.min("receipt_date").alias("start"), F.max("receipt_date").alias("end"))
    keyed = attach_segment(spark, sf_dir, per_cust)
    return keyed.groupBy("series_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def routed_cases(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    a = cases_a_filtered(spark, sf_dir, p)
    agents = routing_agents_from_tpch(spark, sf_dir, p.routing_min_balance)
    return filter_routing(a, agents, p.routing_dept, p.routing_exclude)


def source_a_daily(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    """Source A: distinct routed cases per (series, day), zero-filled between the bounds of
    the wider filtered set (bounds are taken before routing and dedupe)."""
    bounds = source_a_bounds(spark, sf_dir, p)
    cases = routed_cases(spark, sf_dir, p).select("series_id", "case_id", "receipt_date")
    unique = dedupe_case(cases, "case_id", ["receipt_date", "series_id"])
    return densify_zero(daily_count(unique, "receipt_date"), bounds)


def cases_b_dated(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    b = filter_channel(cases_b_from_tpch(spark, sf_dir), p.b_dept, p.b_excluded_origin)
    return b.withColumn("receipt_date", date_from_text("receipt_text"))


def _in_patch_ranges(col: str, p: IntakeParams):
    cond = None
    for lo, hi in p.patch_ranges:
        c = F.col(col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
        cond = c if cond is None else cond | c
    return cond


def b_daily_both(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    """One pass over source B: per (series, day) the rows passing the channel filter and the
    rows inside the patch ranges. Both the B series and the patch table come from it, so the
    large case table is scanned and joined once, and only for the days that either needs."""
    b = cases_b_from_tpch(spark, sf_dir, [p.b_window, *p.patch_ranges]).withColumn("ds", date_from_text("receipt_text"))
    chan = (F.col("channel_dept") == F.lit(p.b_dept)) & (F.col("origin") != F.lit(p.b_excluded_origin))
    return b.groupBy("series_id", "ds").agg(F.count_if(chan).alias("n_channel"),
                                            F.count_if(_in_patch_ranges("ds", p)).alias("n_patch"))


def source_b_daily(spark: SparkSession, sf_dir: str, p: IntakeParams = P, both: DataFrame | None = None) -> DataFrame:
    """Source B: rows per (series, day) inside the half-open window, zero-filled."""
    both = b_daily_both(spark, sf_dir, p) if both is None else both
    counts = both.where(F.col("n_channel") > 0).select("series_id", "ds", F.col("n_channel").alias("y"))
    counts = filter_window(counts, *p.b_window)
    return densify_zero(counts, date_bounds(counts))


def patch_table(spark: SparkSession, sf_dir: str, p: IntakeParams = P, both: DataFrame | None = None) -> DataFrame:
    """Known counts for the patch ranges, taken from a second table (unfiltered lineitem)."""
    both = b_daily_both(spark, sf_dir, p) if both is None else both
    return both.where(F.col("n_patch") > 0).select("series_id", "ds", F.col("n_patch").alias("y"))


def intake_series(spark: SparkSession, sf_dir: str, p: IntakeParams = P) -> DataFrame:
    """The whole intake flow → ``series_id, ds, y``: one row per series and day. The daily counts
    of source B are written once."""
    both = cut_lineage(b_daily_both(spark, sf_dir, p), "b_daily")  # read twice below
    combined = combine_sources(source_a_daily(spark, sf_dir, p), source_b_daily(spark, sf_dir, p, both))
    patched = patch_values(combined, patch_table(spark, sf_dir, p, both))
    return patch_copy(patched, list(p.patch_rules))
