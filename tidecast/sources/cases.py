"""Case tables.

The engine works on two case-table shapes:

* **A** (history): ``series_id, case_id, queue, team_type, department,
  handler, receipt_ts, receipt_date``.
* **B** (current system): ``series_id, case_no, receipt_text`` (text whose first 10
  characters are ``yyyy-MM-dd``), ``channel_dept, origin``.

``scan_case_table`` reads a catalog table by name. The ``*_from_tpch`` readers give the same
shapes from the driver's star schema so every query runs on real, growing tables:
orders → A and lineitem → B, with the customer's market segment as the series key.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

A_COLUMNS = [
    "series_id", "case_id", "queue", "team_type", "department",
    "handler", "receipt_ts", "receipt_date",
]
B_COLUMNS = ["series_id", "case_no", "receipt_text", "channel_dept", "origin"]


def scan_case_table(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Catalog read keeping only ``columns`` (Catalyst prunes the rest from the scan)."""
    return spark.read.table(name).select(*columns)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey"), F.col("c_mktsegment").alias("series_id")
    )


def orders_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case table A columns straight from orders, before the series key is attached
    (``_custkey`` kept for ``attach_segment``)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("_custkey"),
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderpriority").alias("queue"),
        F.col("o_orderstatus").alias("department"),
        F.col("o_custkey").cast("string").alias("handler"),
        F.col("o_orderdate").alias("receipt_ts"),
        F.to_date("o_orderdate").alias("receipt_date"),
    )


def attach_segment(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Series key (the customer's market segment) for rows carrying ``_custkey``; every row is
    kept, in series ``unknown`` where its customer is missing."""
    seg = _segments(spark, sf_dir)
    keyed = df.join(seg, df._custkey == seg.c_custkey, "left").drop("c_custkey", "_custkey")
    return keyed.withColumn("series_id", F.coalesce("series_id", F.lit("unknown")))


def cases_a_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer → case table A, one series per market segment."""
    x = attach_segment(spark, sf_dir, orders_cases(spark, sf_dir))
    return x.select("series_id", "case_id", "queue", F.col("series_id").alias("team_type"),
                    "department", "handler", "receipt_ts", "receipt_date")


def cases_b_from_tpch(spark: SparkSession, sf_dir: str, shipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer → case table B (ship timestamp as text).

    ``shipped`` limits the rows to first and last days, stated on the raw timestamp so that the
    Parquet reader gets them.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if shipped:
        day = [(F.lit(lo).cast("timestamp_ntz"), F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp_ntz")) for lo, hi in shipped]
        inside = [(F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi) for lo, hi in day]
        li = li.where(reduce(or_, inside))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Fact-to-dimension order: lineitem ⋈ orders, then ⋈ customer. Joining the two dimensions
    # first leaves a join output with no size estimate, and the planner would pick lineitem as
    # the side to build; this way each step has a plain scan as its candidate build side.
    keyed = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    return keyed.join(_segments(spark, sf_dir), keyed.o_custkey == F.col("c_custkey"), "left").select(
        F.coalesce("series_id", F.lit("unknown")).alias("series_id"),
        F.col("l_orderkey").alias("case_no"),
        F.col("l_shipdate").cast("string").alias("receipt_text"),
        F.col("l_returnflag").alias("channel_dept"),
        F.col("l_linestatus").alias("origin"),
    )


def routing_agents_from_tpch(spark: SparkSession, sf_dir: str, min_balance: float = 9500.0) -> DataFrame:
    """Routing set (one column ``agent``): customers above a balance. Grows with the data."""
    return (
        read_table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") > F.lit(min_balance))
        .select(F.col("c_custkey").cast("string").alias("agent"))
    )
