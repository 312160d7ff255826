"""Plan-shape checks: the scale properties the design relies on."""

import datetime as dt

from pyspark.sql import functions as F

from tidecast.operators import counting
from tidecast.plans import catalog, intake

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_subtrees(p: str) -> list[str]:
    lines = p.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            ind = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= ind:
                    break
                sub.append(nxt)
            out.append("\n".join(sub))
    return out


def test_case_filters_reach_parquet(spark):
    p = plan(intake.cases_a_filtered(spark, SF))
    assert "StringContains(o_orderpriority,E)" in p
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in p


def test_intake_reads_each_input_a_bounded_number_of_times(spark):
    p = plan(intake.intake_series(spark, SF))
    assert p.count("FileScan parquet") <= 16
    assert "CartesianProduct" not in p


def test_fact_table_is_never_the_broadcast_side(spark):
    p = plan(intake.b_daily_both(spark, SF))
    subs = broadcast_subtrees(p)
    assert subs, "expected the dimensions to be broadcast at this size"
    assert all("lineitem.parquet" not in sub for sub in subs)


def test_no_cartesian_products_in_model_plans(spark):
    for name in ("fold_metrics", "grid_tree", "backtest"):
        df = catalog.QUERIES[name](spark, SF)
        assert "CartesianProduct" not in plan(df), name


def test_dedupe_is_deterministic_under_skew(spark):
    d = dt.date(2024, 1, 1)
    hot = [(1, d + dt.timedelta(days=i % 5), f"s{i % 3}") for i in range(3000)]  # one id, a third+ of rows
    rest = [(k, d, "s0") for k in range(2, 2002)]
    df = spark.createDataFrame(hot + rest, "case_id bigint, receipt_date date, series_id string").repartition(8)
    out = counting.dedupe_case(df, "case_id", ["receipt_date", "series_id"])
    assert out.count() == 2001
    r = out.where(F.col("case_id") == 1).first()
    assert (r.receipt_date, r.series_id) == (d, "s0")
    assert "partial_min" in plan(out)  # folded map-side before the shuffle


def test_lineitem_is_read_once_and_only_for_the_days_needed(spark):
    p = plan(intake.b_daily_both(spark, SF))
    scan = [line for line in p.split("\n") if "lineitem.parquet" in line]
    assert len(scan) == 1
    assert "GreaterThanOrEqual(l_shipdate" in scan[0].split("PushedFilters")[1]
    assert "lineitem.parquet" not in plan(intake.intake_series(spark, SF))


def test_backtests_fit_each_group_once(spark):
    # the fold forecasts are written; scores, pooled scores and the choice read them
    for name in ("backtest", "model_scoreboard"):
        assert "FlatMapGroupsInPandas" not in plan(catalog.QUERIES[name](spark, SF)), name
