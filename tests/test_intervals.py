import datetime as dt
import random

from tidecast.operators import folds, series
from tidecast.operators.intervals import interval_join
from tidecast.plans import catalog

from test_plans import SF, plan

D = dt.date


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else D(1969, 6, 1) + dt.timedelta(days=rng.randint(0, 900))
    rows = [(i, day()) for i in range(200)]
    rules = [(k, day(), day(), day(), day()) for k in range(40)] + [(40, D(1968, 1, 1), D(1973, 1, 1), None, None)]
    left = spark.createDataFrame(rows, "k int, ds date")
    right = spark.createDataFrame(rules, "rule int, a date, b date, c date, d date")
    holds = lambda x, lo, hi: None not in (x, lo, hi) and lo <= x <= hi
    want = {(k, r) for k, x in rows for r, a, b, c, d in rules if holds(x, a, b) or holds(x, c, d)}
    got = [(r.k, r.rule) for r in interval_join(left, right, [("a", "b"), ("c", "d")]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = [(r.k, r.rule) for r in interval_join(left, right.where("rule < 20"), [("a", "b")], how="left").collect()]
    some = {(k, r) for k, x in rows for r, a, b, _, _ in rules[:20] if holds(x, a, b)}
    assert sorted(kept, key=str) == sorted(some | {(k, None) for k, _ in rows if k not in {m for m, _ in some}}, key=str)
    assert interval_join(left.limit(0), right, [("a", "b")]).count() == 0 and interval_join(left, right.limit(0), [("a", "b")], how="left").count() == 200


def test_no_nested_loops_and_no_size_assumed(spark):
    for name in ("fold_expand", "metrics_by_horizon", "patch_copy"):
        assert "NestedLoop" not in plan(catalog.QUERIES[name](spark, SF)), name
    df = spark.createDataFrame([("s", D(2021, 1, 1), 1)], "series_id string, ds date, y int")
    bounds = spark.createDataFrame([(D(2020, 1, 1), D(2022, 1, 1))], "start date, end date")
    assert "rightHint" not in plan(folds.fold_expand(df, folds.folds_rolling(bounds, 90, 30, 14)))
    assert "NestedLoop" not in plan(series.patch_copy(df, [("2021-01-01", "2021-01-02", "2020-01-01", "2020-01-02")]))


def test_orders_without_a_customer_keep_a_series(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidecast.plans import testbed

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 2 = 0").write.parquet(str(tmp_path / "customer.parquet"))
    lines = testbed.balance_lines(spark, str(tmp_path))
    assert "unknown" in {r.series_id for r in lines.select("series_id").distinct().collect()}
    days = orders.where("o_custkey % 2 = 1").select(F.to_date("o_orderdate")).distinct().count()
    assert lines.where("series_id = 'unknown'").count() == days
