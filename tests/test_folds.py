import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidecast.operators import folds

D = dt.date


def bounds(spark, a, b):
    return spark.createDataFrame([(a, b)], "start date, end date")


def test_fold_counts_of_the_original(spark):
    b = bounds(spark, D(2022, 1, 1), D(2025, 4, 30))
    assert folds.folds_rolling(b, 30, 30, 30).count() == 39
    assert folds.folds_rolling(b, 730, 60, 30).count() == 15
    assert folds.folds_cutoff(b, 60).count() == 38
    last = folds.folds_rolling(b, 730, 60, 30).orderBy(F.desc("fold")).first()
    assert last.test_end <= D(2025, 4, 30)


def test_fold_loop_equivalent(spark):
    start, end = pd.Timestamp("2022-01-01"), pd.Timestamp("2025-04-30")
    ref, cur = [], start
    while cur + pd.Timedelta(days=790) <= end:
        ref.append((cur.date(), (cur + pd.Timedelta(days=730)).date(), (cur + pd.Timedelta(days=790)).date()))
        cur += pd.Timedelta(days=30)
    got = [(r.train_start, r.train_end, r.test_end)
           for r in folds.folds_rolling(bounds(spark, start.date(), end.date()), 730, 60, 30).orderBy("fold").collect()]
    assert got == ref


def test_expand_rolling_equals_range_join(spark):
    ds = [D(2022, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    df = spark.createDataFrame([("a", d, i) for i, d in enumerate(ds)], "series_id string, ds date, y bigint")
    b = bounds(spark, D(2022, 1, 1), D(2023, 1, 31))
    joined = folds.fold_expand(df, folds.folds_rolling(b, 90, 30, 14)).select("ds", "fold", "role")
    arith = folds.expand_rolling(df, "2022-01-01", "2023-01-31", 90, 30, 14).select("ds", "fold", "role")
    assert sorted(joined.collect()) == sorted(arith.collect())
    # train and test never overlap inside a fold
    x = arith.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ds"))).alias("a"),
                                  F.min(F.when(F.col("role") == "test", F.col("ds"))).alias("b"))
    assert x.where("a >= b").count() == 0


def test_grids(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "series_id string")
    g = folds.grid_params(keys, {"x": [1, 2, 3], "y": [0.5, 1.0]})
    assert g.count() == 12 and g.select("param_id").distinct().count() == 6
    t = folds.tree_grid(keys, {"max_depth": [2, 3, 4, 5, 6], "learning_rate": [0.25, 0.5, 1.0]}).toPandas()
    leaves = dict(zip(t.max_depth, t.num_leaves))
    assert leaves == {2: 3, 3: 6, 4: 13, 5: 26, 6: 51}
    assert dict(zip(t.learning_rate, t.num_iterations)) == {0.25: 300, 0.5: 200, 1.0: 100}
