"""Sinks: every written file is in day order, per series."""

import datetime as dt
import glob

import pyarrow.parquet as pq

from tidecast.sources.sinks import write_horizon, write_series


def frame(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=(i * 37) % 100) for i in range(100)]
    rows = [(s, d, float(i)) for s in ("a", "b") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "series_id string, ds date, fcst double").repartition(3)


def test_files_are_in_day_order(spark, tmp_path):
    write_series(frame(spark), str(tmp_path / "p"))
    files = glob.glob(f"{tmp_path}/p/*/*.parquet")
    assert len(files) >= 2
    total = 0
    for f in files:
        ds = pq.ParquetFile(f).read().column("ds").to_pylist()
        assert ds == sorted(ds)
        total += len(ds)
    assert total == 200


def test_csv_and_unpartitioned(spark, tmp_path):
    write_series(frame(spark), str(tmp_path / "c"), fmt="csv", partition_by=None)
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.count() == 200 and back.columns == ["series_id", "ds", "fcst"]


def test_horizon_holds_only_later_days(spark, tmp_path):
    fc = frame(spark)
    write_horizon(fc, fc.where("ds < '2024-04-01'").withColumnRenamed("fcst", "y"), str(tmp_path / "h"))
    got = spark.read.parquet(str(tmp_path / "h"))
    assert got.count() == 2 * 9 and str(got.agg({"ds": "min"}).first()[0]) == "2024-04-01"
