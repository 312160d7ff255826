"""Metric log: repeats replace their own rows only; names and folds come back as written."""

import pytest

from tidecast.sources.metric_log import compare_runs, log_metrics, read_log


def scores(spark, rows):
    return spark.createDataFrame(rows, "model string, series_id string, fold int, mae double, rmse double, note string")


A = [("m", "s", 1, 1.0, 2.0, "x"), ("m", "s", 2, 3.0, None, "x"), ("k", "s", 1, 5.0, 6.0, "x")]


def rows(df):
    return sorted(tuple(r) for r in df.fillna(-1.0).collect())


def test_two_runs_and_one_repeat_leave_two_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    log_metrics(scores(spark, A), path, "2024", ["mae", "rmse"])
    log_metrics(scores(spark, A[:1]), path, "a/b = c", ["mae"])
    once = rows(read_log(spark, path))
    assert once == sorted(
        [("2024", m, s, str(f), k, -1.0 if v is None else v) for m, s, f, mae, rmse, _ in A for k, v in (("mae", mae), ("rmse", rmse))] + [("a/b = c", "m", "s", "1", "mae", 1.0)])
    log_metrics(scores(spark, A), path, "2024", ["mae", "rmse"])
    assert rows(read_log(spark, path)) == once
    # a repeat of one model replaces that model's rows, folds that are gone included
    log_metrics(scores(spark, [("m", "s", 2, 9.0, 9.0, "x")]), path, "2024", ["mae"])
    assert rows(read_log(spark, path)) == sorted([r for r in once if r[:2] != ("2024", "m")] + [("2024", "m", "s", "2", "mae", 9.0)])


def test_no_rows_change_nothing_and_a_missing_fold_is_all(spark, tmp_path):
    path = str(tmp_path / "log")
    log_metrics(scores(spark, A).drop("fold"), path, "r", ["mae"])
    before = rows(read_log(spark, path))
    assert {r[3] for r in before} == {"all"}
    log_metrics(scores(spark, []), path, "r", ["mae"])
    assert rows(read_log(spark, path)) == before


def test_names_are_asked_for(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        log_metrics(scores(spark, A), str(tmp_path / "log"), "", ["mae"])
    for model in (None, ""):
        with pytest.raises(Exception, match="model name"):
            log_metrics(scores(spark, [(model, "s", 1, 1.0, 1.0, "x")]), str(tmp_path / "log"), "r", ["mae"])


def test_a_run_is_read_from_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in ("r1", "r2"):
        log_metrics(scores(spark, A), path, run, ["mae"])
    plan = read_log(spark, path).where("run = 'r1' and model = 'm'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_compare_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    log_metrics(scores(spark, A), path, "r1", ["mae", "rmse"])
    log_metrics(scores(spark, [("m", "s", 7, 4.0, None, "x"), ("new", "s", 1, 1.0, 1.0, "x")]), path, "r2", ["mae", "rmse"])
    got = {(r.model, r.metric): tuple(r)[3:] for r in compare_runs(read_log(spark, path), "r1", "r2").collect()}
    assert got[("m", "mae")] == (2, 1, 2.0, 4.0, 2.0)
    assert got[("m", "rmse")] == (1, 0, 2.0, None, None)
    assert got[("k", "mae")] == (1, 0, 5.0, None, None) and got[("new", "mae")] == (0, 1, None, 1.0, None)
