import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import counting, series

D = dt.date


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def sdf(spark, rows, y="bigint"):
    return spark.createDataFrame(rows, f"series_id string, ds date, y {y}")


def test_densify_fills_and_is_idempotent(spark):
    counts = sdf(spark, [("a", D(2024, 1, 1), 3), ("a", D(2024, 1, 4), 1), ("b", D(2024, 1, 2), 2)])
    bounds = counting.date_bounds(counts)
    dense = series.densify_zero(counts, bounds)
    got = sorted((r.series_id, r.ds, r.y) for r in dense.collect())
    assert got == [("a", D(2024, 1, 1), 3), ("a", D(2024, 1, 2), 0), ("a", D(2024, 1, 3), 0),
                   ("a", D(2024, 1, 4), 1), ("b", D(2024, 1, 2), 2)]
    again = series.densify_zero(dense, counting.date_bounds(dense))
    assert sorted(again.collect()) == sorted(dense.collect())


def test_combine_sums_shared_days(spark):
    a = sdf(spark, [("a", D(2024, 1, 1), 3)])
    b = sdf(spark, [("a", D(2024, 1, 1), 2), ("a", D(2024, 1, 2), 5)])
    got = sorted((r.ds, r.y) for r in series.combine_sources(a, b).collect())
    assert got == [(D(2024, 1, 1), 5), (D(2024, 1, 2), 5)]


def _patch_reference(pdf, rules):
    """Brute force of the rank-paired copy on one series, rules in order."""
    pdf = pdf.sort_values("ds").reset_index(drop=True).copy()
    for t0, t1, s0, s1 in rules:
        t0, t1, s0, s1 = (pd.Timestamp(x).date() for x in (t0, t1, s0, s1))
        tgt = pdf.index[(pdf.ds >= t0) & (pdf.ds <= t1)].tolist()
        src = pdf.loc[(pdf.ds >= s0) & (pdf.ds <= s1), "y"].tolist()
        for i, v in zip(tgt, src):
            pdf.loc[i, "y"] = v
    return pdf


@pytest.mark.parametrize("rules", [
    [("2024-01-10", "2024-01-18", "2024-01-01", "2024-01-08")],          # 9-day target, 8-day source
    [("2024-01-01", "2024-01-05", "2024-01-20", "2024-01-24"),            # source after target
     ("2024-01-10", "2024-01-11", "2024-01-03", "2024-01-04")],           # reads what rule 1 wrote
    [("2024-01-05", "2024-01-09", "2024-01-20", "2024-01-24"),
     ("2024-01-07", "2024-01-08", "2024-01-25", "2024-01-26")],           # overlapping targets
])
def test_patch_copy_matches_brute_force(spark, rules):
    rng = np.random.default_rng(3)
    ds = [d for d in days(D(2024, 1, 1), 31) if d != D(2024, 1, 14)]  # one missing target day
    rows = [("a", d, int(v)) for d, v in zip(ds, rng.integers(0, 100, len(ds)))]
    out = series.patch_copy(sdf(spark, rows), rules).toPandas().sort_values("ds").reset_index(drop=True)
    ref = _patch_reference(pd.DataFrame(rows, columns=["series_id", "ds", "y"]), rules)
    assert out["y"].tolist() == ref["y"].tolist()


def test_patch_values_overlay(spark):
    base = sdf(spark, [("a", D(2024, 1, 1), 1), ("a", D(2024, 1, 2), 2)])
    patch = sdf(spark, [("a", D(2024, 1, 2), 9), ("a", D(2024, 1, 9), 9)])
    got = sorted((r.ds, r.y) for r in series.patch_values(base, patch).collect())
    assert got == [(D(2024, 1, 1), 1), (D(2024, 1, 2), 9)]


def test_interpolate_linear_and_grid(spark):
    rows = [("a", D(2024, 1, 1), 10.0), ("a", D(2024, 1, 4), 40.0), ("a", D(2024, 1, 5), None),
            ("a", D(2024, 1, 6), 20.0)]
    out = series.interpolate(sdf(spark, rows, "double")).orderBy("ds").toPandas()
    assert out["y"].tolist() == [10.0, 20.0, 30.0, 40.0, 30.0, 20.0]
    ref = pd.Series([10.0, np.nan, np.nan, 40.0, np.nan, 20.0]).interpolate(limit_direction="both")
    assert np.allclose(out["y"], ref)


def _trim_reference(pdf, tail=120, min_len=30):
    pdf = pdf.sort_values("ds")
    t = pdf["y"].tail(tail)
    if len(t) >= min_len and t.nunique() == 1:
        diff = pdf.loc[pdf["y"] != t.iloc[0], "ds"]
        if len(diff):
            return pdf[pdf["ds"] <= diff.max()]
    return pdf


@pytest.mark.parametrize("plateau", [29, 30, 120, 200])
def test_trim_plateau(spark, plateau):
    ds = days(D(2023, 1, 1), 300)
    ys = [float(i % 7) for i in range(300 - plateau)] + [55.0] * plateau
    rows = [("a", d, y) for d, y in zip(ds, ys)]
    got = series.trim_plateau(sdf(spark, rows, "double")).count()
    ref = len(_trim_reference(pd.DataFrame(rows, columns=["series_id", "ds", "y"])))
    assert got == ref
    # fires only when the whole last-120 window is one value
    assert got == (300 if plateau < 120 else 300 - plateau)


def test_trim_plateau_all_constant_kept(spark):
    rows = [("a", d, 4.0) for d in days(D(2023, 1, 1), 60)]
    assert series.trim_plateau(sdf(spark, rows, "double")).count() == 60


def test_resample_against_pandas(spark):
    ds = days(D(2024, 1, 1), 70)
    rng = np.random.default_rng(5)
    ys = rng.normal(100, 10, 70)
    rows = [("a", d, float(y)) for d, y in zip(ds, ys)]
    s = pd.Series(ys, index=pd.to_datetime(ds))
    for freq, pfreq in (("W", "W"), ("W-MON", "W-MON"), ("M", "ME")):
        for agg in ("mean", "median", "last"):
            out = series.resample(sdf(spark, rows, "double"), freq, agg).orderBy("ds").toPandas()
            ref = getattr(s.resample(pfreq), agg)().dropna()
            assert [d for d in out["ds"]] == [d.date() for d in ref.index], (freq, agg)
            assert np.allclose(out["y"], ref.values), (freq, agg)
    with pytest.raises(ValueError):
        series.resample(sdf(spark, rows, "double"), "W", "sum")


def test_extend_horizon_starts_after_last(spark):
    rows = [("a", D(2024, 1, 30), 1.0), ("a", D(2024, 1, 31), 2.0)]
    out = series.extend_horizon(sdf(spark, rows, "double"), 3, "M").orderBy("ds").toPandas()
    assert out["ds"].tolist()[2:] == [D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    assert out["y"].isna().tolist() == [False, False, True, True, True]
    d = series.extend_horizon(sdf(spark, rows, "double"), 2, "D").orderBy("ds").toPandas()
    assert d["ds"].tolist() == [D(2024, 1, 30), D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 2)]


def test_clean_series_from_text(spark, tmp_path):
    text = " Date \t Open Balances \n1/1/2022\t1,963\n2/1/2022\tbad\n4/1/2022\t2,934\n99/99/2022\t5\n"
    p = tmp_path / "series.txt"
    p.write_text(text)
    lines = series.read_series_text(spark, str(p))
    assert lines.columns == ["Date", "Open Balances"]
    out = series.clean_series(lines).orderBy("ds").toPandas()
    assert out["ds"].tolist() == [D(2022, 1, 1), D(2022, 1, 2), D(2022, 1, 3), D(2022, 1, 4)]
    assert np.allclose(out["y"], [1963.0, 1963 + (2934 - 1963) / 3, 1963 + 2 * (2934 - 1963) / 3, 2934.0])


def test_resample_split_drops_shared_label(spark):
    # 2024-01-01 is a Monday; 40 days, last 10 held out → cutoff 2024-01-30 (a Tuesday)
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    out = series.resample_split(sdf(spark, rows, "double"), 10, "W").toPandas()
    train_labels = set(out[out.split == "train"].ds)
    valid_labels = set(out[out.split == "valid"].ds)
    assert not train_labels & valid_labels
    assert D(2024, 2, 4) in train_labels  # week of the cutoff stays with training
    assert valid_labels == {D(2024, 2, 11)}


@pytest.mark.parametrize("sep", ["\t", ",", ";", "|"])
def test_separator_is_detected(spark, tmp_path, sep):
    """Grouped numbers hold commas on some lines, one line has no value, quotes hide separators."""
    number = lambda v: f'"{v:,.2f}"' if sep == "," else f"{v:,.2f}"
    lines = [f" Date {sep} Open Balances "] + [f"{i % 28 + 1}/3/2021{sep}{number(10.0 ** (i % 7))}" for i in range(60)] + [f'"a{sep}b;c|d"{sep}x', "", "7/3/2021"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    assert series.detect_separator(spark, str(tmp_path)) == sep
    out = series.parse_series_text(series.read_series_text(spark, str(tmp_path)))
    assert out.where("y is not null and ds is not null").count() == 60


def test_separator_of_one_column_and_of_no_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date\n1/1/2021\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "e.txt").write_text("")
    assert series.detect_separator(spark, str(tmp_path / "a.txt")) == "\t" == series.detect_separator(spark, str(tmp_path / "b"))
