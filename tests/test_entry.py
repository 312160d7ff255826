import duckdb
import pytest

import __spark_entry__ as entry
from tidecast.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "ds", "y"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 70


@pytest.mark.parametrize("name", ["intake_series", "dedupe_case", "stage_funnel", "interpolate", "resample_week",
                                  "feature_frame", "folds_cutoff", "blend", "metric_wkpi", "best_params", "sink_full"])
def test_oracle_at_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    ref = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(ref.columns)
    assert len(got) == len(ref)
    cols = sorted(got.columns)
    key = lambda df: df[cols].astype(str).sort_values(cols).reset_index(drop=True)
    g, r = got[cols].copy(), ref[cols].copy()
    for c in cols:
        if g[c].dtype.kind == "f":
            g[c], r[c] = g[c].round(6), r[c].astype(float).round(6)
    assert key(g).equals(key(r))
