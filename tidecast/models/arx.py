"""Seasonal autoregression with calendar regressors (the ARIMAX role).

Per (series, fold) in ``applyInPandas``: for each candidate lag set (season 7) fit
``y_t = c + Σ a_k·y_{t−k} + β·x_t`` by least squares on the fold's training rows, keep the
one with the lowest AIC, then forecast the test rows recursively (lags inside the horizon
use earlier forecasts, never the actuals). Lags come from the whole series (computed in
Spark before the fold split), so a fold's first days see real history, not zeros.

Not the original's solver: AR terms only (no moving-average term), orders picked from a
fixed candidate list instead of a stepwise search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import series_window, spread_groups

# --- fixed values (must equal the original program's) -----------------------------------
REGRESSORS = ("is_ph", "is_ph_lag1", "wday", "yearday")
SEASON = 7
# -----------------------------------------------------------------------------------------

LAG_SETS = ((1,), (1, 2), (1, SEASON), (1, 2, SEASON), (1, SEASON, 2 * SEASON), (1, 2, 3, SEASON, 2 * SEASON))
MAX_LAG = 2 * SEASON
Z80 = 1.2815515655446004
OUT = ["ds", "actual", "fcst", "lo", "hi", "order_id", "aic", "status", "n_train"]


def _fit(train: pd.DataFrame, xcols: list[str]):
    """The lag set of lowest AIC: (order_id, lags, coef, sigma2, aic), or None.

    All sets are compared on the same rows: those with the lags of the longest set that leaves
    more rows than coefficients.
    """
    y = train["y"].to_numpy(dtype=float)
    x = train[xcols].to_numpy(dtype=float)
    lagged = {k: train[f"y_lag{k}"].to_numpy(dtype=float) for s in LAG_SETS for k in s}
    known = ~np.isnan(y) & ~np.isnan(x).any(axis=1)

    def rows_of(lags: tuple) -> np.ndarray:
        return known & ~np.isnan(np.column_stack([lagged[k] for k in lags])).any(axis=1)

    usable = [s for s in LAG_SETS if rows_of(s).sum() > len(s) + len(xcols) + 3]
    if not usable:
        return None
    ok = rows_of(tuple({k for s in usable for k in s}))
    if ok.sum() <= max(len(s) for s in usable) + len(xcols) + 3:
        usable = usable[:1]
        ok = rows_of(usable[0])
    n, best = int(ok.sum()), None
    for lags in usable:
        m = np.column_stack([np.ones(n), *[lagged[k][ok] for k in lags], x[ok]])
        coef, *_ = np.linalg.lstsq(m, y[ok], rcond=None)
        sigma2 = max(float(np.mean((y[ok] - m @ coef) ** 2)), 1e-12)
        aic = n * np.log(sigma2) + 2 * m.shape[1]
        if best is None or aic < best[4]:
            best = (LAG_SETS.index(lags) + 1, lags, coef, sigma2, aic)
    return best


def _band(lags: tuple, coef: np.ndarray, sigma2: float, steps: np.ndarray) -> np.ndarray:
    """Half width of the 80 % band ``steps`` days ahead, from the psi weights of the recursion."""
    psi = np.zeros(int(steps.max()))
    psi[0] = 1.0
    for j in range(1, len(psi)):
        psi[j] = sum(c * psi[j - k] for k, c in zip(lags, coef) if j >= k)
    return Z80 * np.sqrt(sigma2 * np.cumsum(psi ** 2))[steps - 1]


def fit_predict_group(pdf: pd.DataFrame, keys: list[str], xcols: list[str]) -> pd.DataFrame:
    """Every test row comes out. ``status``: ``fitted``; ``mean`` (the mean of the training rows,
    where there are too few to fit or a regressor is missing); ``no_train`` (null forecast)."""
    cols = keys + OUT
    pdf = pdf.sort_values("ds").reset_index(drop=True)
    train, test = pdf[(pdf["role"] == "train") & pdf["y"].notna()], pdf[pdf["role"] == "test"]
    if not len(test):
        return pd.DataFrame(columns=cols)
    level = float(train["y"].mean()) if len(train) else np.nan
    fc = np.full(len(test), level)
    half = np.full(len(test), Z80 * float(train["y"].std(ddof=0)) if len(train) else np.nan)
    status = np.full(len(test), "mean" if len(train) else "no_train", dtype=object)
    best = _fit(train, xcols)
    oid, aic = (best[0], float(best[4])) if best else (None, np.nan)
    if best:
        _, lags, coef, sigma2, _ = best
        day = pd.to_datetime(test["ds"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        seen = pd.to_datetime(train["ds"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        # values by day: actuals up to the end of training, then forecasts
        first = int(min(seen.min(), day.min()))
        value = np.full(int(max(seen.max(), day.max())) - first + 1, np.nan)
        value[seen - first] = train["y"].to_numpy(dtype=float)
        known = {k: test[f"y_lag{k}"].to_numpy(dtype=float) for k in lags}
        drive = coef[0] + test[xcols].to_numpy(dtype=float) @ coef[1 + len(lags):]
        a = coef[1:1 + len(lags)]
        for i, d in enumerate(day - first):
            v = drive[i]
            for k, c in zip(lags, a):
                at = value[d - k] if d >= k else np.nan
                if np.isnan(at):
                    at = known[k][i] if not np.isnan(known[k][i]) else level
                v += c * at
            if np.isfinite(v):
                fc[i], status[i] = v, "fitted"
            value[d] = fc[i]
        half = np.where(status == "fitted", _band(lags, a, sigma2, day - day[0] + 1), half)
    out = pd.DataFrame({"ds": test["ds"].to_numpy(), "actual": test["y"].to_numpy(dtype=float), "fcst": fc,
                        "lo": fc - half, "hi": fc + half, "order_id": pd.array([oid] * len(test), dtype="Int32"),
                        "aic": aic, "status": status, "n_train": len(train)})
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[cols]


def with_lags(df: DataFrame, series: str = "series_id", max_lag: int = MAX_LAG) -> DataFrame:
    """``y_lag1 … y_lag{max_lag}`` over the whole series (one window sort), null at the start."""
    w = series_window(series)
    return df.withColumns({f"y_lag{k}": F.lag(F.col("y").cast("double"), k).over(w) for k in range(1, max_lag + 1)})


def forecast_arx(rows: DataFrame, keys: list[str], xcols=REGRESSORS) -> DataFrame:
    """``rows``: ``keys…, ds, y, role, y_lag1…y_lag14`` and the regressors.

    Returns ``keys…, ds, actual, fcst, lo, hi, order_id, aic, status, n_train``, one row per test row.
    """
    xcols = list(xcols)
    x = rows.select(*keys, "ds", F.col("y").cast("double").alias("y"), "role",
                    *[F.col(f"y_lag{k}") for k in range(1, MAX_LAG + 1)], *[F.col(c).cast("double") for c in xcols])
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name in keys}
    schema = ", ".join(f"{k} {key_types[k]}" for k in keys) + \
        ", ds date, actual double, fcst double, lo double, hi double, order_id int, aic double, status string, n_train int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_predict_group(pdf, keys, xcols)

    return spread_groups(x, keys).groupBy(*keys).applyInPandas(run, schema)
