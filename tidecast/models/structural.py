"""Structural model: piecewise-linear trend + Fourier seasonalities + holiday windows.

Fitted per (series, fold) with ``groupBy(...).applyInPandas``; every parameter set of the grid
is solved from the same Gram blocks, so a grid costs one pass over the data. Holiday-window
indicators are joined JVM-side; the Fourier terms and the changepoint hinges (which depend on
the fold's training range) are built inside the group from the day index, so each
fold-expanded row ships a handful of values to Python instead of ~70.

Solver (not the original's sampler): maximum a-posteriori with Gaussian priors on level, slope
and effects (a penalty σ²/scale² per column, σ² from a first weakly-regularised pass) and Laplace
priors on the rate changes, so most hinges are exactly 0. Multiplicative mode alternates trend
and ratio fits. Band (80 %): quantiles over simulated futures, in which the rate goes on changing
as often and as much as it did in training, plus resampled training residuals, so it widens with
the distance from the last training day.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread_groups

# --- fixed values (must equal the original program's) -----------------------------------
# (name, period in days, Fourier order); weekly/monthly/quarterly only at daily frequency.
SEASONALITIES = (("weekly", 7.0, 6), ("monthly", 30.5, 10), ("quarterly", 91.25, 8), ("yearly", 365.25, 10))
SEASONALITY_PRIOR = 10.0
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
INTERVAL_WIDTH = 0.8
# default terms of the intake flow's model, which is additive
INTAKE_SEASONALITIES = (("weekly", 7.0, 3), ("yearly", 365.25, 10))
# -----------------------------------------------------------------------------------------

WEAK_PRIOR = 10.0
TREND_PRIOR = 1e3
ROUNDS = 3
#: Passes over the hinges at most, and simulated futures of a band.
PASSES, FUTURES = 400, 300


@dataclass(frozen=True)
class StructuralSpec:
    seasonalities: tuple = SEASONALITIES
    mode: str = "multiplicative"
    n_changepoints: int = N_CHANGEPOINTS
    changepoint_range: float = CHANGEPOINT_RANGE

    def season_columns(self) -> list[tuple[str, str]]:
        out = []
        for name, _, order in self.seasonalities:
            for k in range(1, order + 1):
                out += [(name, f"{name}_sin{k}"), (name, f"{name}_cos{k}")]
        return out


INTAKE_SPEC = StructuralSpec(seasonalities=INTAKE_SEASONALITIES, mode="additive")


def balance_spec(freq: str) -> StructuralSpec:
    """The balance model at a frequency: only the yearly term is resolvable on weeks and months."""
    return StructuralSpec(seasonalities=SEASONALITIES if freq == "D" else SEASONALITIES[-1:])


@dataclass(frozen=True)
class HolidayWindows:
    """Days of holiday windows (``ds, holiday, offset``) and the columns they make, stated by
    the caller: every name at every offset. Days of other names or offsets have no column."""

    days: DataFrame
    names: tuple[str, ...]
    lower: int
    upper: int

    def keys(self) -> list[str]:
        return [f"{re.sub('[^A-Za-z0-9]', '', n)}_{o}" for n in self.names for o in range(self.lower, self.upper + 1)]


def _ridge(gram: np.ndarray, rhs: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = gram + np.diag(penalty)
    try:
        return np.linalg.solve(a, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, rhs, rcond=None)[0]


def sparse_fit(gram: np.ndarray, rhs: np.ndarray, penalty: np.ndarray, hinges: slice, weight: float) -> np.ndarray:
    """Least squares with squared penalties on all columns but ``hinges``, and ``weight`` times the
    absolute value on these. The other columns are eliminated (they are solved exactly for any
    hinges), and the hinges found by coordinate descent on what is left."""
    n = len(rhs)
    h = np.zeros(n, bool)
    h[hinges] = True
    rest = gram[np.ix_(~h, ~h)] + np.diag(penalty[~h])
    solved = np.linalg.lstsq(rest, np.column_stack([gram[np.ix_(~h, h)], rhs[~h]]), rcond=None)[0]
    cross, base = solved[:, :-1], solved[:, -1]
    a = gram[np.ix_(h, h)] - gram[np.ix_(h, ~h)] @ cross
    b = rhs[h] - gram[np.ix_(h, ~h)] @ base
    d, diag = np.zeros(h.sum()), np.maximum(np.diag(a), 1e-12)
    left = b.copy()  # b - a d
    for _ in range(PASSES):
        moved = 0.0
        for j in range(len(d)):
            z = left[j] + diag[j] * d[j]
            new = np.sign(z) * max(abs(z) - weight, 0.0) / diag[j]
            if new != d[j]:
                left -= a[:, j] * (new - d[j])
                moved = max(moved, abs(new - d[j]) * np.sqrt(diag[j]))
                d[j] = new
        if moved < 1e-7:
            break
    out = np.zeros(n)
    out[h], out[~h] = d, base - cross @ d
    return out


def future_trends(ts: np.ndarray, changes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Deviations from the trend at scaled times ``ts`` (training ends at 1), one row per simulated
    future: rate changes at the training's rate, Laplace with its mean absolute size."""
    order = np.argsort(ts, kind="stable")
    step = np.diff(np.maximum(ts[order], 1.0), prepend=1.0)
    times = rng.poisson(len(changes) * step, (FUTURES, len(ts)))
    size = np.abs(changes).mean() if len(changes) else 0.0
    rate = np.cumsum(rng.laplace(0.0, max(size, 1e-12), times.shape) * np.sqrt(times), axis=1)
    out = np.empty_like(rate)
    out[:, order] = np.cumsum(rate * step, axis=1)
    return out


def season_matrix(t_days: np.ndarray, spec: StructuralSpec) -> np.ndarray:
    """sin/cos pairs per seasonality on t = days since 1970-01-01, in ``season_columns`` order
    (the same terms as the ``fourier_features`` column expressions)."""
    cols = []
    for _, period, order in spec.seasonalities:
        for k in range(1, order + 1):
            arg = t_days * (2.0 * np.pi * k / period)
            cols += [np.sin(arg), np.cos(arg)]
    return np.column_stack(cols) if cols else np.zeros((len(t_days), 0))


@dataclass
class _Group:
    """One group's rows in day order, as matrices."""

    frame: pd.DataFrame
    train: np.ndarray
    test: np.ndarray
    y: np.ndarray
    scale: float
    trend: np.ndarray
    effects: np.ndarray  # seasonal columns, then holiday columns
    n_season: int


def _group(pdf: pd.DataFrame, spec: StructuralSpec, hol_cols: list[str]) -> _Group:
    pdf = pdf.sort_values("ds").reset_index(drop=True)
    y = pdf["y"].to_numpy(dtype=float)
    train = (pdf["role"] == "train").to_numpy() & ~np.isnan(y)
    t_days = pdf["t"].to_numpy(dtype=float)
    known = t_days[train] if train.any() else t_days
    ts = (t_days - known.min()) / max(known.max() - known.min(), 1.0)
    # the priors hold the hinges down where days are few, so the design is the same at every length
    cps = np.linspace(0, spec.changepoint_range, spec.n_changepoints + 1)[1:]
    trend = np.column_stack([np.ones_like(ts), ts, np.maximum(0.0, ts[:, None] - cps[None, :])])
    season = season_matrix(t_days, spec)
    hol = pdf[hol_cols].to_numpy(dtype=float) if hol_cols else np.zeros((len(pdf), 0))
    scale = max(np.abs(y[train]).max(), 1e-9) if train.any() else 1.0
    return _Group(pdf, train, (pdf["role"] == "test").to_numpy(), y, scale, trend, np.column_stack([season, hol]), season.shape[1])


def _solve(g: _Group, grid: list[dict], spec: StructuralSpec):
    """Per parameter set: (set, trend in units of y, coefficients of the effect columns, rate changes).

    The fit is trend + effects (additive, coefficients in units of y) or trend · (1 + effects).
    """
    nt, ne = g.trend.shape[1], g.effects.shape[1]
    T, E, ys = g.trend[g.train], g.effects[g.train], g.y[g.train] / g.scale
    X = np.column_stack([T, E])
    gram, rhs = X.T @ X, X.T @ ys  # shared by every parameter set
    # pass 1: weak priors → noise variance
    weak = _ridge(gram, rhs, np.full(nt + ne, 1.0 / WEAK_PRIOR ** 2))
    sigma2 = max(float(np.mean((ys - X @ weak) ** 2)), 1e-8)
    for p in grid:
        prior = np.concatenate([[TREND_PRIOR, TREND_PRIOR], np.full(nt - 2, float(p.get("changepoint_prior_scale", 0.05))),
                                np.full(g.n_season, float(p.get("seasonality_prior_scale", SEASONALITY_PRIOR))),
                                np.full(ne - g.n_season, float(p.get("holidays_prior_scale", 10.0)))])
        pen = sigma2 / prior ** 2
        hinges, weight = slice(2, nt), sigma2 / float(p.get("changepoint_prior_scale", 0.05))
        if spec.mode == "additive":
            beta = sparse_fit(gram, rhs, pen, hinges, weight)
            yield p, g.trend @ beta[:nt] * g.scale, beta[nt:] * g.scale, beta[hinges] * g.scale
            continue
        bt, be = sparse_fit(gram[:nt, :nt], rhs[:nt], pen[:nt], hinges, weight), np.zeros(ne)
        for _ in range(ROUNDS):
            level = np.maximum(T @ bt, 1e-6)
            if ne:
                be = _ridge(gram[nt:, nt:], E.T @ (ys / level - 1.0), pen[nt:] / np.mean(level) ** 2)
            mult = 1.0 + E @ be
            bt = sparse_fit(gram[:nt, :nt], T.T @ (ys / np.where(np.abs(mult) < 1e-6, 1e-6, mult)), pen[:nt], hinges, weight)
        yield p, np.maximum(g.trend @ bt, 1e-6) * g.scale, be, bt[hinges] * g.scale


OUT = ["param_id", "ds", "actual", "fcst", "lo", "hi", "status", "n_train"]


def fit_predict_group(pdf: pd.DataFrame, grid: list[dict], spec: StructuralSpec, hol_cols: list[str],
                      key_cols: list[str]) -> pd.DataFrame:
    """One group: rows with ``role`` train/test (test rows may have null ``y``). Every test row
    comes out; without training rows its forecast is null and its status ``no_train``."""
    g = _group(pdf, spec, hol_cols)
    if not g.test.any():
        return pd.DataFrame(columns=key_cols + OUT)
    n_train, none = int(g.train.sum()), np.full(len(g.y), np.nan)
    fits = _solve(g, grid, spec) if n_train else ((p, none, np.zeros(g.effects.shape[1]), none[:0]) for p in grid)
    out = []
    for p, trend, be, changes in fits:
        effect = g.effects @ be
        fc = trend + effect if spec.mode == "additive" else trend * (1.0 + effect)
        f, lo, hi = fc[g.test], none[g.test], none[g.test]
        if n_train:
            rng = np.random.default_rng([int(p["param_id"]), n_train])
            far = future_trends(g.trend[g.test, 1], changes, rng)
            if spec.mode != "additive":
                far = far * (1.0 + effect[g.test])
            far = far + rng.choice(g.y[g.train] - fc[g.train], far.shape)
            lo, hi = f + np.quantile(far, [(1 - INTERVAL_WIDTH) / 2, 1 - (1 - INTERVAL_WIDTH) / 2], axis=0)
        out.append(pd.DataFrame({"param_id": int(p["param_id"]), "ds": g.frame.loc[g.test, "ds"].to_numpy(),
                                 "actual": g.y[g.test], "fcst": f, "lo": lo, "hi": hi,
                                 "status": "fitted" if n_train else "no_train", "n_train": n_train}))
    res = pd.concat(out, ignore_index=True)
    for c in key_cols:
        res[c] = pdf[c].iloc[0]
    return res[key_cols + OUT]


def holiday_indicators(df: DataFrame, windows: HolidayWindows | None) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per (holiday, offset) of ``windows``: a pivot over the listed keys, so
    each day's row carries its holiday-window regressors."""
    if windows is None:
        return df, []
    keyed = windows.days.select("ds", F.concat_ws("_", F.regexp_replace("holiday", "[^A-Za-z0-9]", ""),
                                            F.col("offset").cast("string")).alias("hk"))
    names = windows.keys()
    wide = keyed.distinct().groupBy("ds").pivot("hk", names).agg(F.count(F.lit(1)))
    cols = [f"hol_{n}" for n in names]
    wide = wide.select("ds", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("double").alias(c) for n, c in zip(names, cols)])
    out = df.join(F.broadcast(wide), "ds", "left").fillna(0.0, subset=cols)
    return out, cols


def _model_rows(rows: DataFrame, keys: list[str], windows: HolidayWindows | None, *more: str) -> tuple[DataFrame, list[str]]:
    # Only the day index crosses into Python; the sin/cos terms are rebuilt from it inside the
    # group (shipping 2·Σorder doubles per fold-expanded row would dominate the cost).
    x = rows.withColumn("t", F.datediff("ds", F.lit("1970-01-01").cast("date")))
    x, hol_cols = holiday_indicators(x, windows)
    x = x.select(*keys, *more, "ds", F.col("y").cast("double").alias("y"), "role", "t", *hol_cols)
    return spread_groups(x, keys), hol_cols


def _key_schema(rows: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name in keys}
    return ", ".join(f"{k} {types[k]}" for k in keys)


def forecast_structural(rows: DataFrame, grid: list[dict], keys: list[str], spec: StructuralSpec = StructuralSpec(),
                        windows: HolidayWindows | None = None, chosen: str | None = None) -> DataFrame:
    """Fit every parameter set per ``keys`` group on rows tagged ``role`` train/test.

    ``rows``: ``keys…, ds, y, role``. ``chosen`` names a column with the one ``param_id`` to fit
    in each group (null: the first). Returns ``keys…, param_id, ds, actual, fcst, lo, hi, status,
    n_train``, one row per test row and set.
    """
    x, hol_cols = _model_rows(rows, keys, windows, *([chosen] if chosen else []))
    schema = _key_schema(rows, keys) + \
        ", param_id int, ds date, actual double, fcst double, lo double, hi double, status string, n_train int"
    grid = [dict(g) for g in grid]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = grid
        if chosen:
            mine = [g for g in grid if g["param_id"] == pdf[chosen].iloc[0]] or grid[:1]
        return fit_predict_group(pdf, mine, spec, hol_cols, keys)

    return x.groupBy(*keys).applyInPandas(run, schema)


def components(rows: DataFrame, params: dict, keys: list[str], spec: StructuralSpec = StructuralSpec(),
               windows: HolidayWindows | None = None) -> DataFrame:
    """Per day: trend, each seasonality and the holiday effect of the model that forecasts
    (additive: all in units of ``y``, their sum is the fit; multiplicative: effects as a share of
    the trend, the fit is trend · (1 + their sum)). Null values where a group has no training row."""
    x, hol_cols = _model_rows(rows, keys, windows)
    schema = _key_schema(rows, keys) + ", ds date, component string, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _group(pdf, spec, hol_cols)
        ns, ne = g.n_season, g.effects.shape[1]
        if g.train.any():
            _, trend, be, _ = next(_solve(g, [params], spec))
        else:
            trend, be = np.full(len(g.y), np.nan), np.full(ne, np.nan)
        names = [name for name, _ in spec.season_columns()]
        parts = {"trend": trend}
        for season, _, _ in spec.seasonalities:
            at = [i for i, n in enumerate(names) if n == season]
            parts[season] = g.effects[:, at] @ be[at]
        parts["holidays"] = g.effects[:, ns:] @ be[ns:]
        out = pd.concat([pd.DataFrame({"ds": g.frame["ds"].to_numpy(), "component": c, "value": v}) for c, v in parts.items()],
                        ignore_index=True)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[keys + ["ds", "component", "value"]]

    return x.groupBy(*keys).applyInPandas(run, schema)
