"""Seasonal ARIMA with regressors and a stepwise order search, run as rounds of Spark jobs.

Differencing is decided per (series, fold): the seasonal one by the OCSB regression, the plain one by
KPSS. Each round of the search is one job over all groups: the neighbours of every group's best order
that have not been tried yet are rows of their own, dealt over the cluster and fitted next to each
other; the search ends when no group has an untried neighbour. A fit maximises the exact Gaussian
likelihood: a Kalman filter runs over the differenced values and all differenced regressors at once
(they share the gains), so coefficients and variance drop out by least squares on the innovations and
only the AR and MA parts are searched, by BFGS over partial autocorrelations (always stationary and
invertible). Differences to the usual solver: coefficients of regressors are concentrated out, and a
constant (no differencing) or a drift (one differencing) is always kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import fit_partitions, spread_groups
from ..session import cut_lineage
from .arx import REGRESSORS, SEASON, Z80

# --- fixed values (published critical values at 5 %) --------------------------------------
KPSS_LEVEL = 0.463
OCSB_SEASON_7 = -1.845
# -------------------------------------------------------------------------------------------

ORDER = ("p", "q", "sp", "sq")
BLOCK = 64
MAX_D = 2
#: Partial autocorrelations stay within tanh(3) = 0.995.
REACH = 3.0
#: Least gain of a step in log likelihood.
GAIN = 2e-3


@dataclass(frozen=True)
class SearchSpec:
    """First orders (p, q, seasonal p, seasonal q) and the largest of each part."""

    start: tuple[tuple[int, int, int, int], ...] = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
    largest: tuple[int, int, int, int] = (5, 5, 2, 2)
    steps: tuple[tuple[int, int, int, int], ...] = (
        (1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (1, 1, 0, 0), (-1, -1, 0, 0),
        (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1), (0, 0, 1, 1), (0, 0, -1, -1))


# ---------------------------------------------------------------- differencing

def _filled(y: np.ndarray) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(y))
    return np.interp(np.arange(len(y)), known, y[known])


def seasonal_unit_root(y: np.ndarray, season: int = SEASON, lags: int = 3) -> int:
    """1 where the OCSB regression does not reject a seasonal unit root, else 0."""
    first = season + 1 + lags
    if len(y) < first + lags + 2 + 10:
        return 0
    sd, pd_ = y[season:] - y[:-season], np.diff(y)
    both = np.diff(sd)
    t = np.arange(first, len(y))
    m = np.column_stack([*[both[t - season - 1 - k] for k in range(1, lags + 1)], sd[t - 1 - season], pd_[t - season - 1]])
    target = both[t - season - 1]
    inv = np.linalg.pinv(m.T @ m)
    beta = inv @ (m.T @ target)
    s2 = float(np.sum((target - m @ beta) ** 2)) / max(len(t) - m.shape[1], 1)
    se = np.sqrt(s2 * inv[-1, -1])
    return int(se > 1e-12 and beta[-1] / se > OCSB_SEASON_7)


def unit_roots(y: np.ndarray) -> int:
    """How often to difference until KPSS no longer rejects a stable level (MAX_D at most)."""
    for d in range(MAX_D):
        n = len(y)
        if n < 10 or np.ptp(y) < 1e-12:
            return d
        e = y - y.mean()
        lag = int(4 * (n / 100) ** 0.25)
        lrv = e @ e / n + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lag + 1))
        if lrv <= 0 or np.sum(np.cumsum(e) ** 2) / (n * n * lrv) <= KPSS_LEVEL:
            return d
        y = np.diff(y)
    return MAX_D


def _difference(y: np.ndarray, d: int, sd: int) -> np.ndarray:
    for _ in range(sd):
        y = y[SEASON:] - y[:-SEASON]
    for _ in range(d):
        y = y[1:] - y[:-1]
    return y


# ------------------------------------------------------------------- likelihood

def _from_partial(x: np.ndarray) -> np.ndarray:
    """Stationary AR coefficients of partial autocorrelations tanh(x), by row."""
    r, out = np.tanh(x), np.zeros_like(x)
    for k in range(x.shape[1]):
        head = out[:, :k].copy()
        out[:, :k] = head - r[:, k : k + 1] * head[:, ::-1]
        out[:, k] = r[:, k]
    return out


def _product(plain: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """Lag polynomials 1 - sum(plain) times 1 - sum(seasonal), without the leading 1."""
    n, m = plain.shape[1], seasonal.shape[1]
    out = np.zeros((len(plain), n + SEASON * m + 1))
    one = np.column_stack([np.ones(len(plain)), -plain])
    out[:, : n + 1] = one
    for k in range(m):
        at = SEASON * (k + 1)
        out[:, at : at + n + 1] -= seasonal[:, k : k + 1] * one
    return out[:, 1:]


def polynomials(x: np.ndarray, order: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """AR coefficients (phi) and MA coefficients (theta) with the seasonal parts multiplied out."""
    p, q, sp, sq = order
    a, b, c, d = (_from_partial(v) for v in np.split(x, np.cumsum([p, q, sp]), axis=1))
    return -_product(a, c), _product(b, d)


def filtered(phi: np.ndarray, theta: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovations (rows of phi, time, columns of w), their variances and the state after the last
    step. Missing values (a row of w with a NaN) are skipped: innovation NaN.

    Once the covariance has settled the filter is a fixed linear recursion, taken BLOCK steps at once.
    """
    n_batch, n, cols = len(phi), len(w), w.shape[1]
    r = max(phi.shape[1], theta.shape[1] + 1)
    step = np.zeros((n_batch, r, r))
    step[:, : phi.shape[1], 0] = phi
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    noise = np.zeros((n_batch, r))
    noise[:, 0], noise[:, 1 : theta.shape[1] + 1] = 1.0, theta
    var = noise[:, :, None] * noise[:, None, :]
    cov, power = var.copy(), step.copy()
    for _ in range(60):  # sum of step^k var step'^k by doubling
        more = power @ cov @ power.transpose(0, 2, 1)
        cov = cov + more
        power = power @ power
        if not (np.abs(more).max(axis=(1, 2)) > 1e-14 * np.abs(cov).max(axis=(1, 2))).any():
            break
    state = np.zeros((n_batch, r, cols))
    v, f = np.full((n_batch, n, cols), np.nan), np.ones((n_batch, n))
    missing = np.flatnonzero(np.isnan(w).any(axis=1))
    skip, last = set(missing.tolist()), int(missing.max()) if len(missing) else -1
    turned = step.transpose(0, 2, 1)
    for t in range(n):
        state_next, cov_next = step @ state, step @ cov @ turned + var
        if t not in skip:
            f[:, t] = cov[:, 0, 0]
            gain = (step @ cov[:, :, :1]) / cov[:, :1, :1]
            v[:, t] = w[t] - state[:, 0]
            state_next = state_next + gain * v[:, t][:, None, :]
            cov_next = cov_next - cov[:, :1, :1] * (gain @ gain.transpose(0, 2, 1))
            if t > last and t % 8 == 7:
                moved, size = (np.abs(c).max(axis=(1, 2)) for c in (cov_next - cov, cov))
                if not (moved > 1e-9 * size).any():  # rows that overflowed hold up nothing
                    return _settled(step, gain, state_next, w, v, f, t + 1, cov_next[:, 0, 0])
        state, cov = state_next, cov_next
    return v, f, state


def _settled(step, gain, state, w, v, f, begin, level):
    """The rest of the filter from ``begin`` on, with fixed gains."""
    n_batch, r, _ = step.shape
    f[:, begin:] = level[:, None]
    back = step.copy()
    back[:, :, :1] -= gain
    look = np.zeros((n_batch, BLOCK, r))  # what the state adds to each step of a block
    push = np.zeros((n_batch, r, BLOCK))  # what each value of a block adds to the state after it
    look[:, 0, 0], push[:, :, BLOCK - 1 :] = 1.0, gain
    for j in range(1, BLOCK):
        look[:, j : j + 1] = look[:, j - 1 : j] @ back
        push[:, :, BLOCK - 1 - j : BLOCK - j] = back @ push[:, :, BLOCK - j : BLOCK - j + 1]
    echo = (look @ gain)[:, :, 0]
    i, j = np.tril_indices(BLOCK, -1)
    inner = np.zeros((n_batch, BLOCK, BLOCK))
    inner[:, i, j] = echo[:, i - j - 1]
    whole = np.linalg.matrix_power(back, BLOCK)
    for t in range(begin, len(w), BLOCK):
        part = w[t : t + BLOCK]
        m = len(part)
        v[:, t : t + m] = part - look[:, :m] @ state - inner[:, :m, :m] @ part
        move = whole if m == BLOCK else np.linalg.matrix_power(back, m)
        state = move @ state + push[:, :, BLOCK - m :] @ part
    return v, f, state


def likelihood(x: np.ndarray, order, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row of x: log likelihood, coefficients and variance. w: the values, then regressors.

    Rows so near a unit root that the filter loses its precision have likelihood minus infinity.
    """
    with np.errstate(all="ignore"):
        v, f, _ = filtered(*polynomials(x, order), w)
        seen = ~np.isnan(w).any(axis=1)
        scaled = v[:, seen] / np.sqrt(f[:, seen])[:, :, None]
    good = np.isfinite(scaled).all(axis=(1, 2))
    n, k = int(seen.sum()), w.shape[1] - 1
    ll, beta, s2 = np.full(len(x), -np.inf), np.zeros((len(x), k)), np.full(len(x), np.nan)
    if good.any():
        y, z = scaled[good, :, :1], scaled[good, :, 1:]
        zt = z.transpose(0, 2, 1)
        b = np.linalg.pinv(zt @ z, hermitian=True) @ (zt @ y)
        beta[good] = b[:, :, 0]
        s2[good] = np.maximum(((y - z @ b) ** 2).sum(axis=(1, 2)) / n, 1e-12)
        ll[good] = -0.5 * (n * (np.log(2 * np.pi * s2[good]) + 1) + np.log(f[good][:, seen]).sum(axis=1))
    return ll, beta, s2


def _starts(order, near: tuple | None) -> np.ndarray:
    """Parameters to begin from: small and middling ones of either sign for the AR and the MA part,
    and those of a fitted neighbour (order, parameters), which a partial autocorrelation near 0
    leaves the same model in a larger order."""
    p, q, sp, sq = order
    ar = np.concatenate([np.ones(p), np.zeros(q), np.ones(sp), np.zeros(sq)])
    rows = [a * ar + b * (1 - ar) for a, b in ((0.1, 0.1), (0.5, 0.3), (0.5, -0.3), (-0.5, 0.3), (-0.1, -0.1), (0.1, 0.8), (0.1, -0.8))]
    if near is not None:
        parts = np.split(np.asarray(near[1], float), np.cumsum(near[0])[:-1])
        rows.append(np.concatenate([np.r_[part[:n], np.full(max(0, n - len(part)), 0.02)] for n, part in zip(order, parts)]))
    return np.array(rows)


def maximise(order, w: np.ndarray, near: tuple | None = None, rounds: int = 60) -> tuple[np.ndarray, float]:
    """BFGS from the best of ``_starts`` until a step gains less than GAIN; gradient and step
    lengths are batches."""
    m = sum(order)
    starts = _starts(order, near)
    ll = likelihood(starts, order, w)[0]
    x, best = starts[int(np.argmax(ll))], float(ll.max())
    if not m:
        return x, best
    eye, eps = np.eye(m), 1e-4
    lengths = np.array([1.0, 0.4, 0.1, 0.01, 0.001])[:, None]

    def gradient(at: np.ndarray) -> np.ndarray:
        ll = likelihood(np.concatenate([at + eps * eye, at - eps * eye]), order, w)[0]
        up, down = ll[:m], ll[m:]
        return np.where(np.isfinite(up) & np.isfinite(down), up - down, 0.0) / (2 * eps)

    h, g = eye / max(1.0, len(w) / 4), gradient(x)
    for _ in range(rounds):
        if g @ h @ g <= 0:
            h = eye / max(1.0, len(w) / 4)
        tries = np.clip(x + lengths * (h @ g), -REACH, REACH)
        ll = likelihood(tries, order, w)[0]
        k = int(np.argmax(ll))
        if not ll[k] > best + GAIN:
            if ll[k] > best:
                x, best = tries[k], float(ll[k])
            break
        move, new = tries[k] - x, gradient(tries[k])
        x, best, bend, g = tries[k], float(ll[k]), g - new, new
        if (sy := float(move @ bend)) > 1e-12:
            left = eye - np.outer(move, bend) / sy
            h = left @ h @ left.T + np.outer(move, move) / sy
    return x, best


# ------------------------------------------------------------------- one group

def _design(y: np.ndarray, x: np.ndarray, d: int, sd: int) -> np.ndarray:
    """Values and regressors by day, with a constant or a drift, before differencing."""
    n = len(y)
    level = [np.ones(n)] if d + sd == 0 else [np.arange(n, dtype=float)] if d + sd == 1 else []
    return np.column_stack([y, x, *level])


def _scaled(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of regressors at unit size (columns without any size are left)."""
    size = np.sqrt(np.nansum(w * w, axis=0) / max(len(w), 1))
    size = np.where(size > 1e-12, size, 1.0)
    size[0] = 1.0
    return w / size, size


def fit_order(y, x, d, sd, order, near=None) -> tuple[np.ndarray, float] | None:
    """Parameters and AICc of one order, or None where the rows are too few for it."""
    w, _ = _scaled(_difference(_design(y, x, d, sd), d, sd))
    n, k = int((~np.isnan(w).any(axis=1)).sum()), sum(order) + w.shape[1]
    if n <= k + 2:
        return None
    at, ll = maximise(order, w, near)
    return at, -2 * ll + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def predict(y, x, d, sd, order, at, x_new, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and half width of the 80 % band for 1 to ``horizon`` days after the last of ``y``.

    x_new: the regressors of those days (days not asked for may be NaN).
    """
    full = _design(np.concatenate([y, np.zeros(horizon)]), np.concatenate([x, x_new]), d, sd)
    w, size = _scaled(_difference(full[: len(y)], d, sd))
    _, beta, s2 = likelihood(at[None], order, w)
    beta = beta[0] / size[1:]
    rest = full[: len(y), 0] - full[: len(y), 1:] @ beta
    phi, theta = polynomials(at[None], order)
    state = filtered(phi, theta, _difference(rest[:, None], d, sd))[2][0, :, 0]
    lag = np.ones(1)  # (1 - B)^d (1 - B^season)^sd
    for _ in range(d):
        lag = np.convolve(lag, [1.0, -1.0])
    for _ in range(sd):
        lag = np.convolve(lag, np.r_[1.0, np.zeros(SEASON - 1), -1.0])
    keep = len(lag) - 1
    past = list(_filled(rest)[len(rest) - keep :]) if keep else []
    ahead = np.zeros(horizon)
    for h in range(horizon):
        ahead[h] = state[0] + sum(-c * past[-k] for k, c in enumerate(lag[1:], 1))
        past.append(ahead[h])
        state = np.r_[state[1:], 0.0] + np.r_[phi[0], np.zeros(len(state) - len(phi[0]))] * state[0]
    ar = -np.convolve(np.r_[1.0, -phi[0]], lag)[1:]
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = 1.0 if j == 0 else (theta[0][j - 1] if j <= len(theta[0]) else 0.0)
        psi[j] += sum(c * psi[j - k] for k, c in enumerate(ar[:j], 1))
    return ahead + full[len(y) :, 1:] @ beta, Z80 * np.sqrt(s2[0] * np.cumsum(psi**2))


# ----------------------------------------------------------------------- Spark

def _pack(pdf: pd.DataFrame, keys: list[str], xcols: list[str]) -> pd.DataFrame:
    """One row a group: training values by day, regressors by day, test rows, differencing."""
    pdf = pdf.sort_values("ds")
    day = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(np.int64)
    train = ((pdf["role"] == "train") & pdf["y"].notna()).to_numpy()
    test = (pdf["role"] == "test").to_numpy()
    out = {k: [pdf[k].iloc[0]] for k in keys}
    n, d, sd = 0, 0, 0
    y = x = ahead = np.zeros(0)
    start = end = 0
    if train.any():
        start, end = int(day[train].min()), int(day[train].max())
        n = end - start + 1
        x_all, y_all = pdf[xcols].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)
        y, x = np.full(n, np.nan), np.full((n, len(xcols)), np.nan)
        y[day[train] - start], x[day[train] - start] = y_all[train], x_all[train]
        whole = _filled(y)
        sd = seasonal_unit_root(whole)
        d = unit_roots(_difference(whole, 0, sd))
        later = test & (day > end)
        ahead = np.full((int(day[later].max()) - end if later.any() else 0, len(xcols)), np.nan)
        ahead[day[later] - end - 1] = x_all[later]
    out |= {"y": [y], "x": [np.ravel(x)], "ahead": [np.ravel(ahead)], "days": [list(pd.to_datetime(pdf["ds"][test]).dt.date)],
            "step": [(day[test] - end).astype(np.int32)], "actual": [pdf["y"][test].to_numpy(dtype=float)],
            "d": [d], "sd": [sd], "n_train": [int(train.sum())]}
    return pd.DataFrame(out)


def _fit_rows(frames: Iterator[pd.DataFrame], nx: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            order = (r.p, r.q, r.sp, r.sq)
            near = None if r.near is None else (tuple(r.near[c] for c in ORDER), r.near["at"])
            got = fit_order(np.asarray(r.y, float), np.asarray(r.x, float).reshape(-1, nx), r.d, r.sd, order, near) if len(r.y) else None
            out.append((r.gid, *order, got[1] if got else None, list(got[0]) if got else None))
        yield pd.DataFrame(out, columns=["gid", *ORDER, "aicc", "at"])


def _predict_rows(frames: Iterator[pd.DataFrame], keys: list[str], nx: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for r in pdf.to_dict("records"):
            m = len(r["days"])
            y = np.asarray(r["y"], float)
            level = float(np.nanmean(y)) if r["n_train"] else np.nan
            fc, half = np.full(m, level), np.full(m, Z80 * float(np.nanstd(y)) if r["n_train"] else np.nan)
            status = np.full(m, "mean" if r["n_train"] else "no_train", dtype=object)
            ahead = np.asarray(r["ahead"], float).reshape(-1, nx)
            fitted = r["at"] is not None
            if fitted and len(ahead):
                order = tuple(int(r[c]) for c in ORDER)
                f, w = predict(y, np.asarray(r["x"], float).reshape(-1, nx), r["d"], r["sd"], order, np.asarray(r["at"], float), ahead, len(ahead))
                step = np.asarray(r["step"])
                ok = step >= 1
                ok[ok] = np.isfinite(f[step[ok] - 1])
                fc[ok], half[ok], status[ok] = f[step[ok] - 1], w[step[ok] - 1], "fitted"
            out = pd.DataFrame({"ds": list(r["days"]), "actual": np.asarray(r["actual"], float), "fcst": fc, "lo": fc - half, "hi": fc + half})
            for c in ORDER:
                out[c] = pd.array([int(r[c]) if fitted else None] * m, dtype="Int32")
            out["d"], out["sd"], out["aicc"] = r["d"], r["sd"], r["aicc"] if fitted else np.nan
            out["status"], out["n_train"] = status, r["n_train"]
            for k in keys:
                out[k] = [r[k]] * m
            yield out


def search_orders(packed: DataFrame, nx: int, spec: SearchSpec = SearchSpec()) -> DataFrame:
    """gid, order, aicc, at: every order tried for each packed group (aicc null: too few rows).

    One job a round over the untried neighbours of every group's best order, each fitted from the
    parameters of that best one.
    """
    spark = packed.sparkSession
    orders = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(ORDER, o)]) for o in spec.start])
    todo = packed.select("gid", F.inline(orders), F.lit(None).cast("struct<p:int,q:int,sp:int,sq:int,at:array<double>>").alias("near"))
    tried = None
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"by_{c}") for c, v in zip(ORDER, s)]) for s in spec.steps])
    within = " and ".join(f"{c} between 0 and {top}" for c, top in zip(ORDER, spec.largest))
    schema = "gid long, p int, q int, sp int, sq int, aicc double, at array<double>"
    while True:
        rows = todo.join(packed.select("gid", "y", "x", "d", "sd"), "gid").repartition(fit_partitions(spark), "gid", *ORDER)
        fits = cut_lineage(rows.mapInPandas(lambda it: _fit_rows(it, nx), schema), "orders")
        tried = fits if tried is None else tried.unionByName(fits)
        best = best_orders(tried).select("gid", F.struct(*ORDER, "at").alias("near"), F.inline(moves))
        beside = best.select("gid", *[(F.col(f"near.{c}") + F.col(f"by_{c}")).alias(c) for c in ORDER], "near").where(within)
        todo = cut_lineage(beside.join(tried, ["gid", *ORDER], "left_anti"), "neighbours")
        if todo.isEmpty():
            return tried


def best_orders(tried: DataFrame) -> DataFrame:
    """The order of lowest AICc by group (ties: the smaller order); groups without a fit have none."""
    pick = F.min(F.struct("aicc", *ORDER, "at")).alias("best")
    return tried.where("aicc is not null and not isnan(aicc)").groupBy("gid").agg(pick).select("gid", "best.*")


def forecast_sarima(rows: DataFrame, keys: list[str], xcols=REGRESSORS, spec: SearchSpec = SearchSpec()) -> DataFrame:
    """``rows``: ``keys…, ds, y, role`` and the regressors, one row a day.

    Returns ``keys…, ds, actual, fcst, lo, hi, p, d, q, sp, sd, sq, aicc, status, n_train``, one row
    per test row. ``status``: ``fitted``; ``mean`` (no order could be fitted, a regressor is missing or
    the day is not after training: the training mean); ``no_train`` (null forecast). Training days
    without a value or a regressor are skipped by the filter. No rows give no rows.
    """
    xcols, nx = list(xcols), len(xcols)
    x = rows.select(*keys, "ds", F.col("y").cast("double").alias("y"), "role", *[F.col(c).cast("double").alias(c) for c in xcols])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name in keys)
    schema = types + ", y array<double>, x array<double>, ahead array<double>, days array<date>, step array<int>, actual array<double>, d int, sd int, n_train int"
    packed = spread_groups(x, keys).groupBy(*keys).applyInPandas(lambda pdf: _pack(pdf, keys, xcols), schema)
    packed = cut_lineage(packed.withColumn("gid", F.monotonically_increasing_id()), "packed")
    best = best_orders(search_orders(packed, nx, spec))
    both = packed.join(best, "gid", "left").repartition(fit_partitions(rows.sparkSession), "gid")
    out = ["ds date", "actual double", "fcst double", "lo double", "hi double", *[f"{c} int" for c in ("p", "d", "q", "sp", "sd", "sq")],
           "aicc double", "status string", "n_train int"]
    names = [*[f.name for f in x.schema.fields if f.name in keys], *[c.split()[0] for c in out]]
    return both.mapInPandas(lambda it: (part[names] for part in _predict_rows(it, keys, nx)), types + ", " + ", ".join(out))
