"""Seasonal ARIMA: exact likelihood, differencing, order search, forecasts against closed forms."""

import datetime as dt

import numpy as np
import pytest

from tidecast.models import sarima


def simulate(rng, n, phi=(), theta=(), burn=300):
    e = rng.normal(size=n + burn)
    y = np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = e[t] + sum(c * y[t - k] for k, c in enumerate(phi, 1) if t >= k) + sum(c * e[t - k] for k, c in enumerate(theta, 1) if t >= k)
    return y[burn:]


def dense(y, phi, theta, far=4000):
    """Profile log likelihood from the covariance matrix of the process."""
    psi = np.zeros(far)
    for j in range(far):
        psi[j] = 1.0 if j == 0 else (theta[j - 1] if j <= len(theta) else 0.0)
        psi[j] += sum(c * psi[j - k] for k, c in enumerate(phi, 1) if j >= k)
    n = len(y)
    gamma = np.array([psi[: far - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return cov


@pytest.mark.parametrize("order", [(1, 1, 0, 0), (2, 0, 0, 1), (1, 2, 1, 1), (0, 0, 0, 0)])
@pytest.mark.parametrize("gaps", [(), (4, 5, 17)])
def test_likelihood_equals_the_dense_normal_density(order, gaps):
    rng = np.random.default_rng(5)
    n = 30
    w = np.column_stack([rng.normal(size=n), np.ones(n), rng.normal(size=n)])
    w[list(gaps), 0] = np.nan
    x = rng.normal(scale=0.4, size=(1, sum(order)))
    phi, theta = (v[0] for v in sarima.polynomials(x, order))
    ok = ~np.isnan(w[:, 0])
    cov = dense(w[:, 0], phi, theta)[np.ix_(ok, ok)]
    y, z = w[ok, 0], w[ok, 1:]
    inv = np.linalg.inv(cov)
    beta = np.linalg.solve(z.T @ inv @ z, z.T @ inv @ y)
    r = y - z @ beta
    s2 = r @ inv @ r / len(y)
    want = -0.5 * (len(y) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(cov)[1])
    ll, got, var = sarima.likelihood(x, order, w)
    assert ll[0] == pytest.approx(want, abs=1e-6)
    assert got[0] == pytest.approx(beta, abs=1e-6) and var[0] == pytest.approx(s2, rel=1e-6)


def test_the_settled_filter_equals_the_step_by_step_one(monkeypatch):
    rng = np.random.default_rng(6)
    w = rng.normal(size=(500, 2))
    x = rng.normal(scale=0.3, size=(3, 4))
    phi, theta = sarima.polynomials(x, (1, 1, 1, 1))
    fast = sarima.filtered(phi, theta, w)
    late = w.copy()
    late = np.concatenate([late, [[np.nan, np.nan]]])  # a missing last day keeps the filter stepping
    slow = sarima.filtered(phi, theta, late)
    assert np.allclose(fast[0], slow[0][:, :500], atol=1e-6) and np.allclose(fast[1], slow[1][:, :500], atol=1e-6)


def test_parameters_next_to_a_unit_root_do_no_harm():
    rng = np.random.default_rng(8)
    w = np.column_stack([rng.normal(size=200), np.ones(200)])
    order = (5, 5, 2, 2)
    x = np.array([[0.1] * 14, [9.0] * 14, [-9.0, 9.0] * 7])
    ll, beta, _ = sarima.likelihood(x, order, w)
    alone = sarima.likelihood(x[:1], order, w)
    assert ll[0] == pytest.approx(alone[0][0], abs=1e-6) and beta[0] == pytest.approx(alone[1][0], abs=1e-6)
    assert not np.isnan(ll).any()
    at, aicc = sarima.fit_order(np.cumsum(w[:, 0]), np.zeros((200, 0)), 0, 0, (3, 1, 1, 1))
    assert np.isfinite(aicc) and np.abs(at).max() <= sarima.REACH


def test_a_fit_from_a_neighbour_is_no_worse_than_the_neighbour():
    y = simulate(np.random.default_rng(9), 400, phi=(0.6, 0.2), theta=(0.3,))
    w = np.column_stack([y, np.ones(400)])
    at, ll = sarima.maximise((1, 1, 0, 0), w)
    for order in ((2, 1, 0, 0), (1, 2, 0, 0), (2, 2, 0, 0), (1, 1, 1, 1)):
        more, got = sarima.maximise(order, w, near=((1, 1, 0, 0), at))
        assert got >= ll - 0.05
        assert got == pytest.approx(float(sarima.likelihood(more[None], order, w)[0][0]), abs=1e-9)
    alone, want = sarima.maximise((1, 0, 0, 0), w)
    assert sarima.maximise((1, 0, 0, 0), w, near=((1, 1, 0, 0), at))[1] == pytest.approx(want, abs=0.02)


def test_arma_coefficients_are_recovered():
    y = simulate(np.random.default_rng(1), 1500, phi=(0.7,), theta=(0.4,))
    at, _ = sarima.fit_order(y, np.zeros((1500, 0)), 0, 0, (1, 1, 0, 0))
    phi, theta = sarima.polynomials(at[None], (1, 1, 0, 0))
    assert phi[0, 0] == pytest.approx(0.7, abs=0.07) and theta[0, 0] == pytest.approx(0.4, abs=0.08)


def test_unit_roots_are_told_from_stable_and_fixed_patterns():
    hits = {"seasonal": 0, "fixed": 0, "walk": 0, "noise": 0}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        e = rng.normal(size=500)
        s = e.copy()
        for t in range(7, 500):
            s[t] += s[t - 7]
        fixed = np.tile([0, 3, 1, 4, 2, -5, -5], 72)[:500] + e
        hits["seasonal"] += sarima.seasonal_unit_root(s)
        hits["fixed"] += sarima.seasonal_unit_root(fixed)
        hits["walk"] += sarima.unit_roots(np.cumsum(e)) >= 1
        hits["noise"] += sarima.unit_roots(e) == 0
    assert hits["seasonal"] >= 17 and hits["fixed"] == 0 and hits["walk"] >= 18 and hits["noise"] >= 17, hits


def test_forecast_of_a_plain_autoregression_is_its_closed_form():
    y = simulate(np.random.default_rng(2), 400, phi=(0.8,)) + 10
    order = (1, 0, 0, 0)
    at, _ = sarima.fit_order(y, np.zeros((400, 0)), 0, 0, order)
    f, half = sarima.predict(y, np.zeros((400, 0)), 0, 0, order, at, np.zeros((20, 0)), 20)
    phi = sarima.polynomials(at[None], order)[0][0, 0]
    w, size = sarima._scaled(np.column_stack([y, np.ones(400)]))
    _, beta, s2 = sarima.likelihood(at[None], order, w)
    mean = beta[0, 0] / size[1]
    k = np.arange(1, 21)
    assert f == pytest.approx(mean + phi**k * (y[-1] - mean), abs=1e-6)
    assert half == pytest.approx(sarima.Z80 * np.sqrt(s2[0] * (1 - phi ** (2 * k)) / (1 - phi**2)), rel=1e-6)


def test_forecast_of_seasonal_differences_repeats_the_last_week():
    y = np.tile([0.0, 3, 1, 4, 2, -5, -5], 30) + 1e-9 * np.random.default_rng(3).normal(size=210)
    f, half = sarima.predict(y, np.zeros((210, 0)), 0, 1, (0, 0, 0, 0), np.zeros(0), np.zeros((14, 0)), 14)
    assert f == pytest.approx(np.tile(y[-7:], 2), abs=1e-6)
    assert half[13] == pytest.approx(half[0] * np.sqrt(2), rel=1e-6)


def test_search_runs_over_all_groups(spark):
    rng = np.random.default_rng(4)
    day = dt.date(2020, 1, 1)
    rows = []
    for sid, y in (("ar", 5 + simulate(rng, 340, phi=(0.8,))), ("noise", rng.normal(size=340)), (None, simulate(rng, 340, theta=(0.7,)))):
        x = rng.normal(size=340)
        for t in range(340):
            v = None if t in (50, 51) else float(y[t] + 3 * x[t])
            rows.append((sid, day + dt.timedelta(t), v, "train" if t < 320 else "test", float(x[t]), "clash"))
    rows += [("short", day + dt.timedelta(t), 4.0 + t % 2, "train" if t < 3 else "test", 0.0, "clash") for t in range(5)]
    rows += [("empty", day, 1.0, "test", 0.0, "clash")]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, role string, x double, p string")
    spec = sarima.SearchSpec(start=((1, 0, 0, 0), (0, 0, 0, 0)), largest=(2, 2, 0, 0))
    out = sarima.forecast_sarima(df, ["series_id"], ["x"], spec).toPandas()
    assert len(out) == 20 * 3 + 2 + 1
    status = {k: set(g) for k, g in out.groupby(out["series_id"].fillna("ma"))["status"]}
    assert status == {"ar": {"fitted"}, "noise": {"fitted"}, "ma": {"fitted"}, "short": {"mean"}, "empty": {"no_train"}}
    order = {k: (g["p"].iloc[0], g["q"].iloc[0]) for k, g in out.groupby(out["series_id"].fillna("ma")) if k in ("ar", "ma")}
    assert order["ar"][0] >= 1 and order["ma"][1] >= 1
    fitted = out[out["status"] == "fitted"]
    assert (abs(fitted["actual"] - fitted["fcst"]) < fitted["hi"] - fitted["fcst"]).mean() > 0.6
    assert abs(fitted["actual"] - fitted["fcst"]).mean() < 2.0  # the regressor alone moves values by 3 a unit
    assert sarima.forecast_sarima(df.limit(0), ["series_id"], ["x"], spec).count() == 0
