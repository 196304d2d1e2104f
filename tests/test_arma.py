"""Likelihoods beside the normal density of the whole series, and what a search finds."""

import datetime
import math
import os
import uuid

import numpy as np
import pytest

from chronoloom.operators import arma
from chronoloom.operators import forecasts as fo


def density(y, ar, ma, variance):
    """The log-density of the series as one normal vector, its covariances from a long moving average."""
    psi = [1.0]
    for k in range(1, 400):
        psi.append(sum(a * psi[k - 1 - j] for j, a in enumerate(ar) if k - 1 - j >= 0) + (ma[k - 1] if k <= len(ma) else 0.0))
    psi = np.array(psi)
    gamma = variance * np.array([psi[: len(psi) - k] @ psi[k:] for k in range(len(y))])
    cov = gamma[np.abs(np.subtract.outer(np.arange(len(y)), np.arange(len(y))))]
    return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y))


@pytest.mark.parametrize(("ar", "ma"), [([0.7], []), ([], [0.6]), ([0.5], [-0.4]), ([0.4, 0.3], [0.2, 0.5]), ([], [0.3, 0.1, 0.2, -0.2, 0.1]), ([0.2, 0.1, 0.1, 0.1, 0.2], [])])
def test_likelihood_is_the_normal_density(ar, ma):
    y = np.random.default_rng(len(ar) + 7 * len(ma)).normal(0, 1.3, 60)
    assert arma.log_likelihood(y, ar, ma, 1.7) == pytest.approx(density(y, ar, ma, 1.7), abs=1e-6)
    likeliest = max(density(y, ar, ma, v) for v in np.linspace(0.3, 6, 400))
    assert arma.log_likelihood(y, ar, ma) == pytest.approx(likeliest, abs=1e-2)


def test_first_order_in_closed_form():
    """An autoregression's likelihood is that of its first value and of each step."""
    y, a, v = np.array([0.3, -1.0, 0.5, 2.0]), 0.6, 1.5
    want = -0.5 * (4 * math.log(2 * math.pi * v) - math.log(1 - a * a) + ((1 - a * a) * y[0] ** 2 + sum((y[1:] - a * y[:-1]) ** 2)) / v)
    assert arma.log_likelihood(y, [a], [], v) == pytest.approx(want, abs=1e-9)


def simulated(rng, ar, ma, n):
    e, y = rng.normal(0, 1, n + 100), [0.0] * 10
    for t in range(10, n + 100):
        y.append(sum(a * y[t - 1 - j] for j, a in enumerate(ar)) + e[t] + sum(m * e[t - 1 - j] for j, m in enumerate(ma)))
    return np.array(y[-n:])


def test_the_search_reaches_a_maximum():
    rng = np.random.default_rng(2)
    for ar, ma in (([0.7], []), ([], [0.6]), ([0.5], [0.4])):
        y = simulated(rng, ar, ma, 400) + 3
        fits = {(f.p, f.q): f for f in arma.fit_orders(y, {o: fo.start_values(y, *o) for o in fo.CANDIDATES}, True)}
        assert len(fits) == 10
        true = arma.log_likelihood(y - y.mean(), ar, ma)
        for (p, q), f in fits.items():
            assert f.likelihood == pytest.approx(arma.log_likelihood(y - f.mean, f.ar, f.ma), abs=1e-6) and f.aic == pytest.approx(2 * (p + q + 2) - 2 * f.likelihood)
            if p >= len(ar) and q >= len(ma):
                assert f.likelihood >= true - 1e-3  # holds the true model
            for k in range(len(f.theta)):  # no small change is likelier
                for h in (-1e-3, 1e-3):
                    theta = f.theta + h * (np.arange(len(f.theta)) == k)
                    if (p, q) in {(1, 0), (0, 1)}:
                        assert arma.log_likelihood(y - theta[0], theta[1 : 1 + p], theta[1 + p :]) <= f.likelihood + 1e-7


def test_forecasts_continue_the_state():
    y = simulated(np.random.default_rng(4), [0.6], [], 300) + 5
    (f,) = arma.fit_orders(y, {(1, 0): np.array([5.0, 0.5])}, True)
    want = f.mean + (y[-1] - f.mean) * f.ar[0] ** np.arange(1, 9)
    assert np.allclose(f.forecast(8), want)
    order, aic, forecast = fo.arima_search(y)
    assert order[1] == 0 and aic == min(g.aic for g in arma.fit_orders(y, {o: fo.start_values(y, *o) for o in fo.CANDIDATES}, True)) and len(forecast(5)) == 5
    assert fo.arima_search(np.array([1.0, math.nan, 2.0]))[:2] == (None, None)


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    weights, traces = tmp_path / "weights.txt", tmp_path / "traces"
    weights.write_text("3.0")
    traces.mkdir()
    rows = [(f"s{i}", k, datetime.datetime(2024, 1, 1, k), float(i + k)) for i in range(60) for k in range(3)]
    series = spark.createDataFrame(rows, "series_id string, pos int, ts timestamp_ntz, value double").repartition(12)
    there = str(traces)

    def load(path):
        """A factor from a file of weights; leaves a trace of each load."""
        with open(path) as f:
            factor = float(f.read())
        with open(f"{there}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda x, h: np.full(h, x[-1] * factor)

    factory = fo.ModelFactory("triple", load, str(weights))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for _ in range(2):
            got = {(r["series_id"], r["step"]): r["yhat"] for r in fo.forecast_with_model(series, "t", 2, {"t": factory}).collect()}
            assert got == {(f"s{i}", k): 3.0 * (i + 2) for i in range(60) for k in range(2)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    loads = [t.name.split("-")[0] for t in traces.iterdir()]
    assert loads and len(loads) == len(set(loads))
