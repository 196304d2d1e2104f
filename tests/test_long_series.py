"""Sliced features beside the window forms, numbering over ranges, segmentation beside brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import features as fx
from chronoloom.functions import long_series as lx
from chronoloom.functions import segmentation as sg
from chronoloom.operators import ranges


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    named = {
        "noise": rng.normal(0, 1, 700), "walk": np.cumsum(rng.normal(0, 1, 423)), "ties": rng.integers(0, 3, 301).astype(float), "flat": np.full(90, 2.5), "steps": np.repeat(rng.normal(0, 2, 31), 11),
        "up": np.arange(230.0), "flat_then_up": np.r_[np.zeros(150), np.arange(60.0)], "one": [4.0], "two": [1.0, 3.0], "three": [1.0, 1.0, 0.0], "n24": rng.normal(0, 1, 24), "n25": rng.normal(0, 1, 25),
        "nan": np.r_[rng.normal(0, 1, 40), np.nan, rng.normal(0, 1, 9)], "big": 1e9 + rng.normal(0, 1, 500),
    }
    rows = [(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, pos int, value double").repartition(4).cache()


def table(df):
    flat = lambda v: v if isinstance(v, (list, tuple)) else [v]
    return {r["series_id"]: np.array([float(x) for c in sorted(df.columns) if c != "series_id" for x in flat(r[c])]) for r in df.collect()}


def same(got, want, rel=1e-9, but=()):
    got, want = table(got), table(want)
    assert set(got) == set(want)
    for k in want:
        if k not in but:
            assert got[k] == pytest.approx(want[k], rel=rel, abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("rows", [7, 100, 1 << 16])
def test_slices_of_any_size_give_the_same(series, rows):
    same(lx.slopes_and_runs(series, rows), fx.slopes_and_runs(series))
    # sums about means of 1e9 lose digits in the window form, not in slices with their own centres
    same(lx.basic_statistics(series, rows=rows), fx.basic_statistics(series, with_spectrum=False).drop("mean_abs_corr", "pca_var_ratio1"), rel=1e-6)


def test_residuals_quality_and_events_of_slices(series):
    finite = series.filter("series_id <> 'nan'")
    for rows in (7, 1 << 16):
        got, want = lx.residual_diagnostics(finite, rows), fx.residual_diagnostics(finite)
        same(got, want, rel=1e-6, but=("big",))
        same(got, want, rel=1e-4)
    one = lambda df: {(r["series_id"], r["pos"]): r["residual"] for r in df.collect()}
    got, want = one(lx.ar_residuals(finite, 50)), one(fx.ar_residuals(finite))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    same(lx.data_quality(series), fx.data_quality(series))
    segments = lambda df: sorted(tuple(r) for r in df.collect())
    assert segments(lx.event_segments(finite, rows=10)) == segments(fx.event_segments(finite))
    same(lx.event_summary(finite, rows=10), fx.event_summary(finite))


def test_no_task_sees_more_than_a_slice(series):
    """Every window over points is one over slices; those over series are over a row a slice."""
    sizes = lx.sliced(series, 50, 24).groupBy("series_id", "slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 74
    plan = lx.slopes_and_runs(series, 50)._jdf.queryExecution().optimizedPlan().toString()
    over_points, over_series = plan.count("[series_id#"), plan.count("slice#")
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # from the plan's end: windows over (series, slice), an aggregate of slices, then windows over series
    cut = next(i for i, line in enumerate(plan.split("\n")) if "Aggregate [series_id" in line and "slice" in line.split("]")[0])
    below = [line for line in plan.split("\n")[cut:] if "Window [" in line]
    assert over_points and over_series and below and len(windows) > len(below) and all(", slice#" in line.rsplit("], [", 2)[1] for line in below)


def test_quantiles_are_those_of_percentile(series):
    shares = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}
    got = ranges.order_statistics(series.union(series.sparkSession.createDataFrame([("one", 1, None)], series.schema)), "value", shares)
    want = series.groupBy("series_id").agg(*(F.percentile("value", F.lit(s)).alias(n) for n, s in shares.items()))
    same(got, want, rel=1e-14)


def test_numbers_and_runs_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if k == 3 else int(k), int(g)) for i, (k, g) in enumerate(zip(np.repeat(rng.integers(0, 4, 300), rng.integers(1, 40, 300)), rng.integers(0, 5, 12_000), strict=False))]
    df = spark.createDataFrame(rows, "i int, k int, g int").repartition(5)
    seen, want = {}, {}
    for i, _, g in rows:
        want[i] = seen[g] = seen.get(g, -1) + 1
    got = ranges.numbered(df, ["g"], ["i"], "n", "all").collect()
    assert {r["i"]: r["n"] for r in got} == want and all(r["all"] == seen[r["g"]] + 1 for r in got)
    last, run, want = object(), 0, {}
    for i, k, _ in rows:
        run = run + 1 if k is not None and k == last else 0
        last, want[i] = k, run
    assert {r["i"]: r["n"] for r in ranges.numbered_runs(df, "k", "i", "n").collect()} == want
    assert ranges.numbered(df.filter("false"), ["g"], ["i"]).count() == ranges.numbered_runs(df.filter("false"), "k", "i", "n").count() == 0


def brute_peaks(x, prominence):
    found, i, n = [], 1, len(x)
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i] > x[i - 1] and j < n - 1 and x[j + 1] < x[i]:
            p = (i + j) // 2
            lo = max((k for k in range(p) if x[k] > x[p]), default=0)
            hi = min((k for k in range(p, n) if x[k] > x[p]), default=n - 1)
            prom = x[p] - max(x[lo : p + 1].min(), x[p : hi + 1].min())
            if prom >= prominence:
                level = x[p] - prom / 2
                a = max((k for k in range(p) if x[k] <= level), default=0)
                b = min((k for k in range(p, n) if x[k] <= level), default=n - 1)
                left = a + (level - x[a]) / (x[a + 1] - x[a]) if x[a] < level else a
                right = b - (level - x[b]) / (x[b - 1] - x[b]) if x[b] < level else b
                found.append((p, prom, right - left))
        i = j + 1
    return found


def random_series(rng, kind, n):
    x = rng.normal(0, 1, n)
    return [x, rng.integers(0, 4, n).astype(float), np.cumsum(x), np.round(x, 1), np.repeat(rng.integers(0, 5, n // 3 + 1), 3)[:n].astype(float), rng.standard_cauchy(n)][kind]


def test_peaks_of_random_series(monkeypatch):
    rng = np.random.default_rng(5)
    for t in range(120):
        monkeypatch.setattr(sg, "_BLOCK", [4, 1024][t % 2])
        x = random_series(rng, t % 6, int(rng.integers(1, 200)))
        peaks, proms = sg.peaks_of(x, 0.5)
        assert [(int(p), q, w) for p, q, w in zip(peaks, proms, sg.half_widths(x, peaks, proms), strict=True)] == brute_peaks(x, 0.5)


def brute_breaks(x, penalty, least=2, jump=5):
    n, d = len(x), (x[:, None] - x[None]) ** 2
    middle = np.median(d[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d * (1 / middle if middle > 0 else 1.0), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    square = np.zeros((n + 1, n + 1))
    square[1:, 1:] = k.cumsum(0).cumsum(1)
    inner = lambda a, b: square[b, b] - square[a, b] - square[b, a] + square[a, a]
    best = {0: (0.0, [])}
    for e in [*range(jump, n, jump), n]:
        if e >= least:
            best[e] = min((best[a][0] + e - a - inner(a, e) / (e - a) + penalty, [*best[a][1], e]) for a in best if e - a >= least)
    return best[n][1]


def test_breaks_of_random_series(monkeypatch):
    monkeypatch.setattr(sg, "_STARTS", 8)
    rng = np.random.default_rng(8)
    for t in range(90):
        x = random_series(rng, t % 6, int(rng.integers(2, 260)))
        if t % 2:
            x = x + np.repeat(rng.normal(0, 3, len(x) // 20 + 1), 20)[: len(x)]
        assert sg.pelt_rbf(x, [1.0, 5.0][t % 2]) == brute_breaks(x, [1.0, 5.0][t % 2]), t


def test_costs_by_features_are_near_the_kernel():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(0, 3, 10), 40) + rng.normal(0, 1, 400)
    at = np.arange(0, 401, 5)
    cost = sg.KernelCost(x, at).of(at[:1] // 5, np.arange(1, 81))[:, 0]
    d = (x[:, None] - x[None]) ** 2
    k = np.exp(-np.clip(d / np.median(d[np.triu_indices(400, 1)]), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    true = [e - k[:e, :e].sum() / e for e in at[1:]]
    assert np.abs(cost - true).max() < 1e-2  # beside costs of up to some 200


def test_a_million_points_in_time():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 1_000_000)
    began = time.perf_counter()
    peaks, proms = sg.peaks_of(x, 1.0)
    assert len(sg.half_widths(x, peaks, proms)) > 100_000 and time.perf_counter() - began < 5
    y = x[:200_000] + np.repeat([0.0, 3.0, -2.0, 1.0], 50_000)
    began = time.perf_counter()
    assert sg.pelt_rbf(y, 5.0) == [50_000, 100_000, 150_000, 200_000] and time.perf_counter() - began < 30
