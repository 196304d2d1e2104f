"""Small cases whose results were worked out by hand or with numpy from the definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import features as fx
from chronoloom.operators import evaluation as ev
from chronoloom.operators import forecasts as fo
from chronoloom.operators import rows
from chronoloom.operators import scoring as sc
from chronoloom.operators import trajectories as tr
from chronoloom.sources import series_text as st
from chronoloom.sources import sinks

X = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 5.0, 8.0, 7.0, 9.0]


def series(spark, **named):
    data = [(k, i, float(v)) for k, xs in named.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(data, "series_id string, pos int, value double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600).cast("timestamp_ntz"))


def row(df):
    return df.first().asDict()


def close(got, **want):
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7), k


def test_features_of_the_ten_points(spark):
    s = series(spark, x=X).cache()
    close(row(fx.basic_statistics(s)), median=5, mad=2, acf1=0.45, acf_seasonal=0, peak_freq=0, spec_entropy=0.523961448, cusum_max=10, qkurt=2.157142857, mean_abs_corr=0, pca_var_ratio1=1)
    close(row(fx.slopes_and_runs(s)), slope_max=3, slope_second_diff_max=4, monotone_duration=0.1)
    close(row(fx.residual_diagnostics(s)), residual_mean=0, residual_max=2.384210526, residual_exceed_ratio=0, residual_acf1=-0.653630482, residual_concentration=0.187035508)
    close(row(fx.data_quality(s)), quality_quantization_score=0.2, quality_saturation_ratio=0.2, quality_constant_channel_ratio=0, quality_dropout_ratio=0)
    got = row(fx.event_summary(s))
    assert got["event_counts"] == [4, 4, 0, 0] and got["event_dominant_pattern"] == 0 and got["event_segment_count"] == 8
    assert row(fx.peaks_and_changes(s))["peak_count"] == 0
    trend = [r["trend"] for r in sc.decompose(s, "value").orderBy("pos").collect()]
    assert np.allclose(trend, [1.6, 2.4, 3.0, 4.0, 4.4, 5.6, 6.0, 7.0, 7.6, 8.4])


def test_extrema(spark):
    e = sc.find_extrema(series(spark, x=X, y=[1, 2, 1, 0, 1, 2, 3], z=[1, 2])).cache()
    of = lambda k, c: [r["pos"] for r in e.filter((F.col("series_id") == k) & F.col(c)).orderBy("pos").collect()]
    assert (of("x", "is_max"), of("x", "is_min")) == ([9], [0])
    assert (of("y", "is_max"), of("y", "is_min")) == ([1, 6], [0, 3])
    assert of("z", "is_max") == []


def test_greedy_matching(spark):
    p = spark.createDataFrame([("a", i) for i in (1, 3, 4)], "series_id string, pos int")
    t = spark.createDataFrame([("a", i) for i in (2, 3, 9)], "series_id string, pos int")
    assert row(sc.match_extrema(p, t))["hits"] == 2


def test_scores_of_an_answer(spark):
    text = lambda xs: "\n".join(f"{v}" for v in xs)
    answers = spark.createDataFrame([("a", f"<answer>{text([*X[:-1], 11.0])}</answer>"), ("b", text(X)), ("c", f"<answer>{text(X)}</answer>")], "series_id string, answer_text string")
    truths = spark.createDataFrame([(k, text(X)) for k in "abc"], "series_id string, truth_text string")
    got = {r["series_id"]: r.asDict() for r in sc.total_score(answers, truths).collect()}
    close(got["a"], mse_score=0.563624508, season_trend_score=0.193538043, extrema_score=0.2, length_score=0.1, total_score=1.057162551)
    assert got["b"]["total_score"] == -1
    close(got["c"], total_score=1.1)


def test_curve_of_the_mse_score(spark):
    df = spark.createDataFrame([(float(m),) for m in (0, 1, 10, 100, 1000)], "m double")
    got = [r[0] for r in df.select(F.round(sc.damped(F.col("m")), 2)).collect()]
    assert got == [1, 0.59, 0.29, 0.18, 0.13]


def test_group_relative_advantage(spark):
    s = spark.createDataFrame([("g", "t1", 0, 0.2), ("g", "t2", 0, 0.4), ("g", "t3", 0, 0.9), ("h", "t4", 0, 0.5)], "uid string, trajectory_id string, step_index int, reward_score double")
    got = {r["trajectory_id"]: r["advantage"] for r in tr.grpo_advantage(s).collect()}
    close(got, t1=-0.832047987, t2=-0.277349329, t3=1.109397316, t4=0.5 / (1 + 1e-6))


def steps(spark, rewards, values):
    rows_ = [("u", "t", i, r, v, [1], [1], [1]) for i, (r, v) in enumerate(zip(rewards, values, strict=True))]
    return spark.createDataFrame(rows_, "uid string, trajectory_id string, step_index int, reward_score double, value double, prompt_ids array<int>, response_ids array<int>, response_mask array<int>")


def test_generalised_advantage(spark):
    s = steps(spark, [0.05, 0.05, 0.8], [0.1, 0.2, 0.3])
    got = [r["advantage"] for r in tr.gae_advantage(s, 1.0, 0.9, whiten=False).orderBy("step_index").collect()]
    assert np.allclose(got, [0.69, 0.6, 0.5])
    got = [r["advantage"] for r in tr.gae_advantage(s, 1.0, 1.0, whiten=False).orderBy("step_index").collect()]
    assert np.allclose(got, [0.9 - 0.1, 0.85 - 0.2, 0.8 - 0.3])


def test_best_and_worst(spark):
    s = spark.createDataFrame([("d", "u", i, "acc", v, None) for i, v in enumerate((0.2, 0.4, 0.4, 0.9))], "data_source string, uid string, sample_no int, var string, num double, str string")
    got = {r["n"]: (r["best"], r["worst"]) for r in ev.exact_best_worst(s).collect()}
    assert got[2] == pytest.approx((0.60625, 0.34375)) and got[4] == pytest.approx((0.741015625, 0.265234375))
    boot = {r["metric"]: r["value"] for r in ev.bootstrap_best_worst(s).collect()}
    for n, (best, worst) in got.items():
        assert boot[f"best@{n}/mean"] == pytest.approx(best, abs=0.03) and boot[f"worst@{n}/mean"] == pytest.approx(worst, abs=0.03)


def test_bootstrap_equals_a_loop(spark):
    values, preds = [0.9, 0.8, 0.7], ["A", "B", "A"]
    data = [("d", "u", i, "acc", v, None) for i, v in enumerate(values)] + [("d", "u", i, "pred", None, p) for i, p in enumerate(preds)]
    s = spark.createDataFrame(data, "data_source string, uid string, sample_no int, var string, num double, str string")
    got = {r["metric"]: r["value"] for r in ev.bootstrap_majority(s).collect()} | {r["metric"]: r["value"] for r in ev.bootstrap_best_worst(s).collect()}
    for n in (2, 3):
        rng, majority, best = np.random.RandomState(42), [], []
        for _ in range(1000):
            picks = rng.randint(0, 3, size=n)
            drawn = [preds[i] for i in picks]
            top = max(dict.fromkeys(drawn), key=drawn.count)
            majority.append(values[picks[drawn.index(top)]])
            best.append(max(values[i] for i in picks))
        assert got[f"maj@{n}/mean"] == pytest.approx(np.mean(majority)) and got[f"maj@{n}/std"] == pytest.approx(np.std(majority))
        assert got[f"best@{n}/mean"] == pytest.approx(np.mean(best))


def test_patches_and_last_steps(spark):
    p = fo.make_patches(fo.value_arrays(series(spark, x=range(168))))
    assert p.count() == 21 and p.filter("patch_no = 20").first()["patch"][-8:] == [167.0] * 8
    s = spark.createDataFrame([(f"t{k}", i) for k, n in enumerate((3, 2, 3)) for i in range(n)], "trajectory_id string, step_index int")
    assert sorted((r[0], r[1]) for r in rows.last_step(s).collect()) == [("t0", 2), ("t1", 1), ("t2", 2)]


@pytest.mark.parametrize(("text", "want"), [("", []), ("1.5\n\n 2.5 ", [(0, None, 1.5), (1, None, 2.5)]), ("2017-05-01 00:00:00 11.588\n2017-05-01 01:00:00 10.918", [(0, "2017-05-01 00:00:00", 11.588), (1, "2017-05-01 01:00:00", 10.918)]), ("1_000\n1d\n1e5\n2017-05-01", [(0, None, 1e5)])])
def test_parse_lines(spark, text, want):
    df = st.parse_series_text(spark.createDataFrame([("s", text)], "series_id string, text string"))
    assert [(r["pos"], r["ts_str"], r["value"]) for r in df.orderBy("pos").collect()] == want


def test_answer_lines(spark):
    text = "<answer>\n2017-05-01 00:00:00 1.5\n| 2 | 2.5 |\nabout 3.5\nnothing\n2017-05-01\n</answer> 9"
    df = st.parse_answer_values(spark.createDataFrame([("s", text)], "series_id string, text string"))
    assert [r["value"] for r in df.orderBy("pos").collect()] == [1.5, 2.5, 3.5, -1.0]


def test_format_then_parse_is_the_identity(spark):
    s = series(spark, a=[1.25, -3.125, 0.0], b=[7.5])
    back = st.parse_series_text(sinks.format_forecast_text(s, "value"))
    assert sorted((r["series_id"], r["pos"], r["value"]) for r in back.collect()) == sorted((r["series_id"], r["pos"], r["value"]) for r in s.collect())


EDGES = {"one": [5], "two": [1, 2], "constant": [3] * 12, "zero": [0] * 30, "nan": [1, math.nan, 3, 4], "inf": [1, math.inf, 3, 4], "plateau": [0, 4, 4, 4, 0], "flat_then_up": [2, 2, 3, 4], "n24": list(range(24)), "n25": list(range(25))}


def test_edge_series_give_finite_features(spark):
    s = series(spark, **EDGES).cache()
    every = {r["series_id"]: r.asDict() for r in fx.feature_table(s).collect()}
    assert set(every) == set(EDGES) - {"one"}  # fewer than two points are left out
    for name, got in every.items():
        for k, v in got.items():
            for x in v if isinstance(v, list) else [v]:
                assert isinstance(x, str) or math.isfinite(x), (name, k)
    assert every["nan"]["median"] == 0 and every["inf"]["median"] == 3.5
    assert every["flat_then_up"]["monotone_duration"] == 0.5
    assert every["n24"]["acf_seasonal"] == 0 and every["n25"]["acf_seasonal"] != 0
    assert every["constant"]["quality_constant_channel_ratio"] == 1 and every["constant"]["quality_quantization_score"] == 1


def test_peaks_with_flat_tops(spark):
    z = np.array([0.0, 4, 4, 4, 0, 1, 0])
    peaks, proms = fx.peaks_of(z, 0.5)
    assert peaks.tolist() == [2, 5] and proms.tolist() == [4, 1]
    assert fx.half_widths(z, peaks, proms).tolist() == pytest.approx([3.0, 1.0])


def test_change_of_level_is_found():
    x = np.r_[np.zeros(40), np.full(40, 5.0)] + np.random.default_rng(0).normal(0, 0.1, 80)
    assert fx.pelt_rbf(x, 5.0) == [40, 80]


def test_equal_gaps_take_the_first(spark):
    lines = "\n".join(f"2024-01-01 {h:02d}:00:00 1" for h in (0, 2, 3, 5, 6))
    parsed = st.parsed_times(st.parse_series_text(spark.createDataFrame([("s", lines)], "series_id string, text string")))
    assert row(st.frequencies(parsed))["gap"] == 7200


def test_models_by_name(spark):
    s = series(spark, a=np.sin(np.arange(100) / 4), b=[1.0, 2.0])
    for model in fo.MODELS:
        got = fo.forecast_with_model(s, model, 6).collect()
        assert len(got) == 12 and all(math.isfinite(r["yhat"]) for r in got)
    with pytest.raises(ValueError, match="unknown model"):
        fo.forecast_with_model(s, "prophet", 6)
    short = fo.forecast_with_model(s, "mine", 5, {"mine": lambda x, h: x[:2]}).filter("series_id = 'b'").orderBy("step").collect()
    assert [r["yhat"] for r in short] == [1, 2, 2, 2, 2]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from chronoloom.plans.feature_queries import d22_d26_residual_diagnostics as q

    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = sorted(map(tuple, q(spark, sf_dir).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(tuple, q(spark, sf_dir).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bad_models_and_empty_batches_fail_loudly(spark):
    df = spark.createDataFrame([(" Arima",), ("x",)], "m string")
    assert [r[0] for r in df.select(rows.normalize_model_name(F.col("m"))).collect()] == ["arima", "chronos2"]
    with pytest.raises(Exception, match="unknown model"):
        df.select(rows.normalize_model_name(F.col("m"), None)).collect()
    with pytest.raises(ValueError, match="aborted"):
        rows.non_aborted(steps(spark, [1.0], [1.0]).withColumn("response_mask", F.array(F.lit(0))))


def test_advantages_of_a_group_sum_to_zero(spark):
    rng = np.random.default_rng(1)
    data = [("g", f"t{i}", 0, float(x)) for i, x in enumerate(rng.normal(size=20))]
    s = spark.createDataFrame(data, "uid string, trajectory_id string, step_index int, reward_score double")
    assert abs(sum(r["advantage"] for r in tr.grpo_advantage(s).collect())) < 1e-9


def test_higher_order_residuals(spark):
    x = np.sin(np.arange(40) / 3) + np.arange(40) % 5
    s = series(spark, a=x, b=[1.0], c=[1.0, 2.0])
    got = np.array([r["residual"] for r in fx.ar_residuals(s, 2).filter("series_id = 'a'").orderBy("pos").collect()])
    design = np.column_stack([np.ones(38), x[1:-1], x[:-2]])
    assert np.allclose(got, x[2:] - design @ np.linalg.lstsq(design, x[2:], rcond=None)[0])
    short = {r["series_id"]: r.asDict() for r in fx.residual_diagnostics(s, 2).filter("series_id <> 'a'").collect()}
    assert set(short) == {"b", "c"} and all(v == 0 for r in short.values() for k, v in r.items() if k != "series_id")


def brute_breaks(x, penalty=5.0, least=2, jump=5):
    """The cheapest of all segmentations on the grid, without pruning."""
    n = len(x)
    d = [[(a - b) ** 2 for b in x] for a in x]
    middle = np.median([d[i][j] for i in range(n) for j in range(i)])
    k = np.array([[math.exp(-min(max(d[i][j] / (middle or 1.0), 1e-2), 1e2)) if i != j else 1.0 for j in range(n)] for i in range(n)])
    best = {0: (0.0, [])}
    for e in [*range(jump, n, jump), n]:
        best[e] = min((best[a][0] + e - a - k[a:e, a:e].sum() / (e - a) + penalty, [*best[a][1], e]) for a in best if e - a >= least)
    return best[n][1]


def test_full_dynamics_report(spark, monkeypatch):
    """Lines that the query with SQL sets to 0 have their values."""
    from chronoloom.plans import feature_queries as fq

    rng = np.random.default_rng(4)
    named = {"steps": np.repeat([0.0, 9.0, 4.0], 20) + rng.normal(0, 0.3, 60), "waves": np.sin(np.arange(48) / 2), "flat": np.ones(12)}
    monkeypatch.setattr(fq, "series_user", lambda spark, sf_dir: series(spark, **named))
    got = {r["series_id"]: dict(line.strip().split(": ") for line in r["report"].split("\n")[1:]) for r in fq.d20_dynamics_report_all(spark, "").collect()}
    for name, x in named.items():
        breaks = brute_breaks(x.tolist())
        means = [x[a:b].mean() for a, b in zip([0, *breaks], breaks, strict=False)]
        z, widths = (x - x.mean()) / (x.std() + 1e-8), [0.0]
        for p in (p for p in range(1, len(z) - 1) if z[p - 1] < z[p] > z[p + 1]):
            lo = max((i for i in range(p) if z[i] > z[p]), default=0)
            hi = min((i for i in range(p, len(z)) if z[i] > z[p]), default=len(z) - 1)
            prominence = z[p] - max(z[lo : p + 1].min(), z[p : hi + 1].min())
            if prominence >= 1:
                level = z[p] - prominence / 2
                a = max((i for i in range(p) if z[i] <= level), default=0)
                b = min((i for i in range(p, len(z)) if z[i] <= level), default=len(z) - 1)
                widths.append((b - (level - z[b]) / (z[b - 1] - z[b])) - (a + (level - z[a]) / (z[a + 1] - z[a])))
        assert float(got[name]["Changepoint Count"]) == min(len(breaks) - 1, 5)
        assert float(got[name]["Changepoint Score"]) == pytest.approx(max(np.abs(np.diff(means)), default=0), abs=1e-4)
        assert float(got[name]["Peak Max Width"]) == pytest.approx(max(widths), abs=1e-4)
    assert float(got["steps"]["Changepoint Count"]) == 2 and float(got["waves"]["Peak Max Width"]) > 1


def test_change_points_of_long_series_need_little_memory(spark, monkeypatch):
    """All pairs of 8,000 points would take 512 MB a matrix."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = np.repeat([0.0, 8.0, 3.0, 9.0], 2000) + rng.normal(0, 0.5, 8000)
    tracemalloc.start()
    breaks = fx.pelt_rbf(x, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert breaks == [2000, 4000, 6000, 8000] and peak < 32 << 20
    for n in (0, 1, 2, 4, 9, 12, 33, 61, 130):
        y = np.round(np.repeat(rng.normal(0, 2, n // 10 + 1), 10)[:n] + rng.normal(0, 0.4, n), 1)
        assert n < 2 or fx.pelt_rbf(y, 1.0) == brute_breaks(y.tolist(), 1.0)
    for n in (513, 514, 515, 516):
        for y in (rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float)):
            assert fx.median_squared_distance(y) == np.median(((y[:, None] - y[None, :]) ** 2)[np.triu_indices(n, 1)])
    monkeypatch.setattr(fx, "pelt_rbf", None)
    assert "changepoint_count" not in fx.peaks_and_changes(series(spark, x=X), changes=False).columns


def test_report_texts(spark):
    """Every line of the five reports, with titles, indents and decimals."""
    values = {
        "median": 1.0, "mad": 0.5, "acf1": -0.25, "acf_seasonal": 0.03125, "peak_freq": 0.0, "spec_entropy": 2.34567, "cusum_max": 12.0, "qkurt": -0.00001,
        "changepoint_count": 2.0, "changepoint_score": 3.14159, "slope_max": 1.5, "slope_second_diff_max": 0.09375, "monotone_duration": 0.4, "peak_count": 3.0, "peak_max_width": 7.25, "peak_spacing_cv": 0.1,
        "residual_mean": -1e-17, "residual_max": 2.0, "residual_exceed_ratio": 0.05, "residual_acf1": 0.3, "residual_concentration": 0.25,
        "quality_quantization_score": 0.2, "quality_saturation_ratio": 0.1, "quality_constant_channel_ratio": 0.0, "quality_dropout_ratio": 1.0,
        "event_segment_count": 5.0, "event_dominant_pattern": 3.0,
    }
    df = spark.createDataFrame([("s", *values.values(), [1.0, 0.0, 1.0, 3.0])], "series_id string, " + ", ".join(f"{c} double" for c in values) + ", event_counts array<double>")
    assert fx.report(df, "basic").first()["report"] == """Basic Statistics:
  Median: 1.0000
  MAD: 0.5000
  ACF(1): -0.2500
  ACF(seasonal): 0.0312
  Peak Frequency: 0.0000
  Spectral Entropy: 2.3457
  CUSUM Max: 12.0000
  Quantile Kurtosis: 0.0000"""
    assert fx.report(df, "dynamics").first()["report"] == """Within-Channel Dynamics:
  Changepoint Count: 2.0
  Changepoint Score: 3.1416
  Max Slope: 1.5000
  Max Second Diff: 0.0938
  Monotone Duration: 0.4000
  Peak Count: 3.0
  Peak Max Width: 7.2500
  Peak Spacing CV: 0.1000"""
    assert fx.report(df, "residuals").first()["report"] == """Forecast Residuals:
  Residual Mean: 0.0000
  Residual Max: 2.0000
  Exceed Ratio: 0.0500
  ACF(1): 0.3000
  Concentration: 0.2500"""
    assert fx.report(df, "quality").first()["report"] == """Data Quality:
  Quantization Score: 0.2000
  Saturation Ratio: 0.1000
  Constant Channel Ratio: 0.0000
  Dropout Ratio: 1.0000"""
    assert fx.report(df, "events").first()["report"] == """Event Summary:
  Segment Count: 5.0
  Rise Events: 1.0
  Fall Events: 0.0
  Flat Events: 1.0
  Oscillation Events: 3.0
  Dominant Pattern: oscillation"""


def test_prompts(spark):
    lines = "\n".join(f"2024-01-01 {h:02d}:00:00 {h}.5" for h in range(12))
    state = spark.createDataFrame(
        [("a", 12, 3, lines, [], None), ("b", 12, 3, lines, ["one", "two"], None), ("c", 12, 3, lines, ["one"], "9.000"), ("d", 12, 3, "1.0", ["one"], "9.000"), ("e", 12, 3, "1.0", [], "9.000"), ("f", 12, 3, "1.0", ["one"], "")],
        "series_id string, lookback int, horizon int, history string, analysis array<string>, prediction string",
    )
    got = dict(map(tuple, rows.render_prompt(state).collect()))
    head = "### Lookback Window: 12 rows\n### Forecast Horizon: 3 rows\n### Historical Data"
    first = f"**[Turn 1] Action: Call feature extraction tools (e.g., extract_basic_statistics). Do NOT call predict_time_series yet.**\n{head}"
    assert got["a"] == f"""{first}
{lines}

### Analysis History
No previous analysis performed.

### Model Predictions
No predictions available yet. Call predict_time_series to generate forecasts.

**Check your current state and act accordingly:**
- If "Analysis History" is empty → Call feature extraction tools. Do NOT call predict_time_series yet.
- If "Analysis History" has features but "Model Predictions" is empty → Call predict_time_series with model_name.
"""
    assert got["b"].startswith(f"**[Turn 2] Action: Call predict_time_series with your chosen model (e.g., 'chronos2').**\n{head}\n") and "\n### Analysis History\none\ntwo\n\n###" in got["b"]
    cut = lines.split("\n")
    assert got["c"] == f"""**[Turn 3] Action: Output your final answer in <think>...</think><answer>...</answer> format using the model predictions. Do NOT output any text outside these tags.**
{head} (truncated)
{chr(10).join(cut[:5])}
... (2 rows omitted) ...
{chr(10).join(cut[-5:])}

### Analysis History
one

### Model Predictions
Model Predictions (3 steps):
9.000

**Instructions**:
1. Reflect on whether the model predictions are reasonable given the historical patterns.
2. Based on this reflection, refine the predictions.
3. Output the final refined prediction.
4. Output ONLY <think>...</think> and <answer>...</answer>. Do not include anything else.

<think>
[Reflection on the consistency between historical patterns and model predictions]
</think>

<answer>
[Final prediction after reflection and refinement]
</answer>"""
    assert "(truncated)\n1.0\n\n###" in got["d"] and got["e"].startswith(first + " (truncated)")
    assert got["f"].startswith("**[Turn 3]") and "No predictions available yet." in got["f"]


def test_unit_root_test_by_normal_equations():
    """The lags of least AIC and the p-value, worked out with plain loops."""
    rng = np.random.default_rng(8)
    for kind in range(24):
        n = int(rng.integers(12, 120))
        e = rng.normal(size=n)
        x = np.cumsum(e) if kind % 3 == 0 else e if kind % 3 == 1 else np.array([*itertools.accumulate(e, lambda a, b: 0.9 * a + b)])
        most, d = min(10, n // 3), np.diff(x)

        def fitted(lags, start, x=x, d=d):
            rows_ = [[1.0, x[t], *(d[t - k] for k in range(1, lags + 1))] for t in range(start, len(d))]
            a, y = np.array(rows_), d[start:]
            inverse = np.linalg.inv(a.T @ a)
            beta = inverse @ a.T @ y
            rss = ((y - a @ beta) ** 2).sum()
            return len(y) * math.log(rss / len(y)) + 2 * len(beta), beta[1] / math.sqrt(inverse[1, 1] * rss / (len(y) - len(beta)))

        if most > n // 2 - 2:
            assert fo.stationarity(x) == 1
            continue
        lags = min(range(most + 1), key=lambda k: fitted(k, most)[0])
        t = fitted(lags, lags)[1]
        assert fo.stationarity(x) == int(t > -2.8616)
    assert [fo.stationarity(np.array(v, float)) for v in ([1.0] * 50, [1.0, 2.0, 3.0], [1.0, float("nan")] * 20)] == [1, 1, 1]


def test_arima_on_simulated_series(spark):
    rng = np.random.default_rng(5)
    n = 3000
    e = rng.normal(size=n)
    ar = np.array([*itertools.accumulate(e, lambda a, b: 0.7 * a + b)]) + 10
    ma = e + 0.6 * np.concatenate([[0], e[:-1]]) - 4
    walk = np.cumsum(e)
    (order, forecast), h = fo.arima_fit(ar), np.arange(1, 31)
    assert order[1] == 0 and np.allclose(forecast(30), 10 + (ar[-1] - 10) * 0.7**h, atol=0.5)
    assert abs(forecast(200)[-1] - 10) < 0.3  # back to the mean
    (order, forecast) = fo.arima_fit(ma)
    assert order[1] == 0 and np.allclose(forecast(30)[6:], -4, atol=0.3)
    (order, forecast) = fo.arima_fit(walk)
    assert order[1] == 1 and np.ptp(forecast(500)[20:]) < 0.2 and abs(forecast(500)[-1] - walk[-1]) < 3  # no drift
    assert fo.CANDIDATES == ((1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (0, 1), (1, 0), (5, 0), (0, 5))
    few = {fo.arima_fit(rng.normal(size=11).cumsum())[0] for _ in range(20)}  # too few points for the candidates
    assert (1, 1, 1) in few <= {(1, 1, 1), None}
    assert fo.arima_fit(np.array([1.0, 2.0]))[0] is None and fo.arima_values(np.array([1.0, 2.0]), 3).tolist() == [2, 2, 2]
    got = fo.forecast_arima(series(spark, a=ar[:200], b=np.array([3.0]), c=np.array([1.0, float("nan"), 2.0])), 4).orderBy("series_id", "step").collect()
    assert [(r["series_id"], r["step"]) for r in got] == [(s, k) for s in "abc" for k in range(4)]
    assert {r["order"] for r in got if r["series_id"] != "a"} == {"naive"} and [r["yhat"] for r in got if r["series_id"] == "b"] == [3.0] * 4
    want = fo.arima_values(ar[:200], 4)
    assert np.allclose([r["yhat"] for r in got if r["series_id"] == "a"], want) and all(r["ts"].hour == (200 + k) % 24 for k, r in enumerate(got[:4]))


def test_rows_without_ids_stay_and_steps_may_repeat(spark):
    rows_ = [("u", "a", 0, 1.0), ("u", "b", 0, 3.0), (None, "c", 0, 5.0), (None, "d", 0, 7.0)]
    s = spark.createDataFrame(rows_, "uid string, trajectory_id string, step_index int, reward_score double")
    got = {r["trajectory_id"]: r["advantage"] for r in tr.grpo_advantage(s, norm_by_std=False).collect()}
    assert got == {"a": -1, "b": 1, "c": -1, "d": 1}
    # step 2 is missing, step 3 is there twice, one trajectory has no id
    rows_ = [("a", 0, 1.0, 0.5), ("a", 1, 0.0, 0.4), ("a", 3, 2.0, 0.3), ("a", 3, 1.0, 9.0), (None, 0, 1.0, 0.25)]
    s = spark.createDataFrame(rows_, "trajectory_id string, step_index int, reward_score double, value double").withColumn("response_mask", F.array(F.lit(1)))
    got = sorted((str(r["trajectory_id"]), r["step_index"], round(r["advantage"], 9)) for r in tr.gae_advantage(s, 0.9, 0.8, whiten=False).collect())
    three = 2.0 - 0.3
    two = 0.0 + 0.9 * 0.3 - 0 + 0.72 * three
    one = 0.0 + 0.9 * 0 - 0.4 + 0.72 * two
    zero = 1.0 + 0.9 * 0.4 - 0.5 + 0.72 * one
    assert got == [("None", 0, 0.75), ("a", 0, round(zero, 9)), ("a", 1, round(one, 9)), ("a", 3, round(three, 9)), ("a", 3, round(three, 9))]
    white = [r["advantage"] for r in tr.gae_advantage(s, 0.9, 0.8).collect()]
    assert abs(sum(white)) < 1e-9 and np.var(white, ddof=1) == pytest.approx(1)


def test_a_nan_is_felt_in_its_windows_alone(spark):
    x = np.sin(np.arange(60.0))
    x[20] = np.nan
    got = {r["pos"]: r["trend"] for r in sc.decompose(series(spark, s=x), "value").collect()}
    assert {k for k, v in got.items() if math.isnan(v)} == set(range(8, 33))
    padded = np.concatenate([np.repeat(x[0], 12), x, np.repeat(x[-1], 12)])
    assert all(got[i] == pytest.approx(padded[i : i + 25].mean()) for i in got if not 8 <= i <= 32)


def test_samples_that_are_missing(spark):
    """The exact expectations over resamples that hold a number, by all 4 ** n resamples; and reducers of one's own."""
    values = [1.0, float("nan"), 2.0, 4.0]
    s = spark.createDataFrame([("d", "u", "v", i, v, None) for i, v in enumerate(values)] + [("d", "u", "pred", i, None, p) for i, p in enumerate("aabb")], "data_source string, uid string, var string, sample_no int, num double, str string")
    got = {r["n"]: (r["best"], r["worst"]) for r in ev.exact_best_worst(s).collect()}
    for n in (2, 4):
        draws = [[v for v in d if not math.isnan(v)] for d in itertools.product(values, repeat=n)]
        draws = [d for d in draws if d]
        assert got[n] == pytest.approx((np.mean([max(d) for d in draws]), np.mean([min(d) for d in draws])))
    rng, boots = np.random.RandomState(42), []
    for _ in range(50):
        boots.append(np.array(values)[rng.choice(4, 2)])
    boot = {r["metric"]: r["value"] for r in ev.bootstrap(s, {"sum": lambda x: x.sum(1), "best": ev.REDUCERS["best"]}, 50).collect()}
    sums, best = [b.sum() for b in boots], [np.fmax(*b) for b in boots]
    assert boot["sum@2/mean"] == pytest.approx(np.nanmean(sums)) and boot["sum@2/std"] == pytest.approx(np.nanstd(sums))
    assert boot["best@2/mean"] == pytest.approx(np.nanmean(best)) and set(boot) == {f"{k}@{n}/{m}" for k in ("sum", "best") for n in (2, 4) for m in ("mean", "std")}


def test_clip_ratios_and_aborted_rows(spark):
    mask = lambda n: [1] * n
    s = spark.createDataFrame([("a", mask(4), [1, 2]), ("b", mask(2), [1]), ("c", [], [1, 2, 3])], "trajectory_id string, response_mask array<int>, prompt_ids array<int>")
    got = {r["metric"]: r["value"] for r in ev.data_metrics(s, 4, 2).collect()}
    assert (got["response_length/clip_ratio"], got["response_length_non_aborted/clip_ratio"], got["prompt_length/clip_ratio"]) == (pytest.approx(1 / 3), 0.5, pytest.approx(1 / 3))
    assert ev.data_metrics(s, 5, 9).filter("metric like '%clip_ratio' and value <> 0").count() == 0
    with pytest.raises(Exception, match="all rows were aborted"):
        ev.data_metrics(s.filter("trajectory_id = 'c'"), 4, 2).collect()


def test_log_probs_are_cut_and_padded(spark):
    s = spark.createDataFrame([([1], [7, 8, 9], [1, 1, 1], [-0.5, -0.25, -1.0]), ([1], [7], [1], None)], "prompt_ids array<int>, response_ids array<int>, response_mask array<int>, response_logprobs array<double>")
    assert [r["response_logprobs"] for r in tr.pad_tokens(s, 2, 2).collect()] == [[-0.5, -0.25], [0.0, 0.0]]
    assert [len(r["response_logprobs"] or []) for r in tr.pad_tokens(rows.truncate_responses(s, 1), 2, 4).collect()] == [4, 4]
    assert rows.truncate_responses(s, 1).first()["response_logprobs"] == [-0.5]


def test_dense_ids_over_many_ranges(spark):
    ids = [f"t{(i * 7919) % 1000:04d}" for i in range(1000)]
    s = spark.createDataFrame([(i,) for i in ids + ids[:50]], "trajectory_id string").repartition(7)
    numbered = tr.distinct_trajectories(s)
    assert sorted(map(tuple, numbered.collect())) == [(t, i) for i, t in enumerate(sorted(set(ids)))] == sorted(map(tuple, numbered.collect()))


def test_scratch_folders(spark, tmp_path):
    from chronoloom.sources import storage

    class Cluster:
        """A session on a cluster without a shared folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: "")

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")
