"""Advantages over long trajectories, run numbers without shards, and decimals beside Python's."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.decimals import fixed_text
from chronoloom.operators import trajectories as tr

STEPS = "trajectory_id string, step_index int, reward_score double, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, STEPS).withColumn("response_mask", F.array(F.lit(1)))


def brute_gae(rows, gamma, lam):
    """A step at a time, missing numbers in between."""
    out = {}
    for one in {r[0] for r in rows}:
        known = {}
        for _, t, score, value in (r for r in rows if r[0] == one and r[1] is not None):
            known[t] = max(known.get(t, (-math.inf, 0)), (score, value))
        a = ahead = 0.0
        for t in range(max(known, default=-1), min(known, default=0) - 1, -1):
            score, value = known.get(t, (0.0, 0.0))
            a = score + gamma * ahead - value + gamma * lam * a
            ahead, out[one, t] = value, a
    return out


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_slices_of_trajectories_compose(spark, monkeypatch, size):
    monkeypatch.setattr(tr, "SLICE_STEPS", size)
    rng = random.Random(size)
    rows = [(i, t, rng.random(), rng.random()) for i in ("a", "b", None) for t in range(-2, 40) if rng.random() < 0.6 for _ in range(rng.choice([1, 1, 2]))]
    want = brute_gae(rows, 0.9, 0.8)
    got = {(r["trajectory_id"], r["step_index"]): r["advantage"] for r in tr.gae_advantage(frame(spark, rows), 0.9, 0.8, whiten=False).collect()}
    assert set(got) == {(i, t) for i, t, *_ in rows} and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_whitening_does_not_cancel(spark):
    rows = [(str(i), 0, 1e9 + (0.01 if i % 2 else 0.0), 0.0) for i in range(100)]
    got = {r["trajectory_id"]: r["advantage"] for r in tr.gae_advantage(frame(spark, rows)).collect()}
    x = np.array([r[2] for r in rows])
    want = (x - x.mean()) / math.sqrt(x.var(ddof=1) + 1e-8)
    assert max(abs(want)) > 0.9 and all(got[str(i)] == pytest.approx(want[i], abs=1e-2) for i in range(100))


def test_rows_without_step_stand_alone(spark):
    rows = [("a", 0, 1.0, 0.5), ("a", None, 3.0, 1.0), ("a", 1, 2.0, 0.25)]
    got = {r["step_index"]: (r["advantage"], r["returns"]) for r in tr.gae_advantage(frame(spark, rows), whiten=False).collect()}
    assert got == {None: (2.0, 3.0), 0: (1 + 0.25 - 0.5 + 1.75, 3.0), 1: (1.75, 2.0)}


def test_a_long_trajectory(spark):
    """A hundred thousand steps of one trajectory: arrays of a slice, and a row a slice."""
    steps = spark.range(100_000).select(F.lit("a").alias("trajectory_id"), F.col("id").cast("int").alias("step_index"), (F.col("id") % 7 / 7).alias("reward_score"), (F.col("id") % 5 / 5).alias("value"), F.array(F.lit(1)).alias("response_mask"))
    got = np.array([r["advantage"] for r in tr.gae_advantage(steps, 0.99, 0.95, whiten=False).orderBy("step_index").select("advantage").collect()])
    a, want = 0.0, np.zeros(100_000)
    for t in range(99_999, -1, -1):
        a = t % 7 / 7 + (0.99 * ((t + 1) % 5 / 5) if t < 99_999 else 0.0) - t % 5 / 5 + 0.99 * 0.95 * a
        want[t] = a
    assert np.abs(got - want).max() < 1e-9


def test_run_numbers_by_one_order(spark):
    rng = np.random.default_rng(3)
    index = np.repeat(rng.integers(0, 3, 400), rng.integers(1, 9, 400)).tolist()
    df = spark.createDataFrame(list(enumerate(index)), "row_no bigint, index bigint").repartition(6)
    got = {r["row_no"]: r["rollout_n"] for r in tr.rollout_index(df, shard_col=None).collect()}
    n, want = 0, {}
    for i, v in enumerate(index):
        n = n + 1 if i and index[i - 1] == v else 0
        want[i] = n
    assert got == want


def test_decimals_are_those_of_python(spark):
    rng = random.Random(1)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-8, 12) for _ in range(40_000)] + [k / n for n in range(1, 250) for k in range(n)]
    values += [k / 2**j for j in range(1, 12) for k in range(-40, 40)] + [0.01875, 0.99995, 0.999949999, 9.99995, -0.00001, -0.0, 0.0, 1e15, 2.0**53 + 2, 1e17, 123456789012345678.0, 2.0**62, 2.0**63, 3e22, 1e30, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    for digits in (1, 3, 4):
        wrong = [(r["v"], r["s"]) for r in df.select("v", fixed_text(F.col("v"), digits).alias("s")).collect() if r["s"] != f"{r['v']:.{digits}f}"]
        assert not wrong, wrong[:5]
    plain = [r["s"] for r in spark.createDataFrame([(-0.00001,), (-0.0,), (-1.5,), (None,)], "v double").select(fixed_text(F.col("v"), 4, signed_zero=False).alias("s")).collect()]
    assert plain == ["0.0000", "0.0000", "-1.5000", None]


def test_best_and_worst_of_large_groups_by_ranks(spark):
    """Two hundred thousand samples of one group, some without a number, beside the closed form."""
    from chronoloom.operators import evaluation as ev

    x = spark.range(200_000).select(F.lit("d").alias("data_source"), F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("uid"), F.lit("reward").alias("var"), F.col("id").alias("sample_no"))
    x = x.withColumn("num", F.when(F.col("sample_no") % 11 == 3, float("nan")).otherwise(F.pmod(F.xxhash64("sample_no"), F.lit(1000)) / 7)).withColumn("str", F.lit(None).cast("string"))
    got = {(r["uid"], r["metric"]): r["value"] for r in ev.bootstrap_by_ranks(x).collect()}
    seen = 0
    for r in ev.exact_best_worst(x).collect():
        for side in ("best", "worst"):
            mean, std = got[r["uid"], f"{side}@{r['n']}/mean"], got[r["uid"], f"{side}@{r['n']}/std"]
            assert abs(mean - r[side]) <= 5 * std / 1000**0.5 + 1e-2, (r, side)
            seen += 1
    assert seen == len(got) / 2 > 40
