"""Steps and trajectories of agents: rewards, advantages, audits, padding, timing.

Steps: (uid, data_source, trajectory_id, step_index, prompt_ids, response_ids, response_mask,
reward_score, value, ...). Group statistics are two-level aggregates joined back, so a group
or trajectory of any size is pre-aggregated before it is shuffled; recursions over the steps of a
trajectory go slice by slice.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ranges import numbered_runs
from chronoloom.operators.rows import response_length
from chronoloom.sources.storage import stash

#: Tools that agents may call (fixed values).
FEATURE_TOOLS = ("extract_basic_statistics", "extract_within_channel_dynamics", "extract_forecast_residuals", "extract_data_quality", "extract_event_summary")
PREDICT_TOOL = "predict_time_series"
#: What an audit of an answer says (fixed values).
NO_FEATURES = "No feature extraction tools were called. You must analyze the data first."
NO_PREDICTION = "predict_time_series was not called. You must get model predictions first."
COPIED = "Answer appears to copy input data. Predictions must be for FUTURE timestamps."
COMPLETE = "Workflow completed correctly"


def rollout_index(df: DataFrame, index_col: str = "index", order_col: str = "row_no", shard_col: str | None = "shard") -> DataFrame:
    """Adds rollout_n: the place within a run of equal neighbouring ``index_col`` values, by an explicit order.

    Rows may come in shards, as from several readers; then runs end at their borders. Without shards
    (``shard_col`` None) the order is one over all rows, dealt by ranges, and runs go on across them.
    """
    if shard_col is None:
        return numbered_runs(df, index_col, order_col, "rollout_n")
    w = Window.partitionBy(shard_col).orderBy(order_col)
    x = df.withColumn("__new", F.coalesce((F.lag(index_col).over(w) != F.col(index_col)).cast("int"), F.lit(1)))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("rollout_n", F.row_number().over(Window.partitionBy(shard_col, "__run").orderBy(order_col)) - 1).drop("__new", "__run")


def repeat_prompts(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rollout_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("rollout_n", F.lit(0)).limit(0)


def repeat_by_steps(df: DataFrame, steps_col: str = "num_steps") -> DataFrame:
    return df.filter(F.col(steps_col) > 0).withColumn("step_index", F.explode(F.sequence(F.lit(0), F.col(steps_col) - 1)))


def attach_rollouts(prompts: DataFrame, rollouts: DataFrame, keys: tuple[str, ...] = ("uid", "rollout_n")) -> DataFrame:
    """Prompt and rollout columns of equal keys side by side; a clashing column is the rollout's."""
    clash = [c for c in prompts.columns if c in rollouts.columns and c not in keys]
    return prompts.drop(*clash).join(rollouts, list(keys))


def concat_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def distinct_trajectories(steps: DataFrame) -> DataFrame:
    """(trajectory_id, dense_id): numbers from 0 in order of the ids.

    The ids are dealt by range and written with their places once, so that counts and places are
    of the same ranges; counts per range come first, so no task numbers all trajectories.
    """
    ids = steps.select("trajectory_id").distinct().repartitionByRange("trajectory_id").sortWithinPartitions("trajectory_id")
    ids = stash(ids.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "trajectories")
    sizes = ids.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("__low"))
    # a row per range: as many as shuffle partitions, which also bounds what is broadcast
    starts = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ids.join(F.broadcast(starts), "__p").select("trajectory_id", (F.col("__before") + F.col("__i") - F.col("__low")).cast("int").alias("dense_id"))


def token_rewards(steps: DataFrame) -> DataFrame:
    """Adds token_rewards: reward_score at the last response token, zeros elsewhere; null without a score."""
    last = F.aggregate("response_mask", F.lit(0), lambda a, m: a + m) - 1
    spread = F.transform("response_ids", lambda _, i: F.when(i == last, F.col("reward_score")).otherwise(0.0))
    return steps.withColumn("token_rewards", F.when(F.col("reward_score").isNotNull(), spread))


def step_score(steps: DataFrame) -> Column:
    if "token_rewards" in steps.columns:
        return F.aggregate(F.coalesce("token_rewards", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce("reward_score", F.lit(0.0))


def grpo_advantage(steps: DataFrame, norm_by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Adds score and advantage: scores against their group's mean (and deviation), where each
    trajectory counts once, with its first step. A group of one has mean 0 and deviation 1.
    Rows without uid are a group of their own."""
    x = steps.withColumn("score", step_score(steps))
    firsts = x.groupBy("uid", "trajectory_id").agg(F.min_by("score", "step_index").alias("s"))
    group = firsts.groupBy("uid").agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.stddev_samp("s").alias("d"))
    group = group.select(F.col("uid").alias("__uid"), F.when(F.col("n") > 1, F.col("m")).otherwise(0.0).alias("__mean"), F.when(F.col("n") > 1, F.col("d")).otherwise(1.0).alias("__std"))
    centred = F.col("score") - F.col("__mean")
    joined = x.join(group, F.col("uid").eqNullSafe(F.col("__uid")))
    return joined.withColumn("advantage", centred / (F.col("__std") + eps) if norm_by_std else centred).drop("__uid", "__mean", "__std")


def broadcast_over_tokens(steps: DataFrame, column: str = "advantage") -> DataFrame:
    """Adds token_<column>: the step's value at response tokens, 0 elsewhere."""
    return steps.withColumn(f"token_{column}", F.transform("response_mask", lambda m: m * F.col(column)))


#: Step numbers of a slice of a trajectory.
SLICE_STEPS = 4096


def _ahead(gamma: float, decay: float, gap: int, value: float, advantage: float) -> float:
    """What a step takes from the next one there is; missing numbers between count as zero reward and value."""
    ahead = gamma * value + decay * advantage
    return ahead * decay ** (gap - 1) if gap > 1 else ahead


def _slice_maps(gamma: float, decay: float):
    """Of the steps of a slice (arrays t, r, v): the advantage of each if nothing came after the slice, and by what
    share it takes what comes after. Together they are an affine map of that, and maps of neighbours compose."""

    @F.pandas_udf("own array<double>, share array<double>")
    def run(t: pd.Series, r: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = []
        for ts, rs, vs in zip(t, r, v, strict=True):
            ts, rs, vs = list(ts), list(rs), list(vs)
            own, share = [0.0] * len(ts), [1.0] * len(ts)
            for i in range(len(ts) - 1, -1, -1):
                own[i] = rs[i] - vs[i]
                if i + 1 < len(ts):
                    gap = int(ts[i + 1] - ts[i])
                    own[i] += _ahead(gamma, decay, gap, vs[i + 1], own[i + 1])
                    share[i] = _ahead(0.0, decay, gap, 0.0, share[i + 1])
            out.append((own, share))
        return pd.DataFrame(out, columns=["own", "share"])

    return run


def _slice_inputs(gamma: float, decay: float):
    """Of the slices of a trajectory in order: what comes into each from those after it."""

    @F.pandas_udf("array<double>")
    def run(first: pd.Series, last: pd.Series, value: pd.Series, own: pd.Series, share: pd.Series) -> pd.Series:
        out = []
        for low, high, v, a, p in zip(first, last, value, own, share, strict=True):
            x = [0.0] * len(low)
            for j in range(len(x) - 2, -1, -1):
                x[j] = _ahead(gamma, decay, int(low[j + 1] - high[j]), float(v[j + 1]), float(a[j + 1] + p[j + 1] * x[j + 1]))
            out.append(x)
        return pd.Series(out)

    return run


def gae_advantage(steps: DataFrame, gamma: float = 1.0, lam: float = 1.0, whiten: bool = True) -> DataFrame:
    """Adds advantage and returns by generalised estimation over the steps of each trajectory.

    Missing step numbers count as zero reward and value; the recursion goes over the steps there
    are and takes gaps at once. Of repeated rows of a step the largest (score, value) holds, and
    all get its advantage; rows without trajectory_id are a trajectory of their own, rows without
    step_index a step that stands alone. Whitening uses mean and variance over response tokens
    (Bessel-corrected, 1e-8 within the root); with fewer than two tokens in all there is none.

    A trajectory is cut into slices of ``SLICE_STEPS`` step numbers. Each is an affine map of what comes after
    it, so a scan over a row a slice gives every slice its input.
    """
    decay, keys = float(gamma * lam), ("trajectory_id", "__slice")
    x = steps.withColumn("__score", step_score(steps)).withColumn("__v", F.coalesce("value", F.lit(0.0)))
    step = F.col("step_index").cast("bigint")
    each = x.groupBy("trajectory_id", step.alias("t")).agg(F.max(F.struct(F.col("__score").alias("r"), F.col("__v").alias("v"))).alias("x"), F.sum(response_length()).alias("tokens"))
    parts = each.groupBy("trajectory_id", F.floor(F.col("t") / SLICE_STEPS).alias("__slice")).agg(F.sort_array(F.collect_list(F.struct("t", "x.r", "x.v", "tokens"))).alias("s"))
    parts = stash(parts.select(*keys, "s", _slice_maps(float(gamma), decay)("s.t", "s.r", "s.v").alias("m")), "slices")
    facts = F.struct("__slice", F.get("s.t", F.lit(0)).alias("low"), F.get("s.t", F.size("s") - 1).alias("high"), F.get("s.v", F.lit(0)).alias("v"), F.get("m.own", F.lit(0)).alias("own"), F.get("m.share", F.lit(0)).alias("share"))
    whole = parts.filter("__slice is not null").groupBy("trajectory_id").agg(F.sort_array(F.collect_list(facts)).alias("f"))
    whole = whole.filter(F.size("f") > 1).select("trajectory_id", F.arrays_zip(F.col("f.__slice").alias("__slice"), _slice_inputs(float(gamma), decay)("f.low", "f.high", "f.v", "f.own", "f.share").alias("x")).alias("i"))
    inputs = whole.select("trajectory_id", F.explode("i").alias("i")).select("trajectory_id", "i.__slice", F.col("i.x").alias("__input"))
    same = lambda a, b: a.eqNullSafe(b)
    inputs = inputs.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    joined = parts.join(inputs, same(F.col("trajectory_id"), F.col("__of_trajectory_id")) & (F.col("__slice") == F.col("__of___slice")), "left")
    rows = joined.select("trajectory_id", F.coalesce("__input", F.lit(0.0)).alias("__input"), F.explode(F.arrays_zip(F.col("s.t").alias("t"), F.col("s.tokens").alias("n"), F.col("m.own").alias("own"), F.col("m.share").alias("share"))).alias("s"))
    rows = stash(rows.select(F.col("trajectory_id").alias("__id"), F.col("s.t").alias("__t"), F.col("s.n").alias("__n"), (F.col("s.own") + F.col("s.share") * F.col("__input")).alias("advantage")), "advantages")
    out = x.join(rows, same(F.col("trajectory_id"), F.col("__id")) & same(step, F.col("__t"))).withColumn("returns", F.col("advantage") + F.col("__v"))
    if whiten:
        n, a = F.col("__n"), F.col("advantage")
        total, first = rows.agg(F.sum(n), F.sum(n * a)).first()
        if total and total > 1:
            mean = first / total  # squares about it: sums of plain squares would cancel
            var = rows.agg(F.sum(n * (a - mean) * (a - mean))).first()[0] / (total - 1)
            out = out.withColumn("advantage", (a - mean) / math.sqrt(var + 1e-8))
    return out.drop("__score", "__v", "__id", "__t", "__n")


def compute_advantage(steps: DataFrame, estimator: str = "grpo", **options) -> DataFrame:
    """One of the estimators over valid rows; padding rows get 0."""
    kinds = {"grpo": grpo_advantage, "gae": gae_advantage}
    if estimator not in kinds:
        raise ValueError(f"unsupported estimator {estimator!r}")
    if "is_pad" not in steps.columns:
        return kinds[estimator](steps, **options)
    pad = F.coalesce("is_pad", F.lit(False))
    done = kinds[estimator](steps.filter(~pad), **options)
    added = [c for c in done.columns if c not in steps.columns]
    return done.unionByName(steps.filter(pad).withColumns({c: F.lit(0.0) for c in added}))


def pad_tokens(steps: DataFrame, prompt_len: int, response_len: int, pad_id: int = 0) -> DataFrame:
    """Adds input_ids, attention_mask, response_mask (padded) and position_ids of fixed widths:
    prompts padded in front, responses behind, both cut to their width (prompts in front).
    response_logprobs, where there are any, are cut and padded with 0.0 like the mask."""
    p = F.when(F.size("prompt_ids") > prompt_len, F.slice("prompt_ids", -prompt_len, prompt_len)).otherwise(F.col("prompt_ids"))
    x = steps.withColumn("__p", p).withColumn("__r", F.slice("response_ids", 1, response_len)).withColumn("__m", F.slice("response_mask", 1, response_len))
    before, behind = F.lit(prompt_len) - F.size("__p"), F.lit(response_len) - F.size("__r")
    ones = lambda c: F.transform(c, lambda _: F.lit(1))
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    x = x.withColumn("input_ids", F.concat(F.array_repeat(F.lit(pad_id), before), "__p", "__r", F.array_repeat(F.lit(pad_id), behind)))
    x = x.withColumn("attention_mask", F.concat(zeros(before), ones("__p"), ones("__r"), zeros(behind)))
    x = x.withColumn("response_mask", F.concat("__m", F.array_repeat(F.lit(0), F.lit(response_len) - F.size("__m"))))
    if "response_logprobs" in steps.columns:
        kept = F.slice(F.coalesce(F.col("response_logprobs").cast("array<double>"), F.array().cast("array<double>")), 1, response_len)
        x = x.withColumn("response_logprobs", F.concat(kept, F.array_repeat(F.lit(0.0), F.lit(response_len) - F.size(kept))))
    # attended tokens are one block: 0 before it, counting within, the last count behind
    place = F.transform("attention_mask", lambda _, i: F.greatest(F.lit(0), F.least(i - before, F.size("__p") + F.size("__r") - 1)))
    return x.withColumn("position_ids", place).drop("__p", "__r", "__m")


def flatten_trajectories(trajectories: DataFrame, steps_col: str = "steps") -> DataFrame:
    """Step rows from trajectories with an array of step structs; keys missing in some are null."""
    others = [c for c in trajectories.columns if c != steps_col]
    return trajectories.select(*others, F.posexplode(steps_col).alias("step_index", "__s")).select(*others, "step_index", "__s.*")


def episode_end(steps: DataFrame, max_steps: int = 3, accepted_col: str = "accepted") -> DataFrame:
    """The steps up to the first accepted answer, at most ``max_steps``."""
    w = Window.partitionBy("trajectory_id")
    stop = F.min(F.when(F.col(accepted_col), F.col("step_index"))).over(w)
    return steps.withColumn("__stop", stop).filter((F.col("step_index") < max_steps) & (F.col("__stop").isNull() | (F.col("step_index") <= F.col("__stop")))).drop("__stop")


def _before(flag: Column) -> Column:
    w = Window.partitionBy("trajectory_id").orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


def _calls(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.exists(names, lambda n: n.isin(*wanted))


def tool_gate(steps: DataFrame, most: int = 5) -> DataFrame:
    """(trajectory_id, step_index, call_no, name, allowed): a prediction call needs an earlier feature
    call, in earlier steps or before it in the same step. Only the first ``most`` calls of a step count."""
    calls = steps.select("trajectory_id", "step_index", F.posexplode(F.slice("tool_calls", 1, most)).alias("call_no", "c")).select("trajectory_id", "step_index", "call_no", F.col("c.name").alias("name"))
    w = Window.partitionBy("trajectory_id").orderBy("step_index", "call_no").rowsBetween(Window.unboundedPreceding, -1)
    ready = F.coalesce(F.max(F.col("name").isin(*FEATURE_TOOLS).cast("int")).over(w), F.lit(0)) == 1
    return calls.withColumn("allowed", (F.col("name") != PREDICT_TOOL) | ready)


def audit_workflow(steps: DataFrame) -> DataFrame:
    """Adds has_answer, valid, penalty and message for final answers, checked in order: features
    used before, a prediction made before, input not copied (column is_copy, optional)."""
    from chronoloom.operators.rows import strict_answer

    names = F.coalesce(F.transform("tool_calls", lambda c: c["name"]), F.array().cast("array<string>"))
    x = steps.withColumn("__names", F.slice(names, 1, 5))
    x = x.withColumn("__f", _before(_calls(F.col("__names"), FEATURE_TOOLS)))
    made = F.exists("__names", lambda n: n == PREDICT_TOOL) & (F.col("__f") | _feature_first())
    x = x.withColumn("__made", made).withColumn("__p", _before(F.col("__made")))
    x = x.withColumn("has_answer", strict_answer(F.col("response_text")).isNotNull())
    copy = F.coalesce("is_copy", F.lit(False)) if "is_copy" in steps.columns else F.lit(False)
    message = F.when(~F.col("__f"), NO_FEATURES).when(~F.col("__p"), NO_PREDICTION).when(copy, COPIED).otherwise(COMPLETE)
    x = x.withColumn("message", F.when(F.col("has_answer"), message))
    penalty = F.when(F.col("message") == COPIED, -1.0).when(F.col("message") == COMPLETE, 0.0).when(F.col("message").isNotNull(), -0.5)
    return x.withColumn("valid", F.col("message") == COMPLETE).withColumn("penalty", penalty).drop("__names", "__f", "__made", "__p")


def _feature_first() -> Column:
    """Within the step a feature call comes before the first prediction call."""
    predict = F.array_position("__names", PREDICT_TOOL)
    return F.exists(F.slice("__names", F.lit(1), F.greatest(predict - 1, F.lit(0)).cast("int")), lambda n: n.isin(*FEATURE_TOOLS))


def step_rewards(steps: DataFrame, bonus: float = 0.05) -> DataFrame:
    """Adds step_reward to audited steps: the final reward of valid answers (column reward), the penalty of
    others, and a bonus for steps with any tool call."""
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    value = F.when(F.col("has_answer") & F.col("valid"), F.col("reward")).when(F.col("has_answer"), F.col("penalty")).when(calls, bonus).otherwise(0.0)
    return steps.withColumn("step_reward", value)


def trajectory_timing(steps: DataFrame) -> DataFrame:
    """(metric, value): least, most and mean times per step and per trajectory, steps per trajectory, and
    the slowest trajectory's token lengths (the first of equals, by id)."""
    x = steps.select("trajectory_id", "t_generate", "t_tool", F.size("prompt_ids").alias("p"), F.size("response_ids").alias("r"))
    per = x.groupBy("trajectory_id").agg(F.sum("t_generate").alias("g"), F.sum("t_tool").alias("t"), F.count("*").cast("double").alias("n"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    three = lambda c, name: [F.min(c).alias(f"{name}/min"), F.max(c).alias(f"{name}/max"), F.avg(c).alias(f"{name}/mean")]
    a = x.agg(*three("t_generate", "step/generate"), *three("t_tool", "step/tool"))
    slow = per.select((F.col("g") + F.col("t")).alias("total"), "trajectory_id", "p", "r")
    top = slow.orderBy(F.desc(F.round("total", 9)), "trajectory_id").limit(1).select(F.col("total").alias("slowest/time"), F.col("p").cast("double").alias("slowest/prompt_length"), F.col("r").cast("double").alias("slowest/response_length"))
    b = per.agg(*three("g", "trajectory/generate"), *three("t", "trajectory/tool"), *three("n", "trajectory/steps"))
    frames = [f.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in f.columns)), F.array(*(F.col(f"`{c}`").cast("double") for c in f.columns)))).alias("metric", "value")) for f in (a, b, top)]
    return concat_batches(*frames)


def critic_value_at_last_token(steps: DataFrame, values_col: str = "values") -> DataFrame:
    """Adds critic_value and critic_mask: the value at the last response token, and a mask of that token."""
    n = response_length()
    return steps.withColumn("critic_value", F.when(n > 0, F.get(values_col, n - 1))).withColumn("critic_mask", F.transform("response_mask", lambda _, i: (i == n - 1).cast("int")))
