"""Registered queries over agent steps and validation samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import evaluation as ev
from chronoloom.operators import rows
from chronoloom.operators import trajectories as tr
from chronoloom.plans import bindings as b
from chronoloom.plans.bindings import with_sql
from chronoloom.plans.feature_queries import r

KEYS = ("trajectory_id", "step_index")


def b04_last_step(spark, sf_dir):
    return rows.last_step(b.steps(spark, sf_dir)).select(*KEYS, r("reward_score"))


def b05_b06_valid_and_live_rows(spark, sf_dir):
    s = b.steps(spark, sf_dir).withColumn("is_pad", F.col("step_index") % 4 == 3)
    return rows.non_aborted(rows.valid_rows(s)).select(*KEYS)


def b07_normalize_model_name(spark, sf_dir):
    s = b.steps(spark, sf_dir)
    name = F.when(F.col("step_index") % 3 == 0, " ARIMA\n").when(F.col("step_index") % 3 == 1, "PatchTST").otherwise(F.col("role"))
    return s.select(*KEYS, rows.normalize_model_name(name).alias("model"))


def b08_cap_tool_calls(spark, sf_dir):
    s = b.agent_steps(spark, sf_dir)
    many = s.withColumn("tool_calls", F.flatten(F.array_repeat("tool_calls", 4)))
    return rows.cap_tool_calls(many).select(*KEYS, F.size("tool_calls").alias("n"), F.array_join(F.transform("tool_calls", lambda c: c["name"]), ",").alias("names"))


def b09_tool_argument(spark, sf_dir):
    s = b.agent_steps(spark, sf_dir).select(*KEYS, F.posexplode("tool_calls").alias("call_no", "c"))
    return s.select(*KEYS, "call_no", rows.tool_argument(F.col("c.arguments")).alias("model_name"))


def b10_truncate_responses(spark, sf_dir):
    return rows.truncate_responses(b.steps(spark, sf_dir), 16).select(*KEYS, F.size("response_ids").alias("n"), F.aggregate("response_ids", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"))


def c04_attach_rollouts(spark, sf_dir):
    s = b.steps(spark, sf_dir)
    most = s.agg(F.max("step_index")).first()[0]  # one number: how many steps the longest trajectory has
    prompts = tr.repeat_prompts(s.filter("step_index = 0").groupBy("uid").agg(F.count("*").alias("n_trajectories")), (-1 if most is None else most) + 1)
    rollouts = s.groupBy("uid", F.col("step_index").alias("rollout_n")).agg(F.sum(F.size("response_ids")).alias("tokens"))
    return tr.attach_rollouts(prompts, rollouts).select("uid", "rollout_n", "n_trajectories", "tokens")


def g01_rollout_index(spark, sf_dir):
    docs = b.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("row_no"), F.floor(F.col("conv_id") / 4).alias("shard"), F.col("role"))
    doubled = docs.withColumn("index", F.floor(F.col("row_no") % 100 / 3))
    return tr.rollout_index(doubled, "index", "row_no", "shard").select("row_no", "index", "rollout_n")


def g01_rollout_index_by_order(spark, sf_dir):
    """One order over all rows, without shards."""
    rows = b.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("row_no"), F.floor(F.col("conv_id") / 3).alias("index"))
    return tr.rollout_index(rows, "index", "row_no", None).select("row_no", "index", "rollout_n")


def g02_repeat(spark, sf_dir):
    n = b.steps(spark, sf_dir).groupBy("trajectory_id").agg(F.count("*").cast("int").alias("num_steps"))
    return tr.repeat_by_steps(tr.repeat_prompts(n, 2)).select("trajectory_id", "rollout_n", "step_index")


def g03_grpo_advantage(spark, sf_dir):
    return tr.grpo_advantage(b.steps(spark, sf_dir)).select(*KEYS, r("score"), r("advantage"))


def g03_grpo_advantage_centred(spark, sf_dir):
    t = tr.broadcast_over_tokens(tr.grpo_advantage(b.steps(spark, sf_dir), norm_by_std=False))
    return t.select(*KEYS, r("advantage"), F.size("token_advantage").alias("n"), r(F.aggregate("token_advantage", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def g04_gae_advantage(spark, sf_dir):
    g = tr.gae_advantage(b.steps(spark, sf_dir), 0.99, 0.9)
    return g.select(*KEYS, r("advantage"), r("returns"))


def g05_compute_advantage(spark, sf_dir):
    s = b.steps(spark, sf_dir).withColumn("is_pad", F.col("step_index") % 4 == 3)
    return tr.compute_advantage(s, "grpo").select(*KEYS, r("advantage"))


def g06_token_rewards(spark, sf_dir):
    x = tr.token_rewards(b.steps(spark, sf_dir))
    return x.select(*KEYS, F.size("token_rewards").alias("n"), r(F.element_at("token_rewards", -1)).alias("last_reward"), r(F.aggregate("token_rewards", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def g07_pad_tokens(spark, sf_dir):
    x = tr.pad_tokens(b.steps(spark, sf_dir), 12, 20)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return x.select(*KEYS, text("input_ids"), text("attention_mask"), text("response_mask"), text("position_ids"))


def g08_flatten_trajectories(spark, sf_dir):
    s = b.steps(spark, sf_dir)
    packed = s.groupBy("trajectory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "role", "reward_score"))), lambda x: F.struct(x["role"].alias("role"), x["reward_score"].alias("reward_score"))).alias("steps"))
    other = packed.filter("cast(trajectory_id as int) % 2 = 0").select("trajectory_id", F.transform("steps", lambda x: F.struct(x["role"].alias("role"))).alias("steps"))
    rest = packed.filter("cast(trajectory_id as int) % 2 = 1")
    return tr.concat_batches(tr.flatten_trajectories(rest), tr.flatten_trajectories(other))


def g09_audit_workflow(spark, sf_dir):
    return tr.audit_workflow(b.agent_steps(spark, sf_dir)).select(*KEYS, "has_answer", "message", "penalty")


def g10_step_rewards(spark, sf_dir):
    s = tr.audit_workflow(b.agent_steps(spark, sf_dir)).withColumn("reward", F.col("reward_score"))
    return tr.step_rewards(s).select(*KEYS, r("step_reward"))


def g11_tool_gate(spark, sf_dir):
    return tr.tool_gate(b.agent_steps(spark, sf_dir))


def g12_episode_end(spark, sf_dir):
    s = tr.audit_workflow(b.agent_steps(spark, sf_dir)).withColumn("accepted", F.coalesce("valid", F.lit(False)))
    return tr.episode_end(s, 5).select(*KEYS)


def g13_trajectory_timing(spark, sf_dir):
    return tr.trajectory_timing(b.steps(spark, sf_dir)).select("metric", r("value"))


def g14_critic_value(spark, sf_dir):
    s = b.steps(spark, sf_dir).withColumn("values", F.transform("response_ids", lambda x, i: x * 0.5 + i))
    return tr.critic_value_at_last_token(s).select(*KEYS, r("critic_value"), F.aggregate("critic_mask", F.lit(0), lambda a, m: a + m).alias("ones"), (F.array_position("critic_mask", 1)).cast("int").alias("place"))


def i4_distinct_trajectories(spark, sf_dir):
    return tr.distinct_trajectories(b.steps(spark, sf_dir))


def i5_concat_batches(spark, sf_dir):
    s = b.steps(spark, sf_dir)
    return tr.concat_batches(s.filter("step_index = 0").select(*KEYS, "role"), s.filter("step_index > 0").select(*KEYS, r("reward_score")))


def h01_validation_stats(spark, sf_dir):
    return ev.validation_stats(b.val_samples(spark, sf_dir)).select(*ev.KEYS, "metric", r("value"))


def h02_bootstrap_sizes(spark, sf_dir):
    n = b.val_samples(spark, sf_dir).filter("var = 'acc'").groupBy("data_source", "uid").agg(F.count("*").alias("n"))
    return n.select("data_source", "uid", F.array_join(ev.bootstrap_sizes(F.col("n")).cast("array<string>"), ",").alias("sizes"))


def h03_bootstrap_best_worst(spark, sf_dir):
    return ev.bootstrap_best_worst(b.val_samples(spark, sf_dir))


def h03_best_worst_by_ranks(spark, sf_dir):
    """Resamples of groups of any size, beside the exact expectations: within five standard errors."""
    samples = b.val_samples(spark, sf_dir)
    name = F.split("metric", "[@/]")
    boot = ev.bootstrap_by_ranks(samples).select(*ev.KEYS, name[1].cast("int").alias("n"), F.concat_ws("_", name[0], name[2]).alias("what"), "value").groupBy(*ev.KEYS, "n").pivot("what", ["best_mean", "best_std", "worst_mean", "worst_std"]).agg(F.first("value"))
    near = lambda c: (F.abs(F.col(c) - F.col(f"{c}_mean")) <= 5 * F.col(f"{c}_std") / 1000**0.5 + 5e-3).alias(f"{c}_agrees")
    return ev.exact_best_worst(samples).join(boot, [*ev.KEYS, "n"]).select(*ev.KEYS, "n", near("best"), near("worst"))


def h04_exact_best_worst(spark, sf_dir):
    return ev.exact_best_worst(b.val_samples(spark, sf_dir)).select(*ev.KEYS, "n", r("best"), r("worst"))


def h05_bootstrap_majority(spark, sf_dir):
    return ev.bootstrap_majority(b.val_samples(spark, sf_dir))


def h06_rollup_by_source(spark, sf_dir):
    return ev.rollup_by_source(ev.validation_stats(b.val_samples(spark, sf_dir))).select("data_source", "var", "metric", r("value"))


def h07_label_metrics(spark, sf_dir):
    return ev.label_metrics(ev.rollup_by_source(ev.validation_stats(b.val_samples(spark, sf_dir)))).select("section", "key", r("value"))


def _scored(spark, sf_dir):
    s = b.steps(spark, sf_dir)
    return tr.gae_advantage(s, 0.99, 0.9, whiten=False).withColumn("score", F.col("reward_score") * 2)


#: Allowed lengths of responses and prompts.
MAX_RESPONSE, MAX_PROMPT = 48, 8


def h08_data_metrics(spark, sf_dir):
    return ev.data_metrics(_scored(spark, sf_dir), MAX_RESPONSE, MAX_PROMPT).select("metric", r("value"))


def h09_explained_variance(spark, sf_dir):
    return ev.explained_variance(_scored(spark, sf_dir)).select("metric", r("value"))


def h10_response_info(spark, sf_dir):
    return ev.response_info(b.steps(spark, sf_dir)).select(*KEYS, "prompt_length", "response_length")


def _stage_times(spark, sf_dir):
    """Seconds of a stage per role of the steps, named after the trainer's stages."""
    names = F.when(F.col("role") == "user", "gen").otherwise("ref")
    return b.steps(spark, sf_dir).groupBy(names.alias("stage")).agg(F.sum("t_generate").alias("seconds")).unionByName(b.steps(spark, sf_dir).agg(F.sum("t_tool").alias("seconds")).select(F.lit("step").alias("stage"), "seconds"))


def h11_timing_metrics(spark, sf_dir):
    return ev.timing_metrics(_stage_times(spark, sf_dir), b.steps(spark, sf_dir)).select("metric", r("value"))


def h12_throughput(spark, sf_dir):
    return ev.throughput(b.steps(spark, sf_dir), 12.5, 4).select("metric", r("value"))


def h13_reduce_metrics(spark, sf_dir):
    x = b.steps(spark, sf_dir).select(F.col("role").alias("metric"), F.col("reward_score").alias("value"))
    return ev.reduce_metrics(x).select("metric", r("value"))


def h14_sample_generations(spark, sf_dir):
    s = b.steps(spark, sf_dir).select(F.col("response_text").alias("input"), *KEYS)
    return ev.sample_generations(s, 10, keys=KEYS)


def j03_bootstrap_reducers(spark, sf_dir):
    """Reducers of one's own over resamples, beside the exact expectations: within five standard errors."""
    samples = b.val_samples(spark, sf_dir)
    own = {"best": lambda x: x.max(axis=1), "worst": lambda x: x.min(axis=1)}
    name = F.split("metric", "[@/]")
    boot = ev.bootstrap(samples, own, 1000).select(*ev.KEYS, name[1].cast("int").alias("n"), F.concat_ws("_", name[0], name[2]).alias("what"), "value").groupBy(*ev.KEYS, "n").pivot("what", ["best_mean", "best_std", "worst_mean", "worst_std"]).agg(F.first("value"))
    near = lambda c: (F.abs(F.col(c) - F.col(f"{c}_mean")) <= 5 * F.col(f"{c}_std") / 1000**0.5 + 5e-3).alias(f"{c}_agrees")
    return ev.exact_best_worst(samples).join(boot, [*ev.KEYS, "n"]).select(*ev.KEYS, "n", near("best"), near("worst"))


def i6_shared_stages(spark, sf_dir):
    named = b.steps(spark, sf_dir).select(F.col("role").alias("stage"))
    return ev.shared_stages(named, named.filter("stage <> 'user'"))


QUERIES = {
    f.__name__: f
    for f in (
        b04_last_step, b05_b06_valid_and_live_rows, b07_normalize_model_name, b08_cap_tool_calls, b09_tool_argument, b10_truncate_responses, c04_attach_rollouts, g01_rollout_index, g01_rollout_index_by_order, g02_repeat, g03_grpo_advantage,
        g03_grpo_advantage_centred, g04_gae_advantage, g05_compute_advantage, g06_token_rewards, g07_pad_tokens, g08_flatten_trajectories, g09_audit_workflow, g10_step_rewards, g11_tool_gate, g12_episode_end,
        g13_trajectory_timing, g14_critic_value, i4_distinct_trajectories, i5_concat_batches, h01_validation_stats, h02_bootstrap_sizes, h03_best_worst_by_ranks, h03_bootstrap_best_worst, h04_exact_best_worst, h05_bootstrap_majority,
        h06_rollup_by_source, h07_label_metrics, h08_data_metrics, h09_explained_variance, h10_response_info, h11_timing_metrics, h12_throughput, h13_reduce_metrics, h14_sample_generations, i6_shared_stages, j03_bootstrap_reducers,
    )
}

_S = with_sql("steps")
_A = with_sql("steps", "agent_steps")
_V = with_sql("val_samples")


def _grpo(source: str, norm: bool = True) -> str:
    return f"""
gf AS (SELECT uid, trajectory_id, arg_min(reward_score, step_index) AS s FROM {source} GROUP BY 1, 2),
gg AS (SELECT uid, CASE WHEN count(*) > 1 THEN avg(s) ELSE 0 END AS m, CASE WHEN count(*) > 1 THEN stddev_samp(s) ELSE 1 END AS d FROM gf GROUP BY 1),
grpo AS (SELECT s.*, (reward_score - m) {'/ (d + 1e-6)' if norm else ''} AS advantage FROM {source} s JOIN gg USING (uid))"""


_GAE = """
gl AS (SELECT max(step_index) AS last FROM steps),
gt AS (SELECT trajectory_id, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT trajectory_id FROM steps), gl, (SELECT unnest(range(1000)) AS t) WHERE t <= last),
gd AS (SELECT trajectory_id, t, coalesce(reward_score, 0) + 0.99 * coalesce(lead(value) OVER (PARTITION BY trajectory_id ORDER BY t), 0) - coalesce(value, 0) AS delta
  FROM (SELECT gt.trajectory_id, t, reward_score, coalesce(value, 0) AS value FROM gt LEFT JOIN steps s ON s.trajectory_id = gt.trajectory_id AND s.step_index = t)),
ga AS (SELECT a.trajectory_id, a.t AS step_index, sum(b.delta * (0.99 * 0.9) ** (b.t - a.t)) AS adv FROM gd a JOIN gd b ON a.trajectory_id = b.trajectory_id AND b.t >= a.t GROUP BY 1, 2),
gae AS (SELECT s.*, adv, adv + value AS returns FROM steps s JOIN ga USING (trajectory_id, step_index)),
gw AS (SELECT sum(n_tokens * adv) / sum(n_tokens) AS m, sum(n_tokens) AS n FROM gae),
gv AS (SELECT any_value(m) AS m, sum(n_tokens * (adv - m) ** 2) / (any_value(n) - 1) AS v FROM gae, gw)"""

_AUDIT = rf"""
ab AS (SELECT *, coalesce(max(CASE WHEN list_contains(calls, 'F') THEN 1 ELSE 0 END) OVER w, 0) AS f FROM agent_steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
am AS (SELECT *, CASE WHEN (list_contains(calls, 'P') OR list_contains(calls, 'X')) AND (f = 1 OR calls[1] = 'F') THEN 1 ELSE 0 END AS made FROM ab),
ap AS (SELECT *, coalesce(max(made) OVER (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
    step_index % 3 = 2 AND CAST(trajectory_id AS BIGINT) % 7 <> 0 AND trim(response_text) <> '' AS has_answer FROM am),
audit AS (SELECT *, CASE WHEN NOT has_answer THEN NULL WHEN f = 0 THEN '{tr.NO_FEATURES}' WHEN p = 0 THEN '{tr.NO_PREDICTION}' WHEN is_copy THEN '{tr.COPIED}' ELSE '{tr.COMPLETE}' END AS message FROM ap)"""

_VS = """
vs AS (SELECT data_source, uid, var, count(*) AS n, avg(num) AS m, stddev_pop(num) AS s FROM val_samples WHERE num IS NOT NULL GROUP BY 1, 2, 3),
vm AS (SELECT data_source, uid, var, 'mean@' || n AS metric, m AS value FROM vs UNION ALL SELECT data_source, uid, var, 'std@' || n, s FROM vs WHERE n > 1),
vr AS (SELECT data_source, var, metric, avg(value) AS value FROM vm GROUP BY 1, 2, 3)"""


def _three(c: str, name: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{name}/{k}' AS metric, CAST({f}({c}) FILTER (WHERE {where}) AS DOUBLE) AS value FROM gae" for f, k in (("avg", "mean"), ("max", "max"), ("min", "min")))


def _token_three(c: str, name: str) -> str:
    return f"SELECT '{name}/mean' AS metric, sum({c} * n_tokens) / sum(n_tokens) AS value FROM gae UNION ALL SELECT '{name}/max', max({c}) FILTER (WHERE n_tokens > 0) FROM gae UNION ALL SELECT '{name}/min', min({c}) FILTER (WHERE n_tokens > 0) FROM gae"


_EXACT = f"""{_V}, c AS (SELECT data_source, uid, var, num, row_number() OVER (PARTITION BY data_source, uid, var ORDER BY num, sample_no) AS k, count(*) OVER (PARTITION BY data_source, uid, var) AS tot FROM val_samples WHERE num IS NOT NULL),
      s AS (SELECT *, unnest(list_append(list_filter(list_transform(range(1, 31), lambda i: CAST(2 ** i AS BIGINT)), lambda p: p < tot), tot)) AS n FROM c WHERE tot > 1)"""

_METRICS = " UNION ALL ".join(
    [
        _three("reward_score * 2", "critic/score", "n_tokens > 0"), _three("reward_score", "critic/rewards", "n_tokens > 0"), _token_three("adv", "critic/advantages"), _token_three("returns", "critic/returns"), _token_three("value", "critic/values"),
        _three("n_tokens", "response_length"), f"SELECT 'response_length/clip_ratio', avg(CASE WHEN n_tokens = {MAX_RESPONSE} THEN 1.0 ELSE 0.0 END) FROM gae", _three("n_tokens", "response_length_non_aborted", "n_tokens > 0"),
        f"SELECT 'response_length_non_aborted/clip_ratio', avg(CASE WHEN n_tokens = {MAX_RESPONSE} THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_tokens > 0) FROM gae",
        "SELECT 'response/aborted_ratio', avg(CASE WHEN n_tokens = 0 THEN 1.0 ELSE 0.0 END) FROM gae", _three("len(prompt_ids)", "prompt_length"),
        f"SELECT 'prompt_length/clip_ratio', avg(CASE WHEN len(prompt_ids) = {MAX_PROMPT} THEN 1.0 ELSE 0.0 END) FROM gae",
    ]
)

_PAD = "list_transform(range({n}), lambda i: {e})"
_TIMING = " UNION ALL ".join(f"SELECT '{p}/{n}/{k}' AS metric, CAST({f}({c}) AS DOUBLE) AS value FROM {t}" for p, t, cs in (("step", "steps", (("generate", "t_generate"), ("tool", "t_tool"))), ("trajectory", "per", (("generate", "g"), ("tool", "t"), ("steps", "n")))) for n, c in cs for f, k in (("min", "min"), ("max", "max"), ("avg", "mean")))

ORACLE_SQL = {
    "b04_last_step": f"{_S} SELECT trajectory_id, step_index, round(reward_score, 6) + 0.0 AS reward_score FROM steps QUALIFY row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index DESC) = 1",
    "b05_b06_valid_and_live_rows": f"{_S} SELECT trajectory_id, step_index FROM steps WHERE step_index % 4 <> 3 AND n_tokens > 0",
    "b07_normalize_model_name": f"{_S} SELECT trajectory_id, step_index, CASE step_index % 3 WHEN 0 THEN 'arima' WHEN 1 THEN 'patchtst' ELSE 'chronos2' END AS model FROM steps",
    "b08_cap_tool_calls": f"""{_A} SELECT trajectory_id, step_index, CAST(least(5, 4 * len(calls)) AS INTEGER) AS n,
      array_to_string(list_transform(flatten([calls, calls, calls, calls])[1:5], lambda c: CASE WHEN c = 'F' THEN 'extract_data_quality' ELSE 'predict_time_series' END), ',') AS names FROM agent_steps""",
    "b09_tool_argument": f"{_A} SELECT trajectory_id, step_index, CAST(i - 1 AS INTEGER) AS call_no, CASE WHEN c = 'P' THEN ' ARIMA ' END AS model_name FROM (SELECT trajectory_id, step_index, unnest(calls) AS c, generate_subscripts(calls, 1) AS i FROM agent_steps)",
    "b10_truncate_responses": f"{_S} SELECT trajectory_id, step_index, CAST(least(16, n_tokens) AS INTEGER) AS n, CAST(coalesce(list_sum(response_ids[1:16]), 0) AS BIGINT) AS total FROM steps",
    "c04_attach_rollouts": f"""{_S} SELECT uid, step_index AS rollout_n, n_trajectories, tokens FROM (SELECT uid, count(*) AS n_trajectories FROM steps WHERE step_index = 0 GROUP BY 1)
      JOIN (SELECT uid, step_index, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM steps GROUP BY 1, 2) USING (uid)""",
    "g01_rollout_index": """WITH x AS (SELECT conv_id * 100 + turn AS row_no, conv_id // 4 AS shard, (conv_id * 100 + turn) % 100 // 3 AS index FROM conversations),
      y AS (SELECT *, sum(CASE WHEN index = l THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY row_no) AS run FROM (SELECT *, lag(index) OVER (PARTITION BY shard ORDER BY row_no) AS l FROM x))
      SELECT row_no, CAST(index AS BIGINT) AS index, CAST(row_number() OVER (PARTITION BY shard, run ORDER BY row_no) - 1 AS INTEGER) AS rollout_n FROM y""",
    "g01_rollout_index_by_order": "SELECT conv_id * 100000 + turn AS row_no, conv_id // 3 AS index, CAST(row_number() OVER (PARTITION BY conv_id // 3 ORDER BY conv_id, turn) - 1 AS INTEGER) AS rollout_n FROM conversations",
    "g02_repeat": f"{_S} SELECT trajectory_id, CAST(k AS INTEGER) AS rollout_n, CAST(s AS INTEGER) AS step_index FROM (SELECT trajectory_id, unnest(range(count(*))) AS s FROM steps GROUP BY 1), (SELECT unnest(range(2)) AS k)",
    "g03_grpo_advantage": f"{_S},{_grpo('steps')} SELECT trajectory_id, step_index, round(reward_score, 6) + 0.0 AS score, round(advantage, 6) + 0.0 AS advantage FROM grpo",
    "g03_grpo_advantage_centred": f"{_S},{_grpo('steps', False)} SELECT trajectory_id, step_index, round(advantage, 6) + 0.0 AS advantage, CAST(n_tokens AS INTEGER) AS n, round(advantage * n_tokens, 6) + 0.0 AS total FROM grpo",
    "g04_gae_advantage": f"{_S},{_GAE} SELECT trajectory_id, step_index, round((adv - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage, round(returns, 6) + 0.0 AS returns FROM gae, gv",
    "g05_compute_advantage": f"{_S}, live AS (SELECT * FROM steps WHERE step_index % 4 <> 3),{_grpo('live')} SELECT trajectory_id, step_index, round(coalesce(advantage, 0), 6) + 0.0 AS advantage FROM steps LEFT JOIN (SELECT trajectory_id, step_index, advantage FROM grpo) USING (trajectory_id, step_index)",
    "g06_token_rewards": f"{_S} SELECT trajectory_id, step_index, CAST(n_tokens AS INTEGER) AS n, round(reward_score, 6) + 0.0 AS last_reward, round(reward_score, 6) + 0.0 AS total FROM steps",
    "g07_pad_tokens": f"""{_S}, p AS (SELECT *, len(prompt_ids) AS np, least(20, n_tokens) AS nr FROM steps) SELECT trajectory_id, step_index,
      array_to_string({_PAD.format(n=32, e='CASE WHEN i < 12 - np THEN 0 WHEN i < 12 THEN prompt_ids[i - 12 + np + 1] WHEN i < 12 + nr THEN response_ids[i - 11] ELSE 0 END')}, ',') AS input_ids,
      array_to_string({_PAD.format(n=32, e='CASE WHEN i >= 12 - np AND i < 12 + nr THEN 1 ELSE 0 END')}, ',') AS attention_mask,
      array_to_string({_PAD.format(n=20, e='CASE WHEN i < nr THEN 1 ELSE 0 END')}, ',') AS response_mask,
      array_to_string({_PAD.format(n=32, e='greatest(0, least(i - 12 + np, np + nr - 1))')}, ',') AS position_ids FROM p""",
    "g08_flatten_trajectories": f"{_S} SELECT trajectory_id, step_index, role, CASE WHEN CAST(trajectory_id AS INTEGER) % 2 = 1 THEN reward_score END AS reward_score FROM steps",
    "g09_audit_workflow": f"{_A},{_AUDIT} SELECT trajectory_id, step_index, has_answer, message, CAST(CASE message WHEN '{tr.COMPLETE}' THEN 0 WHEN '{tr.COPIED}' THEN -1 WHEN '{tr.NO_FEATURES}' THEN -0.5 WHEN '{tr.NO_PREDICTION}' THEN -0.5 END AS DOUBLE) AS penalty FROM audit",
    "g10_step_rewards": f"{_A},{_AUDIT} SELECT trajectory_id, step_index, round(CAST(CASE WHEN message = '{tr.COMPLETE}' THEN reward_score WHEN message = '{tr.COPIED}' THEN -1 WHEN message IS NOT NULL THEN -0.5 WHEN len(calls) > 0 THEN 0.05 ELSE 0 END AS DOUBLE), 6) + 0.0 AS step_reward FROM audit",
    "g11_tool_gate": f"""{_A}, c AS (SELECT trajectory_id, step_index, CAST(i - 1 AS INTEGER) AS call_no, n FROM (SELECT trajectory_id, step_index, unnest(calls) AS n, generate_subscripts(calls, 1) AS i FROM agent_steps))
      SELECT trajectory_id, step_index, call_no, CASE WHEN n = 'F' THEN 'extract_data_quality' ELSE 'predict_time_series' END AS name,
        n = 'F' OR coalesce(max(CASE WHEN n = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY step_index, call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS allowed FROM c""",
    "g12_episode_end": f"{_A},{_AUDIT} SELECT trajectory_id, step_index FROM (SELECT *, min(CASE WHEN message = '{tr.COMPLETE}' THEN step_index END) OVER (PARTITION BY trajectory_id) AS stop FROM audit) WHERE step_index < 5 AND (stop IS NULL OR step_index <= stop)",
    "g13_trajectory_timing": f"""{_S}, per AS (SELECT trajectory_id, sum(t_generate) AS g, sum(t_tool) AS t, count(*) AS n, sum(len(prompt_ids)) AS p, sum(n_tokens) AS r FROM steps GROUP BY 1),
      slow AS (SELECT * FROM per ORDER BY round(g + t, 9) DESC, trajectory_id LIMIT 1)
      SELECT metric, round(value, 6) + 0.0 AS value FROM ({_TIMING} UNION ALL SELECT 'slowest/time', g + t FROM slow UNION ALL SELECT 'slowest/prompt_length', CAST(p AS DOUBLE) FROM slow UNION ALL SELECT 'slowest/response_length', CAST(r AS DOUBLE) FROM slow)""",
    "g14_critic_value": f"{_S} SELECT trajectory_id, step_index, round(response_ids[n_tokens] / 2 + n_tokens - 1, 6) + 0.0 AS critic_value, CAST(CASE WHEN n_tokens > 0 THEN 1 ELSE 0 END AS INTEGER) AS ones, CAST(n_tokens AS INTEGER) AS place FROM steps",
    "i4_distinct_trajectories": f"{_S} SELECT trajectory_id, CAST(row_number() OVER (ORDER BY trajectory_id) - 1 AS INTEGER) AS dense_id FROM (SELECT DISTINCT trajectory_id FROM steps)",
    "i5_concat_batches": f"{_S} SELECT trajectory_id, step_index, CASE WHEN step_index = 0 THEN role END AS role, CASE WHEN step_index > 0 THEN round(reward_score, 6) + 0.0 END AS reward_score FROM steps",
    "h01_validation_stats": f"{_V},{_VS} SELECT data_source, uid, var, metric, round(value, 6) + 0.0 AS value FROM vm",
    "h02_bootstrap_sizes": f"""{_V}, c AS (SELECT data_source, uid, count(*) AS n FROM val_samples WHERE var = 'acc' GROUP BY 1, 2)
      SELECT data_source, uid, CASE WHEN n > 1 THEN array_to_string(list_append(list_filter(list_transform(range(1, 31), lambda k: CAST(2 ** k AS BIGINT)), lambda p: p < n), n), ',') ELSE '' END AS sizes FROM c""",
    "h04_exact_best_worst": f"""{_EXACT}
      SELECT data_source, uid, var, CAST(n AS INTEGER) AS n, round(sum(num * ((k / tot) ** n - ((k - 1) / tot) ** n)), 6) + 0.0 AS best, round(sum(num * (((tot - k + 1) / tot) ** n - ((tot - k) / tot) ** n)), 6) + 0.0 AS worst FROM s GROUP BY 1, 2, 3, 4""",
    "h06_rollup_by_source": f"{_V},{_VS} SELECT data_source, var, metric, round(value, 6) + 0.0 AS value FROM vr",
    "h07_label_metrics": f"""{_V},{_VS}, x AS (SELECT *, CAST(regexp_extract(metric, '@(\\d+)', 1) AS INTEGER) AS n, max(CAST(regexp_extract(metric, '@(\\d+)', 1) AS INTEGER)) OVER (PARTITION BY data_source, var) AS most FROM vr),
      y AS (SELECT *, CASE WHEN var = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND n = most THEN 'val-core' ELSE 'val-aux' END AS section FROM x)
      SELECT section, section || '/' || data_source || '/' || var || '/' || metric AS key, round(value, 6) + 0.0 AS value FROM y""",
    "h08_data_metrics": f"{_S},{_GAE} SELECT metric, round(value, 6) + 0.0 AS value FROM ({_METRICS})",
    "h09_explained_variance": f"""{_S},{_GAE}, e AS (SELECT n_tokens AS k, returns - value AS e, returns AS r FROM gae WHERE n_tokens > 0), m AS (SELECT sum(k * e) / sum(k) AS me, sum(k * r) / sum(k) AS mr, sum(k) AS n FROM e)
      SELECT 'critic/vf_explained_var' AS metric, round(1 - (sum(k * (e - me) ** 2) / (any_value(n) - 1)) / (sum(k * (r - mr) ** 2) / (any_value(n) - 1) + 1e-5), 6) + 0.0 AS value FROM e, m""",
    "h10_response_info": f"{_S} SELECT trajectory_id, step_index, CAST(len(prompt_ids) AS INTEGER) AS prompt_length, CAST(n_tokens AS INTEGER) AS response_length FROM steps",
    "h11_timing_metrics": f"""{_S}, st AS (SELECT CASE WHEN role = 'user' THEN 'gen' ELSE 'ref' END AS stage, sum(t_generate) AS seconds FROM steps GROUP BY 1 UNION ALL SELECT 'step', sum(t_tool) FROM steps),
      tk AS (SELECT sum(n_tokens) AS r, sum(n_tokens + len(prompt_ids)) AS t FROM steps)
      SELECT 'timing_s/' || stage AS metric, round(seconds, 6) + 0.0 AS value FROM st UNION ALL SELECT 'timing_per_token_ms/' || stage, round(seconds * 1000 / CASE WHEN stage = 'gen' THEN r ELSE t END, 6) + 0.0 FROM st, tk WHERE stage <> 'step'""",
    "h12_throughput": f"""{_S}, tk AS (SELECT CAST(sum(n_tokens + len(prompt_ids)) AS DOUBLE) AS t FROM steps) SELECT 'perf/total_num_tokens' AS metric, t AS value FROM tk
      UNION ALL SELECT 'perf/time_per_step', CAST(12.5 AS DOUBLE) FROM tk UNION ALL SELECT 'perf/throughput', round(t / 50, 6) FROM tk""",
    "h13_reduce_metrics": f"{_S} SELECT role AS metric, round(avg(reward_score), 6) + 0.0 AS value FROM steps GROUP BY 1",
    "h14_sample_generations": f"{_S} SELECT response_text AS input, trajectory_id, step_index FROM steps ORDER BY md5('42#' || coalesce(response_text, '')), input, trajectory_id, step_index LIMIT 10",
    "h03_best_worst_by_ranks": f"{_EXACT} SELECT data_source, uid, var, CAST(n AS INTEGER) AS n, true AS best_agrees, true AS worst_agrees FROM s GROUP BY 1, 2, 3, 4",
    "j03_bootstrap_reducers": f"{_EXACT} SELECT data_source, uid, var, CAST(n AS INTEGER) AS n, true AS best_agrees, true AS worst_agrees FROM s GROUP BY 1, 2, 3, 4",
    "i6_shared_stages": f"{_S} SELECT DISTINCT role AS stage FROM steps WHERE role <> 'user'",
}
