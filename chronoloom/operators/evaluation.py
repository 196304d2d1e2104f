"""Validation statistics over samples, and training metrics over steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ranges import beside, numbered
from chronoloom.operators.rows import response_length
from chronoloom.sources.storage import stash

KEYS = ("data_source", "uid", "var")


def _numbers(samples: DataFrame) -> DataFrame:
    """Numeric samples; NaN counts as missing."""
    return samples.filter("num is not null").withColumn("num", F.when(~F.isnan("num"), F.col("num")))


def long_metrics(df: DataFrame, keys: tuple[str, ...], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, value) for the metrics that are not null; names may be columns' texts."""
    pairs = F.filter(F.array(*(F.struct(F.expr(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items())), lambda p: p["value"].isNotNull())
    return df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def validation_stats(samples: DataFrame) -> DataFrame:
    """(data_source, uid, var, metric, value): mean@N, and std@N of more than one sample."""
    g = _numbers(samples).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("num").alias("m"), F.stddev_pop("num").alias("s"))
    return long_metrics(g, KEYS, {"concat('mean@', n)": F.col("m"), "concat('std@', n)": F.when(F.col("n") > 1, F.col("s"))})


def bootstrap_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n; empty for n < 2."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n.cast("int")))).otherwise(F.array().cast("array<int>"))


def _ranked(samples: DataFrame) -> DataFrame:
    """Numeric samples with their number (from 0, by sample_no) and the group's count."""
    x = _numbers(samples).select(*KEYS, "sample_no", "num")
    return x.withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("sample_no")) - 1).withColumn("total", F.count("*").over(Window.partitionBy(*KEYS)).cast("int"))


#: Numbers drawn at a time.
BLOCK = 2_000_000

#: From blocks of draws (resamples x n, NaN: missing) to a number per resample. Users add their own.
Reducer = Callable[[np.ndarray], np.ndarray]
REDUCERS: dict[str, Reducer] = {"best": lambda x: np.fmax.reduce(x, axis=1), "worst": lambda x: np.fmin.reduce(x, axis=1)}


def _resampled(groups: DataFrame, reduce: Callable[[pd.Series, np.ndarray], dict[str, np.ndarray]], names: list[str], width: Callable[[pd.Series], int], n_boot: int, seed: int) -> DataFrame:
    """(keys, metric, value): mean and deviation over resamples of what ``reduce`` makes of (group, draws).

    A group's samples are one row's arrays (num, and what else the reduction needs); (group, size)
    pairs are dealt over tasks, and draws are made and reduced in blocks where they are. The
    generator starts anew for each pair, so draws depend on the group's count and n alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, g in pdf.iterrows():
                rng, total, n = np.random.RandomState(seed), len(g["num"]), int(g["n"])
                found: dict[str, list[np.ndarray]] = {name: [] for name in names}
                block = max(1, BLOCK // (n + width(g)))
                for low in range(0, n_boot, block):
                    draws = rng.randint(0, total, size=min(block, n_boot - low) * n).reshape(-1, n)
                    for name, values in reduce(g, draws).items():
                        found[name].append(values)
                for name in names:
                    x = np.concatenate(found[name])
                    x = x[~np.isnan(x)]
                    if len(x):
                        rows += [(*(g[k] for k in KEYS), f"{name}@{n}/mean", x.mean()), (*(g[k] for k in KEYS), f"{name}@{n}/std", x.std())]
            yield pd.DataFrame(rows, columns=[*KEYS, "metric", "value"])

    sized = groups.withColumn("n", F.explode(bootstrap_sizes(F.size("num"))))
    return sized.repartition(*KEYS, "n").mapInPandas(run, "data_source string, uid string, var string, metric string, value double")


def _gathered(ranked: DataFrame, *columns: str) -> DataFrame:
    """A row per group with its samples' columns as arrays, in order of sample_no."""
    rows = F.array_sort(F.collect_list(F.struct("i", *columns)))
    return ranked.groupBy(*KEYS).agg(rows.alias("__r")).select(*KEYS, *(F.col(f"__r.{c}").alias(c) for c in columns))


def bootstrap(samples: DataFrame, reducers: dict[str, Reducer] | None = None, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, metric, value): mean and deviation of each reducer over resamples of n draws with replacement.

    NaN samples are drawn as missing ones, and resamples without a number are left out.
    """
    chosen = reducers or REDUCERS
    ranked = _ranked(samples).withColumn("num", F.coalesce("num", F.lit(float("nan"))))

    def reduce(g: pd.Series, draws: np.ndarray) -> dict[str, np.ndarray]:
        x = np.asarray(g["num"], float)[draws]
        return {name: np.asarray(f(x), float) for name, f in chosen.items()}

    return _resampled(_gathered(ranked, "num"), reduce, list(chosen), lambda g: 0, n_boot, seed)


def bootstrap_best_worst(samples: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, metric, value): mean and deviation of the best and the worst of n draws with replacement."""
    return bootstrap(samples, REDUCERS, n_boot, seed)


def bootstrap_by_ranks(samples: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, metric, value) as of ``bootstrap_best_worst``, for groups that don't fit in one row.

    The best of n draws from a sorted group is at the place that one uniform number gives, as all n lie at or
    below a place with the n-th power of its share. So a resample is one number a side and one row that
    is looked up by its rank; ranks come from a range partitioning. Draws depend on the group's keys and n.
    """
    x = _numbers(samples).select(*KEYS, "sample_no", "num")
    facts = x.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count("num").alias("live"))
    draws = stash(facts, "groups").withColumn("n", F.explode(bootstrap_sizes(F.col("total")))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("side", F.explode(F.array(F.lit("best"), F.lit("worst"))))
    uniform = (F.pmod(F.xxhash64(*KEYS, "n", "b", "side", F.lit(seed)), F.lit(1 << 53)) + 1) / float(1 << 53)
    place = F.ceil(F.col("total") * F.pow(uniform, 1 / F.col("n"))) - (F.col("total") - F.col("live"))  # samples without a number lie before all others
    draws = draws.withColumn("place", place).filter(F.col("place") > 0).select(*KEYS, "n", "side", F.when(F.col("side") == "best", F.col("place") - 1).otherwise(F.col("live") - F.col("place")).cast("int").alias("rank"))
    times = draws.groupBy(*KEYS, "rank", "n", "side").agg(F.count("*").alias("times"))
    ranked = numbered(x.filter("num is not null"), list(KEYS), ["num", "sample_no"], "rank")
    met = beside(ranked, stash(times, "draws"), *KEYS, "rank")
    mean = stash(met.groupBy(*KEYS, "n", "side").agg((F.sum(F.col("num") * F.col("times")) / F.sum("times")).alias("m")), "means")
    spread = beside(met, mean, *KEYS, "n", "side").groupBy(*KEYS, "n", "side").agg(F.first("m").alias("mean"), F.sqrt(F.sum(F.col("times") * (F.col("num") - F.col("m")) * (F.col("num") - F.col("m"))) / F.sum("times")).alias("std"))
    name = lambda part: F.concat("side", F.lit("@"), "n", F.lit(f"/{part}")).alias("metric")
    return spread.select(*KEYS, name("mean"), F.col("mean").alias("value")).union(spread.select(*KEYS, name("std"), F.col("std").alias("value")))


def exact_best_worst(samples: DataFrame) -> DataFrame:
    """(keys, n, best, worst): the expectations that the bootstrap estimates, in closed form: over the
    resamples that hold a number at all, so NaN samples only make others rarer."""
    x = _ranked(samples)
    live = x.filter("num is not null")
    live = live.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("num", "sample_no"))).withColumn("odd", F.col("total") - F.count("*").over(Window.partitionBy(*KEYS)))
    live = live.withColumn("n", F.explode(bootstrap_sizes(F.col("total"))))
    at_most = lambda c: F.pow(c / F.col("total"), F.col("n"))
    some = 1 - at_most(F.col("odd"))
    up = (at_most(F.col("odd") + F.col("k")) - at_most(F.col("odd") + F.col("k") - 1)) / some
    down = (at_most(F.col("total") - F.col("k") + 1) - at_most(F.col("total") - F.col("k"))) / some
    return live.groupBy(*KEYS, "n").agg(F.sum(F.col("num") * up).alias("best"), F.sum(F.col("num") * down).alias("worst"))


def bootstrap_majority(samples: DataFrame, pred_var: str = "pred", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, metric, value): per resample the value of the most frequent prediction (of equally frequent
    ones, that drawn first) where it was drawn first; mean and deviation over resamples."""
    preds = samples.filter(F.col("var") == pred_var).select("data_source", "uid", "sample_no", F.col("str").alias("pred")).filter("pred is not null")
    ranked = _ranked(samples).join(preds, ["data_source", "uid", "sample_no"], "left").withColumn("num", F.coalesce("num", F.lit(float("nan"))))
    groups = _gathered(ranked, "num", "pred").filter(F.exists("pred", lambda p: p.isNotNull()))
    groups = groups.withColumn("kinds", F.array_compact(F.array_distinct("pred"))).withColumn("code", F.transform("pred", lambda p: F.coalesce(F.array_position("kinds", p), F.lit(0)) - 1))

    def reduce(g: pd.Series, draws: np.ndarray) -> dict[str, np.ndarray]:
        code, (b, n), kinds = np.asarray(g["code"], np.int64)[draws], draws.shape, len(g["kinds"])
        row = np.repeat(np.arange(b), n)
        at, voted = row * kinds + code.ravel(), code.ravel() >= 0
        votes = np.bincount(at[voted], minlength=b * kinds).reshape(b, kinds)
        first = np.full(b * kinds, n)
        np.minimum.at(first, at[voted], np.tile(np.arange(n), b)[voted])
        best = (votes * (n + 1) - first.reshape(b, kinds)).argmax(1)
        where = first.reshape(b, kinds)[np.arange(b), best]
        values = np.asarray(g["num"], float)[draws[np.arange(b), np.minimum(where, n - 1)]]
        return {"maj": np.where(where < n, values, np.nan)}

    return _resampled(groups.select(*KEYS, "num", "code", "kinds"), reduce, ["maj"], lambda g: len(g["kinds"]), n_boot, seed)


def rollup_by_source(stats: DataFrame) -> DataFrame:
    """(data_source, var, metric, value): the mean over uids of what was computed per uid."""
    return stats.groupBy("data_source", "var", "metric").agg(F.avg("value").alias("value"))


def label_metrics(rollup: DataFrame) -> DataFrame:
    """Adds section and key. The core variable is acc where a source has it, else reward; its mean, maj
    and best at the largest n are val-core, all else val-aux."""
    w = Window.partitionBy("data_source")
    n = F.regexp_extract("metric", r"@(\d+)", 1).try_cast("int")
    x = rollup.withColumn("__acc", F.max((F.col("var") == "acc").cast("int")).over(w)).withColumn("__n", n)
    x = x.withColumn("__most", F.max("__n").over(Window.partitionBy("data_source", "var")))
    core = F.col("var") == F.when(F.col("__acc") == 1, "acc").otherwise("reward")
    core = core & F.col("metric").rlike("^(mean|maj|best)") & (F.col("__n") == F.col("__most"))
    x = x.withColumn("section", F.when(core, "val-core").otherwise("val-aux"))
    return x.withColumn("key", F.concat_ws("/", "section", "data_source", "var", "metric")).drop("__acc", "__n", "__most")


# -- training metrics ------------------------------------------------------------------


def _melt(row: DataFrame) -> DataFrame:
    """A one-row frame as (metric, value)."""
    names = F.array(*(F.lit(c) for c in row.columns))
    return row.select(F.explode(F.map_from_arrays(names, F.array(*(F.col(f"`{c}`").cast("double") for c in row.columns)))).alias("metric", "value"))


def _three(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}/mean"), F.max(c).alias(f"{name}/max"), F.min(c).alias(f"{name}/min")]


def data_metrics(steps: DataFrame, max_response_len: int, max_prompt_len: int) -> DataFrame:
    """(metric, value) over all steps. Columns used where present: score, reward_score, advantage, returns,
    value (per step, weighted by response tokens), num_turns, tool_calls.

    One pass with partial aggregation; token statistics weight a step by its response tokens. Clip
    ratios are the shares of rows as long as is allowed. It is an error if no row has a response.
    """
    x = steps.withColumn("__r", response_length()).withColumn("__p", F.size("prompt_ids"))
    live = F.col("__r") > 0
    full = (F.col("__r") == max_response_len).cast("double")
    out: list[Column] = []
    for c, name in (("score", "critic/score"), ("reward_score", "critic/rewards")):
        if c in steps.columns:
            out += _three(F.when(live, F.col(c)), name)
    for c, name in (("advantage", "critic/advantages"), ("returns", "critic/returns"), ("value", "critic/values")):
        if c in steps.columns:
            v = F.when(live, F.col(c))
            out += [(F.sum(v * F.col("__r")) / F.sum(F.when(v.isNotNull(), F.col("__r")))).alias(f"{name}/mean"), F.max(v).alias(f"{name}/max"), F.min(v).alias(f"{name}/min")]
    out += [*_three(F.col("__r"), "response_length"), F.avg(full).alias("response_length/clip_ratio")]
    out += [*_three(F.when(live, F.col("__r")), "response_length_non_aborted"), F.avg(F.when(live, full)).alias("response_length_non_aborted/clip_ratio")]
    none = F.when(F.coalesce(F.max(live.cast("int")), F.lit(0)) == 0, F.raise_error(F.lit("all rows were aborted")).cast("double"))
    out += [none.otherwise(F.avg((~live).cast("double"))).alias("response/aborted_ratio")]
    out += [*_three(F.col("__p"), "prompt_length"), F.avg((F.col("__p") == max_prompt_len).cast("double")).alias("prompt_length/clip_ratio")]
    if "num_turns" in steps.columns:
        out += _three(F.col("num_turns"), "num_turns")
    if "tool_calls" in steps.columns:
        out += _three(F.coalesce(F.size("tool_calls"), F.lit(0)), "tool_call_counts")
    return _melt(x.agg(*out))


def explained_variance(steps: DataFrame) -> DataFrame:
    """(metric, value): 1 - var(returns - value) / (var(returns) + 1e-5) over response tokens."""
    x = steps.select(response_length().alias("k"), (F.col("returns") - F.col("value")).alias("e"), F.col("returns").alias("r")).filter("k > 0")
    n, me, mr = x.agg(F.sum("k"), F.sum(F.col("k") * F.col("e")) / F.sum("k"), F.sum(F.col("k") * F.col("r")) / F.sum("k")).first()
    var = lambda c, m: F.try_divide(F.sum(F.col("k") * (F.col(c) - F.lit(m)) ** 2), F.lit((n or 1) - 1))
    return _melt(x.agg((1 - var("e", me) / (var("r", mr) + 1e-5)).alias("critic/vf_explained_var")))


def response_info(steps: DataFrame) -> DataFrame:
    return steps.withColumn("prompt_length", F.size("prompt_ids")).withColumn("response_length", response_length())


def timing_metrics(stage_times: DataFrame, steps: DataFrame) -> DataFrame:
    """(metric, value): seconds per stage, and milliseconds per token: of response tokens for gen, of all
    tokens for ref, values, adv, update_critic and update_actor."""
    response, every = response_info(steps).agg(F.sum("response_length"), F.sum(F.col("response_length") + F.col("prompt_length"))).first()
    x = stage_times
    per = F.when(F.col("stage") == "gen", F.lit(response)).when(F.col("stage").isin("ref", "values", "adv", "update_critic", "update_actor"), F.lit(every))
    a = x.select(F.concat(F.lit("timing_s/"), "stage").alias("metric"), F.col("seconds").alias("value"))
    b = x.select(F.concat(F.lit("timing_per_token_ms/"), "stage").alias("metric"), F.try_divide(F.col("seconds") * 1000, per).alias("value")).filter("value is not null")
    return a.unionByName(b)


def throughput(steps: DataFrame, seconds: float, n_workers: int) -> DataFrame:
    total = response_info(steps).agg(F.sum(F.col("response_length") + F.col("prompt_length")).cast("double").alias("t"))
    return _melt(total.select(F.col("t").alias("perf/total_num_tokens"), F.lit(float(seconds)).alias("perf/time_per_step"), (F.col("t") / (seconds * n_workers)).alias("perf/throughput")))


def reduce_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("metric").agg(F.avg("value").alias("value"))


def shared_stages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stage names that both frames have."""
    return a.select("stage").intersect(b.select("stage"))


def sample_generations(df: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """n rows by a seeded hash of the input (of equal inputs by ``keys``), whatever the order of rows."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.coalesce("input", F.lit("")))), "input", *keys).limit(n)
