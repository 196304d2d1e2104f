"""Forecast scores: alignment by position, errors, and the parts of the total score.

Predictions and truths are long rows (series_id, pos, value). The parts of the total score work on
a pair of arrays per answer, so an answer and its truth meet once and nothing is shuffled after.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.sources.series_text import answer_values


def align_forecast(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(series_id, pos, pred, truth, n_pred, n_truth): the common prefix, with both full lengths."""
    w = Window.partitionBy("series_id")
    p = pred.select("series_id", "pos", F.col("value").alias("pred"), F.count("*").over(w).alias("n_pred"))
    t = truth.select("series_id", "pos", F.col("value").alias("truth"), F.count("*").over(w).alias("n_truth"))
    return p.join(t, ["series_id", "pos"])


def normalize_pair(aligned: DataFrame) -> DataFrame:
    """Adds z_pred and z_truth, by the mean and population deviation of the aligned truth."""
    w = Window.partitionBy("series_id")
    mean, sd = F.avg("truth").over(w), F.greatest(F.stddev_pop("truth").over(w), F.lit(1e-8))
    out = aligned.withColumn("__m", mean).withColumn("__s", sd)
    return out.withColumn("z_pred", (F.col("pred") - F.col("__m")) / F.col("__s")).withColumn("z_truth", (F.col("truth") - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def errors(aligned: DataFrame) -> DataFrame:
    """(series_id, mse, mae) on the scale of the data."""
    d = F.col("pred") - F.col("truth")
    return aligned.groupBy("series_id").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def format_score(text: Column) -> Column:
    return F.when(text.rlike("(?s)<answer>.*?</answer>"), 0.0).otherwise(-1.0)


def _share() -> Column:
    return F.coalesce(F.least(F.try_divide(F.col("n_pred"), F.col("n_truth")), F.lit(1.0)), F.lit(0.0))


def lengths(pred: DataFrame, truth: DataFrame) -> DataFrame:
    p = pred.groupBy("series_id").agg(F.count("*").alias("n_pred"))
    t = truth.groupBy("series_id").agg(F.count("*").alias("n_truth"))
    return t.join(p, "series_id", "full_outer").select("series_id", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_truth", F.lit(0)).alias("n_truth"))


def length_score(n_pred: Column, n_truth: Column) -> Column:
    return F.when(n_truth == 0, 0.0).when(n_pred >= n_truth, 0.1).otherwise(0.1 * n_pred / n_truth)


def damped(m: Column) -> Column:
    return 1.0 / (1.0 + F.log1p(m))


# -- arrays: p and t are the aligned values of a prediction and its truth -----------------


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean_square(a: Column, b: Column) -> Column:
    return F.try_divide(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.size(a))


def _gathered(aligned: DataFrame) -> DataFrame:
    """(series_id, p, t, n_pred, n_truth): aligned rows as arrays."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "pred", "truth")))
    g = aligned.groupBy("series_id").agg(rows.alias("__r"), F.first("n_pred").alias("n_pred"), F.first("n_truth").alias("n_truth"))
    return g.select("series_id", F.col("__r.pred").alias("p"), F.col("__r.truth").alias("t"), "n_pred", "n_truth")


def _with_z(pairs: DataFrame) -> DataFrame:
    """Adds zp and zt: both by the mean and population deviation of t."""
    x = pairs.withColumn("__m", F.try_divide(_sum(F.col("t")), F.size("t")))
    x = x.withColumn("__s", F.greatest(F.sqrt(F.try_divide(F.aggregate("t", F.lit(0.0), lambda a, v: a + (v - F.col("__m")) * (v - F.col("__m"))), F.size("t"))), F.lit(1e-8)))
    z = lambda c: F.transform(c, lambda v: (v - F.col("__m")) / F.col("__s"))
    return x.withColumn("zp", z("p")).withColumn("zt", z("t")).drop("__m", "__s")


def _half(n: Column) -> Column:
    """Half the width of the moving mean: the width is min(25, n // 2), at least 3 and odd."""
    k = F.greatest(F.lit(3), F.least(F.lit(25), F.floor(n / 2)))
    return F.floor((k + F.when(k % 2 == 0, 1).otherwise(0)) / 2).cast("int")


def _trend(x: Column, half: Column) -> Column:
    """Centred moving mean, with the end values repeated outside."""
    padded = F.concat(F.array_repeat(F.get(x, F.lit(0)), half), x, F.array_repeat(F.element_at(x, -1), half))
    return F.transform(x, lambda _, i: _sum(F.slice(padded, i + 1, 2 * half + 1)) / (2 * half + 1))


def _extrema(x: Column, at_least: bool) -> Column:
    """Positions not below (or not above) their two neighbours on both sides, of five points or more.

    In front the series is mirrored; behind, its last two points are repeated.
    """
    padded = F.concat(F.array(F.get(x, F.lit(2)), F.get(x, F.lit(1))), x, F.slice(x, -2, 2))
    beyond = (lambda v, o: v >= o) if at_least else (lambda v, o: v <= o)
    found = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.forall(F.slice(padded, i + 1, 5), lambda o: beyond(F.get(x, i), o)))
    return F.when(F.size(x) >= 5, found).otherwise(F.array().cast("array<int>"))


def _hits(p: Column, g: Column, tolerance: int) -> Column:
    """How many of the points p find a free one of g within the tolerance, in ascending order, the first one each."""

    def take(free: Column, point: Column) -> Column:
        first = F.get(F.filter(free["left"], lambda x: F.abs(x - point) <= tolerance), F.lit(0))
        return F.when(first.isNull(), free).otherwise(F.struct(F.filter(free["left"], lambda x: x != first).alias("left"), (free["hits"] + 1).alias("hits")))

    start = F.struct(g.cast("array<int>").alias("left"), F.lit(0).alias("hits"))
    return F.aggregate(F.coalesce(p.cast("array<int>"), F.array().cast("array<int>")), start, take, lambda acc: acc["hits"])


def _scored_parts(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Adds mse_score, extrema_score and season_trend_score to rows with p, t, n_pred and n_truth.

    Without aligned points all are 0, with fewer than five only the first is not.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = _with_z(pairs).withColumn("__h", _half(F.size("t")))
    x = x.withColumn("mse_score", zero(0.6 * damped(_mean_square(F.col("zp"), F.col("zt"))) * _share()))
    x = x.withColumn("__tp", _trend(F.col("zp"), F.col("__h"))).withColumn("__tt", _trend(F.col("zt"), F.col("__h")))
    season = lambda z, trend: F.zip_with(z, trend, lambda v, m: v - m)
    ms, mt = _mean_square(season("zp", "__tp"), season("zt", "__tt")), _mean_square(F.col("__tp"), F.col("__tt"))
    x = x.withColumn("season_trend_score", F.when(F.size("t") < 5, 0.0).otherwise(zero((0.05 * damped(ms) + 0.15 * damped(mt)) * _share())))
    parts = []
    for kind in (True, False):
        x = x.withColumn(f"__g{kind}", _extrema(F.col("t"), kind))
        parts.append(zero(F.try_divide(_hits(_extrema(F.col("p"), kind), F.col(f"__g{kind}"), tolerance), F.size(f"__g{kind}")) * 0.1))
    x = x.withColumn("extrema_score", (parts[0] + parts[1]) * _share())
    return x.drop("zp", "zt", "__h", "__tp", "__tt", "__gTrue", "__gFalse")


def mse_score(aligned: DataFrame) -> DataFrame:
    """(series_id, mse_score); series without aligned points have no row."""
    return _scored_parts(_gathered(aligned)).select("series_id", "mse_score")


def decompose(df: DataFrame, column: str) -> DataFrame:
    """Adds trend and season of ``column``: a centred moving mean whose window is min(25, n // 2),
    at least 3 and odd, with the end values repeated outside. A NaN is felt within its windows alone."""
    w = Window.partitionBy("series_id")
    near = F.collect_list(F.struct(F.col(column).alias("v"))).over(w.orderBy("pos").rowsBetween(-12, 12))
    x = df.withColumn("__n", F.count("*").over(w)).withColumn("__first", F.min_by(column, "pos").over(w)).withColumn("__last", F.max_by(column, "pos").over(w))
    x = x.withColumn("__h", _half(F.col("__n"))).withColumn("__near", near)
    low, high = F.greatest(F.col("pos") - F.col("__h"), F.lit(0)), F.least(F.col("pos") + F.col("__h"), F.col("__n") - 1)
    inner = F.slice(F.col("__near.v"), (F.least(F.col("pos"), F.lit(12)) - (F.col("pos") - low) + 1).cast("int"), (high - low + 1).cast("int"))
    total = _sum(inner) + F.greatest(F.lit(0), F.col("__h") - F.col("pos")) * F.col("__first") + F.greatest(F.lit(0), F.col("pos") + F.col("__h") - F.col("__n") + 1) * F.col("__last")
    x = x.withColumn("trend", total / (2 * F.col("__h") + 1))
    return x.withColumn("season", F.col(column) - F.col("trend")).drop("__n", "__first", "__last", "__h", "__near")


def season_trend_score(aligned: DataFrame) -> DataFrame:
    """(series_id, season_trend_score); 0 where fewer than five points are aligned."""
    return _scored_parts(_gathered(aligned)).select("series_id", "season_trend_score")


def find_extrema(df: DataFrame, column: str = "value") -> DataFrame:
    """(series_id, pos, is_max, is_min): points not below (not above) their two neighbours on both
    sides. In front the series is mirrored; behind, its last two points are repeated."""
    o = Window.partitionBy("series_id").orderBy("pos")
    w = Window.partitionBy("series_id")
    x = df.select("series_id", "pos", F.col(column).alias("v"), F.count("*").over(w).alias("n"))
    x = x.withColumns({f"l{k}": F.lag("v", k).over(o) for k in (1, 2)} | {f"r{k}": F.lead("v", k).over(o) for k in (1, 2)})
    x = x.withColumn("s1", F.max(F.when(F.col("pos") == 1, F.col("v"))).over(w)).withColumn("s2", F.max(F.when(F.col("pos") == 2, F.col("v"))).over(w))
    last, second = F.col("n") - 1, F.col("n") - 2
    e1, e2 = F.max(F.when(F.col("pos") == second, F.col("v"))).over(w), F.max(F.when(F.col("pos") == last, F.col("v"))).over(w)
    x = x.withColumn("e1", e1).withColumn("e2", e2).filter("n >= 5")
    # in front of point 0 are points 2 and 1; behind the last point come the last but one and the last
    left1 = F.when(F.col("pos") == 0, F.col("s1")).otherwise(F.col("l1"))
    left2 = F.when(F.col("pos") == 0, F.col("s2")).when(F.col("pos") == 1, F.col("s1")).otherwise(F.col("l2"))
    right1 = F.when(F.col("pos") == last, F.col("e1")).otherwise(F.col("r1"))
    right2 = F.when(F.col("pos") == last, F.col("e2")).when(F.col("pos") == second, F.col("e1")).otherwise(F.col("r2"))
    sides = [left1, left2, right1, right2]
    up = F.lit(True)
    down = F.lit(True)
    for s in sides:
        up, down = up & (F.col("v") >= s), down & (F.col("v") <= s)
    return x.select("series_id", "pos", up.alias("is_max"), down.alias("is_min"))


def match_extrema(pred_points: DataFrame, truth_points: DataFrame, tolerance: int = 2) -> DataFrame:
    """(series_id, hits, n_truth): greedy one-to-one matching in ascending order, each predicted point
    with the first free truth point within the tolerance. Points: (series_id, pos)."""
    gather = lambda df, name: df.groupBy("series_id").agg(F.array_sort(F.collect_list("pos")).alias(name))
    both = gather(truth_points, "g").join(gather(pred_points, "p"), "series_id", "left")
    return both.select("series_id", _hits(F.col("p"), F.col("g"), tolerance).alias("hits"), F.size("g").alias("n_truth"))


def extrema_score(aligned: DataFrame, tolerance: int = 2) -> DataFrame:
    """(series_id, extrema_score)."""
    return _scored_parts(_gathered(aligned), tolerance).select("series_id", "extrema_score")


PARTS = ("length_score", "mse_score", "extrema_score", "season_trend_score")


def _totals(both: DataFrame) -> DataFrame:
    """Adds format_score, the parts and total_score to rows with answer_text and truth_text."""
    x = both.withColumn("__p", answer_values(F.col("answer_text"))).withColumn("__t", answer_values(F.coalesce("truth_text", F.lit(""))))
    x = x.withColumn("n_pred", F.coalesce(F.size("__p"), F.lit(0))).withColumn("n_truth", F.coalesce(F.size("__t"), F.lit(0)))
    n = F.least("n_pred", "n_truth")
    x = _scored_parts(x.withColumn("p", F.slice(F.coalesce("__p", F.array().cast("array<double>")), F.lit(1), n)).withColumn("t", F.slice("__t", F.lit(1), n)))
    x = x.withColumn("format_score", format_score(F.col("answer_text"))).withColumn("length_score", length_score(F.col("n_pred"), F.col("n_truth")))
    total = F.col("format_score")
    for part in PARTS:
        total = total + F.col(part)
    return x.withColumn("total_score", F.when(F.col("format_score") < 0, F.col("format_score")).otherwise(total)).drop("__p", "__t", "p", "t", "n_pred", "n_truth")


def total_score(answers: DataFrame, truths: DataFrame, answer_col: str = "answer_text", truth_col: str = "truth_text") -> DataFrame:
    """(series_id, format, length, mse, extrema, season_trend, total), a row per answer; -1 as total for a missing
    answer tag. ``truths`` has a row per series."""
    both = answers.select("series_id", F.col(answer_col).alias("answer_text")).join(truths.select("series_id", F.col(truth_col).alias("truth_text")), "series_id", "left")
    return _totals(both).select("series_id", "format_score", *PARTS, "total_score")


def final_reward(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """(series_id, reward): 0 without truth, -0.5 where scoring fails, else the total score of the answer
    wrapped in tags anew."""
    wrapped = answers.select("series_id", F.concat(F.lit("<answer>\n"), F.coalesce("answer_text", F.lit("")), F.lit("\n</answer>")).alias("answer_text"))
    scored = _totals(wrapped.join(truths.select("series_id", "truth_text"), "series_id", "left"))
    value = F.when(F.coalesce("truth_text", F.lit("")) == "", 0.0).when(F.isnan("total_score") | F.col("total_score").isNull(), -0.5).otherwise(F.col("total_score"))
    return scored.select("series_id", value.alias("reward"))


def custom_reward(df: DataFrame, reward: Callable[[str, str, str, str | None], float], source_col: str = "data_source", solution_col: str = "answer_text", truth_col: str = "truth_text", extra_col: str | None = None) -> DataFrame:
    """Adds reward from a user's function (data_source, solution, truth, extra), in Arrow batches.

    ``extra`` is None without ``extra_col``; structs and maps reach the function as JSON text.
    """
    extra = F.lit(None).cast("string") if extra_col is None else F.col(extra_col)
    if extra_col and isinstance(df.schema[extra_col].dataType, (T.StructType, T.MapType)):
        extra = F.to_json(extra)

    @F.pandas_udf("double")
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([float(reward(a, b, c, None if d is None else d)) for a, b, c, d in zip(source, solution, truth, more, strict=True)])

    return df.withColumn("reward", run(source_col, solution_col, truth_col, extra))


def detect_input_copy(answers: DataFrame, series: DataFrame, threshold: float = 0.5, text_col: str = "answer_text") -> DataFrame:
    """(series_id, share, is_copy): the share of the answer's line-start stamps that the input has.

    ``series``: (series_id, ts_str). False where either side has no stamps.
    """
    lines = answers.select("series_id", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    stamp = F.regexp_extract("line", r"^\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    stamps = lines.select("series_id", stamp.alias("ts_str")).filter("ts_str <> ''")
    known = series.select("series_id", "ts_str").filter("ts_str is not null").distinct().withColumn("hit", F.lit(1.0))
    some = known.groupBy("series_id").agg(F.max("hit").alias("some"))
    share = stamps.join(known, ["series_id", "ts_str"], "left").groupBy("series_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    out = answers.select("series_id").distinct().join(share, "series_id", "left").join(some, "series_id", "left")
    kept = F.when(F.col("some").isNotNull(), F.col("share"))
    return out.select("series_id", F.coalesce(kept, F.lit(0.0)).alias("share"), F.coalesce(kept > threshold, F.lit(False)).alias("is_copy"))
