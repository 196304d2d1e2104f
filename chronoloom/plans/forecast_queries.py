"""Registered queries over series texts, windows, forecasts and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import forecasts as fo
from chronoloom.operators import rows
from chronoloom.operators import scoring as sc
from chronoloom.plans import bindings as b
from chronoloom.plans.bindings import with_sql
from chronoloom.plans.feature_queries import r
from chronoloom.sources import series_text as st
from chronoloom.sources import sinks
from chronoloom.sources.storage import scratch_path


def a01_read_rollouts(spark, sf_dir):
    words = F.size(F.split("text", " "))
    return st.read_rollouts(spark, f"{sf_dir}/conversations.parquet", 50, 60, ("conv_id", "turn"), words)


def a02_parse_series_text(spark, sf_dir):
    return st.parse_series_text(b.series_text(spark, sf_dir, "partial"))


def _built(spark, sf_dir, case):
    return st.build_series(st.parse_series_text(b.series_text(spark, sf_dir, case)))


def a03_build_series_full(spark, sf_dir):
    return _built(spark, sf_dir, "full")


def a03_build_series_partial(spark, sf_dir):
    return _built(spark, sf_dir, "partial")


def a03_build_series_none(spark, sf_dir):
    return _built(spark, sf_dir, "none")


def a03_build_series_anchor(spark, sf_dir):
    return _built(spark, sf_dir, "anchor")


def a04_parse_answer_values(spark, sf_dir):
    return st.parse_answer_values(b.answers(spark, sf_dir), text_col="answer_text")


def a05_format_forecast_text(spark, sf_dir):
    return sinks.format_forecast_text(fo.forecast_seasonal_naive(b.contexts(spark, sf_dir), 24))


def a06_write_generations(spark, sf_dir):
    both = b.answers(spark, sf_dir).join(b.truths(spark, sf_dir), "series_id")
    out = both.select(F.col("series_id").alias("input"), F.col("answer_text").alias("output"), F.col("truth_text").alias("gts"), F.length("answer_text").cast("double").alias("score"), (F.split("series_id", "#")[1].cast("int") % 5).alias("step"))
    path = scratch_path(spark, "generations")
    sinks.write_generations(out, path)
    return spark.read.schema("input string, output string, gts string, score double, step int").json(path).select("input", "output", "gts", "score", "step")


def a07_append_io_log(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "io-log")
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    for some in (user, ~user, F.lit(False)):
        sinks.append_io_log(c.filter(some), path)
    return spark.read.schema("conv_id bigint, turn bigint, role string, text string").json(path)


def b01_extract_answer(spark, sf_dir):
    both = rows.extract_answer(b.answers(spark, sf_dir), "answer_text").withColumnRenamed("answer", "lenient")
    return rows.extract_answer(both, "answer_text", strict=True).select("series_id", "lenient", F.col("answer").alias("strict"))


def b02_resolve_value_column(spark, sf_dir):
    f = fo.forecast_naive(b.contexts(spark, sf_dir), 24).withColumnRenamed("yhat", "target_0.5")
    return f.select("series_id", "step", F.col(rows.resolve_value_column(f)).alias("value"))


def b03_truncate_history(spark, sf_dir):
    return rows.truncate_history(b.series_text(spark, sf_dir, "full"))


def b11_validate_series_request(spark, sf_dir):
    x = b.series_user(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list("pos")).alias("timestamps"), F.collect_list("value").alias("values"))
    k = F.col("series_id").cast("int") % 3
    cut = x.withColumn("values", F.when(k == 0, F.slice("values", 1, 5)).when(k == 1, F.slice("values", 1, 1)).otherwise(F.col("values"))).withColumn("timestamps", F.when(k == 1, F.slice("timestamps", 1, 1)).otherwise(F.col("timestamps")))
    return rows.validate_series_request(cut).select("series_id", F.size("values").alias("n"), "reason")


def b12_sanitize(spark, sf_dir):
    x = b.series_user(spark, sf_dir)
    odd = F.when(F.col("pos") % 5 == 0, float("nan")).when(F.col("pos") % 5 == 1, float("inf")).when(F.col("pos") % 5 == 2, None).otherwise(F.col("value"))
    return rows.sanitize(x.withColumn("value", odd), ["series_id", "value"]).select("series_id", "pos", "value")


def b13_render_prompt(spark, sf_dir):
    k = F.col("series_id").cast("int") % 3
    analysis = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("flat"), F.lit("calm")))
    state = b.series_text(spark, sf_dir, "full").select("series_id", F.lit(168).alias("lookback"), F.lit(24).alias("horizon"), F.col("text").alias("history"), analysis.alias("analysis"), F.when(k == 2, "1.000").alias("prediction"))
    return rows.render_prompt(state)


def b14_turn_info(spark, sf_dir):
    k = F.col("series_id").cast("int") % 3
    info = rows.turn_info(k >= 1, k >= 2)
    return b.series_user(spark, sf_dir).select("series_id").distinct().select("series_id", info["turn"].alias("turn"), info["action"].alias("action"))


def e01_infer_frequency(spark, sf_dir):
    return st.frequencies(st.parsed_times(st.parse_series_text(b.series_text(spark, sf_dir, "partial"))))


def e02_last_timestamp(spark, sf_dir):
    return st.last_timestamp(st.parse_series_text(b.series_text(spark, sf_dir, "partial")))


def e03_extend_timestamps(spark, sf_dir):
    s = b.series_user(spark, sf_dir)
    return fo.extend_timestamps(s, 3).withColumn("rule", F.lit("first")).unionByName(fo.extend_timestamps(s, 3, "last").withColumn("rule", F.lit("last")))


def e04_make_windows(spark, sf_dir):
    return b.windows_hour(spark, sf_dir).select("series_id", F.col("window").alias("window_no"), "part", "pos", "ts", "value")


def e05_instance_normalize(spark, sf_dir):
    x = fo.instance_normalize(b.series_user(spark, sf_dir))
    back = fo.denormalize(x.withColumnRenamed("value", "was"))
    return back.select("series_id", "pos", r("norm"), r("value"))


def e06_make_patches(spark, sf_dir):
    p = fo.make_patches(fo.value_arrays(b.series_user(spark, sf_dir)))
    return p.select("series_id", "patch_no", F.size("patch").alias("n"), r(F.aggregate("patch", F.lit(0.0), lambda a, v: a + v)).alias("total"), F.get("patch", F.lit(0)).alias("first_value"))


def e07_median_quantile(spark, sf_dir):
    """Quantiles of each hour of the day over the days of a context; the middle one is the forecast."""
    day = b.contexts(spark, sf_dir).groupBy("series_id", (F.col("pos") % 24).alias("step")).agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("quantiles"))
    return fo.median_quantile(day).select("series_id", "step", r("yhat"))


def e07_sample_median(spark, sf_dir):
    paths = b.contexts(spark, sf_dir).select("series_id", (F.floor(F.col("pos") / 24)).cast("int").alias("sample"), (F.col("pos") % 24).alias("step"), "value")
    return fo.sample_median(paths).select("series_id", "step", r("yhat"))


def e08_fit_length(spark, sf_dir):
    f = fo.forecast_naive(b.contexts(spark, sf_dir), 24)
    odd = f.filter(~((F.col("step") >= 10) & F.col("series_id").like("%#%0")))
    return fo.fit_length(odd, 18)


def e09_forecast_naive(spark, sf_dir):
    return fo.forecast_naive(b.contexts(spark, sf_dir), 24)


def e09_forecast_seasonal_naive(spark, sf_dir):
    return fo.forecast_seasonal_naive(b.contexts(spark, sf_dir), 48)


def e10_stationarity_order(spark, sf_dir):
    return fo.stationarity_order(b.contexts(spark, sf_dir))


def e11_forecast_arima(spark, sf_dir):
    return fo.forecast_arima(b.contexts(spark, sf_dir), 24)


def e12_forecast_with_factory(spark, sf_dir):
    """The same by a model that each worker makes once."""
    factory = fo.ModelFactory("seasonal", lambda _: fo.MODELS["seasonal_naive"])
    return fo.forecast_with_model(b.contexts(spark, sf_dir), "seasonal_naive", 48, {"seasonal_naive": factory})


def e12_forecast_with_model(spark, sf_dir):
    return fo.forecast_with_model(b.contexts(spark, sf_dir), "seasonal_naive", 48)


def _aligned(spark, sf_dir):
    pred = st.parse_answer_values(b.answers(spark, sf_dir), text_col="answer_text")
    truth = st.parse_answer_values(b.truths(spark, sf_dir), text_col="truth_text")
    return sc.align_forecast(pred, truth)


def c01_align_forecast(spark, sf_dir):
    return _aligned(spark, sf_dir)


def c02_detect_input_copy(spark, sf_dir):
    known = b.contexts(spark, sf_dir).select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_str"))
    return sc.detect_input_copy(b.answers(spark, sf_dir), known).select("series_id", r("share"), "is_copy")


def c03_match_extrema(spark, sf_dir):
    a = _aligned(spark, sf_dir)
    points = lambda c: sc.find_extrema(a.withColumn("value", F.col(c))).filter("is_max").select("series_id", "pos")
    return sc.match_extrema(points("pred"), points("truth"))


def f01_normalize_pair(spark, sf_dir):
    return sc.normalize_pair(_aligned(spark, sf_dir)).select("series_id", "pos", r("z_pred"), r("z_truth"))


def f02_errors(spark, sf_dir):
    return sc.errors(_aligned(spark, sf_dir)).select("series_id", r("mse"), r("mae"))


def f03_f04_format_and_length(spark, sf_dir):
    a, t = b.answers(spark, sf_dir), b.truths(spark, sf_dir)
    n = sc.lengths(st.parse_answer_values(a, text_col="answer_text"), st.parse_answer_values(t, text_col="truth_text"))
    return a.join(n, "series_id").select("series_id", sc.format_score(F.col("answer_text")).alias("format_score"), r(sc.length_score(F.col("n_pred"), F.col("n_truth"))).alias("length_score"))


def f05_mse_score(spark, sf_dir):
    return sc.mse_score(_aligned(spark, sf_dir)).select("series_id", r("mse_score"))


def f06_decompose(spark, sf_dir):
    return sc.decompose(b.series_user(spark, sf_dir), "value").select("series_id", "pos", r("trend", 4), r("season", 4))


def f07_season_trend_score(spark, sf_dir):
    return sc.season_trend_score(_aligned(spark, sf_dir)).select("series_id", r("season_trend_score", 4))


def f08_find_extrema(spark, sf_dir):
    return sc.find_extrema(b.series_user(spark, sf_dir))


def f09_extrema_score(spark, sf_dir):
    return sc.extrema_score(_aligned(spark, sf_dir)).select("series_id", r("extrema_score"))


def f10_total_score(spark, sf_dir):
    t = sc.total_score(b.answers(spark, sf_dir), b.truths(spark, sf_dir))
    return t.select("series_id", "format_score", *(r(c, 4) for c in t.columns if c not in ("series_id", "format_score")))


def f11_final_reward(spark, sf_dir):
    t = b.truths(spark, sf_dir).withColumn("truth_text", F.when(~F.col("series_id").like("error#%"), F.col("truth_text")))
    return sc.final_reward(b.answers(spark, sf_dir), t).select("series_id", r("reward", 4))


def j02_custom_reward(spark, sf_dir):
    both = b.answers(spark, sf_dir).join(b.truths(spark, sf_dir), "series_id").withColumn("data_source", F.split("series_id", "#")[0]).withColumn("extra", F.split("series_id", "#")[1])
    return sc.custom_reward(both, lambda source, solution, truth, extra: len(solution) - len(truth) + len(source) + int(extra), extra_col="extra").select("series_id", "reward")


QUERIES = {
    f.__name__: f
    for f in (
        a01_read_rollouts, a02_parse_series_text, a03_build_series_full, a03_build_series_partial, a03_build_series_none, a03_build_series_anchor, a04_parse_answer_values, a05_format_forecast_text, a06_write_generations,
        a07_append_io_log, b01_extract_answer, b02_resolve_value_column, b03_truncate_history, b11_validate_series_request, b12_sanitize, b13_render_prompt, b14_turn_info, c01_align_forecast, c02_detect_input_copy, c03_match_extrema,
        e01_infer_frequency, e02_last_timestamp, e03_extend_timestamps, e04_make_windows, e05_instance_normalize, e06_make_patches, e07_median_quantile, e07_sample_median, e08_fit_length, e09_forecast_naive, e09_forecast_seasonal_naive,
        e10_stationarity_order, e11_forecast_arima, e12_forecast_with_factory, e12_forecast_with_model, f01_normalize_pair, f02_errors, f03_f04_format_and_length, f05_mse_score, f06_decompose, f07_season_trend_score, f08_find_extrema, f09_extrema_score,
        f10_total_score, f11_final_reward, j02_custom_reward,
    )
}

_U = with_sql("series_user")
_W = with_sql("series_hour", "windows")
_T = with_sql("series_hour", "windows", "texts")
_P = """
pk AS (SELECT series_id, pos, CASE WHEN pos % 7 = 3 THEN NULL ELSE date_trunc('second', ts) END AS ts, value FROM series_user),
gaps AS (SELECT series_id, pos, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY pos), ts) AS gap FROM pk WHERE ts IS NOT NULL),
freq AS (SELECT series_id, arg_min(gap, (-n, f)) AS gap FROM (SELECT series_id, gap, count(*) AS n, min(pos) AS f FROM gaps WHERE gap > 0 GROUP BY 1, 2) GROUP BY 1)"""
_BODY = r"CASE WHEN regexp_matches(answer_text, '(?s)<answer>.*?</answer>') THEN trim(regexp_extract(answer_text, '(?s)<answer>(.*?)</answer>', 1), chr(10) || ' ') ELSE answer_text END"
_VALUES = rf"""
av AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS pos, v AS value FROM (
  SELECT series_id, i, TRY_CAST(coalesce(nullif(regexp_extract(line, '\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+(-?\d+\.?\d*)', 1), ''), nullif(regexp_extract(line, '\|\s*\d+\s*\|\s*(-?\d+\.?\d*)\s*\|', 1), ''),
      nullif(regexp_extract(line, '(-?\d+\.?\d*)\s*$', 1), '')) AS DOUBLE) AS v
  FROM (SELECT series_id, unnest(string_split({_BODY}, chr(10))) AS line, generate_subscripts(string_split({_BODY}, chr(10)), 1) AS i FROM answers)) WHERE v IS NOT NULL),
aligned AS (SELECT a.series_id, a.pos, a.value AS pred, t.value AS truth, np AS n_pred, nt AS n_truth FROM av a JOIN tgt t ON a.series_id = t.series_id AND a.pos = t.pos
  JOIN (SELECT series_id, count(*) AS np FROM av GROUP BY 1) x ON x.series_id = a.series_id JOIN (SELECT series_id, count(*) AS nt FROM tgt GROUP BY 1) y ON y.series_id = a.series_id),
zp AS (SELECT *, (pred - m) / s AS z_pred, (truth - m) / s AS z_truth FROM (SELECT *, avg(truth) OVER w AS m, greatest(stddev_pop(truth) OVER w, 1e-8) AS s FROM aligned WINDOW w AS (PARTITION BY series_id))),
msc AS (SELECT series_id, 0.6 / (1 + ln(1 + avg((z_pred - z_truth) ** 2))) * least(any_value(n_pred) / any_value(n_truth), 1) AS mse_score FROM zp GROUP BY 1)"""


def _extrema(source: str, column: str, name: str) -> str:
    """Neighbours by joining the padded series with itself."""
    return f"""
{name}n AS (SELECT series_id, count(*) AS n FROM {source} GROUP BY 1),
{name}p AS (SELECT series_id, pos, {column} AS v FROM {source} UNION ALL SELECT series_id, CASE pos WHEN 2 THEN -2 ELSE -1 END, {column} FROM {source} WHERE pos IN (1, 2)
  UNION ALL SELECT s.series_id, CASE WHEN s.pos = n - 2 THEN n ELSE n + 1 END, {column} FROM {source} s JOIN {name}n USING (series_id) WHERE s.pos IN (n - 2, n - 1)),
{name} AS (SELECT c.series_id, c.pos, bool_and(c.{column} >= q.v) AS is_max, bool_and(c.{column} <= q.v) AS is_min FROM {source} c JOIN {name}n USING (series_id)
  JOIN {name}p q ON q.series_id = c.series_id AND q.pos BETWEEN c.pos - 2 AND c.pos + 2 AND q.pos <> c.pos WHERE n >= 5 GROUP BY 1, 2)"""


def _decomposed(source: str, column: str, name: str) -> str:
    return f"""
{name}k AS (SELECT series_id, n, k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS k FROM (SELECT series_id, count(*) AS n, greatest(3, least(25, count(*) // 2)) AS k FROM {source} GROUP BY 1)),
{name}c AS (SELECT c.series_id, c.pos, c.{column} AS v, k, greatest(0, least(n - 1, c.pos + o.o)) AS src FROM {source} c JOIN {name}k USING (series_id) JOIN (SELECT unnest(range(-12, 13)) AS o) o ON abs(o.o) <= k // 2),
{name} AS (SELECT c.series_id, c.pos, avg(s.{column}) AS trend, any_value(c.v) - avg(s.{column}) AS season FROM {name}c c JOIN {source} s ON s.series_id = c.series_id AND s.pos = c.src GROUP BY 1, 2)"""


def _greedy(kind: str, name: str) -> str:
    """Greedy matching as a recursion over predicted points."""
    return f"""
{name}g AS (SELECT series_id, list(pos ORDER BY pos) AS g FROM xt WHERE {kind} GROUP BY 1),
{name}r AS (SELECT series_id, list(pos ORDER BY pos) AS p FROM xp WHERE {kind} GROUP BY 1),
{name}m(series_id, i, p, rest, hits, n) AS (SELECT series_id, 0, p, g, 0, len(g) FROM {name}g LEFT JOIN {name}r USING (series_id)
  UNION ALL SELECT series_id, i + 1, p, CASE WHEN f IS NULL THEN rest ELSE list_filter(rest, lambda x: x <> f) END, hits + CASE WHEN f IS NULL THEN 0 ELSE 1 END, n
    FROM (SELECT *, list_filter(rest, lambda x: abs(x - p[i + 1]) <= 2)[1] AS f FROM {name}m WHERE i < len(p))),
{name} AS (SELECT series_id, arg_max(hits, i) AS hits, any_value(n) AS n_truth FROM {name}m GROUP BY 1)"""


_X = f"{_T.replace('WITH ', 'WITH RECURSIVE ', 1)},{_VALUES},{_extrema('aligned', 'pred', 'xp')},{_extrema('aligned', 'truth', 'xt')},{_greedy('is_max', 'gx')},{_greedy('is_min', 'gn')},\n" + """
exs AS (SELECT a.series_id, (coalesce(gx.hits / gx.n_truth * 0.1, 0) + coalesce(gn.hits / gn.n_truth * 0.1, 0)) * least(any_value(n_pred) / any_value(n_truth), 1) AS extrema_score FROM (SELECT DISTINCT series_id, n_pred, n_truth AS n_truth FROM aligned) a
  LEFT JOIN gx USING (series_id) LEFT JOIN gn USING (series_id) GROUP BY a.series_id, gx.hits, gx.n_truth, gn.hits, gn.n_truth)""".replace("any_value(n_pred) / any_value(n_truth)", "any_value(a.n_pred) / any_value(a.n_truth)")
_S = f"{_decomposed('zp', 'z_pred', 'dp')},{_decomposed('zp', 'z_truth', 'dt')}," + """
sts AS (SELECT series_id, CASE WHEN count(*) < 5 THEN 0 ELSE (0.05 / (1 + ln(1 + avg((dp.season - dt.season) ** 2))) + 0.15 / (1 + ln(1 + avg((dp.trend - dt.trend) ** 2)))) * least(any_value(n_pred) / any_value(n_truth), 1) END AS season_trend_score
  FROM dp JOIN dt USING (series_id, pos) JOIN aligned USING (series_id, pos) GROUP BY 1)"""
_TOTAL = """
tot AS (SELECT a.series_id, CAST(CASE WHEN regexp_matches(answer_text, '(?s)<answer>.*?</answer>') THEN 0 ELSE -1 END AS DOUBLE) AS format_score, CASE WHEN np >= 24 THEN 0.1 ELSE 0.1 * np / 24 END AS length_score, mse_score, extrema_score, season_trend_score
  FROM answers a JOIN (SELECT series_id, CAST(count(*) AS DOUBLE) AS np FROM av GROUP BY 1) USING (series_id) JOIN msc USING (series_id) JOIN exs USING (series_id) JOIN sts USING (series_id))"""
_STAMP = "'%Y-%m-%d %H:%M:%S'"
_LINES = f"string_agg(strftime(ts, {_STAMP}) || ' ' || printf('%.2f', value), chr(10) ORDER BY pos)"
_CUT = f"""
lt AS (SELECT series_id, strftime(ts, {_STAMP}) || ' ' || printf('%.2f', value) AS line, pos, count(*) OVER (PARTITION BY series_id) AS n FROM series_user),
tx AS (SELECT series_id, CASE WHEN any_value(n) <= 10 THEN string_agg(line, chr(10) ORDER BY pos) ELSE string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos < 5) || chr(10) || '... (' || (any_value(n) - 10) || ' rows omitted) ...' || chr(10) || string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos >= n - 5) END AS text, string_agg(line, chr(10) ORDER BY pos) AS full_text FROM lt GROUP BY 1)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ACTIONS = "[" + ", ".join(map(_quoted, rows.ACTIONS)) + "]"


def _ext(name: str, pick: str) -> str:
    return f"SELECT series_id, CAST(s AS INTEGER) AS step, last + to_microseconds(gap * (s + 1)) AS ts, '{name}' AS rule FROM (SELECT series_id, max(ts) AS last, {pick}(gap, pos) FILTER (WHERE gap IS NOT NULL) AS gap FROM g GROUP BY 1), (SELECT unnest(range(3)) AS s)"


ORACLE_SQL = {
    "a01_read_rollouts": "SELECT * FROM conversations WHERE len(string_split(text, ' ')) <= 60 ORDER BY conv_id, turn LIMIT 50",
    "a02_parse_series_text": f"{_U} SELECT series_id, pos AS line_no, pos, CASE WHEN pos % 7 = 3 THEN NULL ELSE strftime(ts, {_STAMP}) END AS ts_str, value FROM series_user",
    "a03_build_series_full": f"{_U} SELECT series_id, pos, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, value FROM series_user",
    "a03_build_series_partial": f"{_U},{_P} SELECT series_id, pos, (SELECT min(q.ts) FROM pk q WHERE q.series_id = pk.series_id AND q.pos = 0) + to_seconds(coalesce(gap, 3600) * pos) AS ts, value FROM pk LEFT JOIN freq USING (series_id)",
    "a03_build_series_none": f"{_U} SELECT series_id, pos, TIMESTAMP '2017-01-01' + to_hours(pos) AS ts, value FROM series_user",
    "a03_build_series_anchor": f"{_U} SELECT series_id, pos, max(CASE WHEN pos = 2 THEN date_trunc('second', ts) END) OVER (PARTITION BY series_id) + to_hours(pos - 2) AS ts, value FROM series_user",
    "a04_parse_answer_values": f"{_T},{_VALUES} SELECT series_id, pos, value FROM av",
    "a05_format_forecast_text": f"{_W} SELECT series_id, string_agg(strftime(ts, {_STAMP}) || ' ' || printf('%.3f', yhat), chr(10) ORDER BY step) AS text FROM fc GROUP BY 1",
    "a06_write_generations": f"{_T} SELECT series_id AS input, answer_text AS output, truth_text AS gts, CAST(length(answer_text) AS DOUBLE) AS score, CAST(split_part(series_id, '#', 2) AS INTEGER) % 5 AS step FROM answers JOIN truths USING (series_id)",
    "a07_append_io_log": "SELECT conv_id, turn, role, text FROM conversations",
    "b01_extract_answer": f"{_T} SELECT series_id, {_BODY} AS lenient, CASE WHEN regexp_matches(answer_text, '(?s)<answer>.*?</answer>') THEN {_BODY} END AS strict FROM answers",
    "b02_resolve_value_column": f"{_W} SELECT series_id, CAST(s AS INTEGER) AS step, value FROM ctx, (SELECT unnest(range(24)) AS s) WHERE pos = 167",
    "b03_truncate_history": f"{_U},{_CUT} SELECT series_id, text FROM tx",
    "b11_validate_series_request": f"{_U} SELECT series_id, CAST(CASE WHEN CAST(series_id AS INTEGER) % 3 = 0 THEN least(5, n) WHEN CAST(series_id AS INTEGER) % 3 = 1 THEN 1 ELSE n END AS INTEGER) AS n, CASE CAST(series_id AS INTEGER) % 3 WHEN 0 THEN CASE WHEN n > 5 THEN 'length mismatch' END WHEN 1 THEN 'too few points' END AS reason FROM (SELECT series_id, count(*) AS n FROM series_user GROUP BY 1)",
    "b12_sanitize": f"{_U} SELECT series_id, pos, CASE WHEN pos % 5 < 3 THEN 0 ELSE value END AS value FROM series_user",
    "b13_render_prompt": f"""{_U},{_CUT} SELECT series_id, concat_ws(chr(10), '**[Turn ' || (k + 1) || '] Action: ' || {_ACTIONS}[k + 1] || '**', '### Lookback Window: 168 rows', '### Forecast Horizon: 24 rows',
      CASE k WHEN 2 THEN '### Historical Data (truncated)' ELSE '### Historical Data' END, CASE k WHEN 2 THEN text ELSE full_text END, '', '### Analysis History', CASE k WHEN 0 THEN {_quoted(rows.NO_ANALYSIS)} ELSE 'flat' || chr(10) || 'calm' END,
      '', '### Model Predictions', CASE k WHEN 2 THEN 'Model Predictions (24 steps):' || chr(10) || '1.000' ELSE {_quoted(rows.NO_PREDICTION)} END, '', CASE k WHEN 2 THEN {_quoted(rows.INSTRUCTIONS)} ELSE {_quoted(rows.STATE_CHECK)} END) AS prompt
      FROM (SELECT *, CAST(series_id AS INTEGER) % 3 AS k FROM tx)""",
    "b14_turn_info": f"{_U} SELECT DISTINCT series_id, CAST(CAST(series_id AS INTEGER) % 3 + 1 AS INTEGER) AS turn, {_ACTIONS}[CAST(series_id AS INTEGER) % 3 + 1] AS action FROM series_user",
    "c01_align_forecast": f"{_T},{_VALUES} SELECT series_id, pos, pred, truth, n_pred, n_truth FROM aligned",
    "c02_detect_input_copy": f"{_T} SELECT series_id, CAST(CASE WHEN kind = 4 THEN 1 ELSE 0 END AS DOUBLE) AS share, kind = 4 AS is_copy FROM ax",
    "c03_match_extrema": f"{_X} SELECT series_id, CAST(hits AS INTEGER) AS hits, CAST(n_truth AS INTEGER) AS n_truth FROM gx",
    "e01_infer_frequency": f"{_U},{_P} SELECT series_id, gap FROM freq",
    "e02_last_timestamp": f"{_U},{_P} SELECT series_id, strftime(arg_max((ts,), pos)[1], {_STAMP}) AS ts_str FROM pk GROUP BY 1",
    "e03_extend_timestamps": f"{_U}, g AS (SELECT series_id, pos, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY series_id ORDER BY pos), ts) AS gap FROM series_user) {_ext('first', 'arg_min')} UNION ALL {_ext('last', 'arg_max')}",
    "e04_make_windows": f"{_W} SELECT series_id, CAST(window_no AS INTEGER) AS window_no, CASE WHEN offs < 168 THEN 'context' ELSE 'target' END AS part, CAST(CASE WHEN offs < 168 THEN offs ELSE offs - 168 END AS INTEGER) AS pos, ts, value FROM ws",
    "e05_instance_normalize": f"{_U} SELECT series_id, pos, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) + 0.0 AS norm, round(value, 6) + 0.0 AS value FROM series_user WINDOW w AS (PARTITION BY series_id)",
    "e06_make_patches": f"""{_U}, pc AS (SELECT series_id, count(*) AS n FROM series_user GROUP BY 1), pn AS (SELECT series_id, n, unnest(range((n + 8 - 16) // 8 + 1)) AS patch_no FROM pc WHERE n + 8 >= 16)
      SELECT pn.series_id, CAST(patch_no AS INTEGER) AS patch_no, 16 AS n, round(sum(value), 6) + 0.0 AS total, arg_min(value, o) AS first_value FROM pn, (SELECT unnest(range(16)) AS o) o JOIN series_user s ON s.series_id = pn.series_id AND s.pos = least(patch_no * 8 + o, n - 1) GROUP BY 1, 2""",
    "e07_median_quantile": f"{_W} SELECT series_id, CAST(pos % 24 AS INTEGER) AS step, round(median(value), 6) + 0.0 AS yhat FROM ctx GROUP BY 1, 2",
    "e07_sample_median": f"{_W} SELECT series_id, CAST(pos % 24 AS INTEGER) AS step, round(median(value), 6) + 0.0 AS yhat FROM ctx GROUP BY 1, 2",
    "e08_fit_length": f"{_W} SELECT series_id, CAST(s AS INTEGER) AS step, value AS yhat FROM ctx, (SELECT unnest(range(18)) AS s) WHERE pos = 167",
    "e09_forecast_naive": f"{_W} SELECT series_id, 'naive' AS model, CAST(s AS INTEGER) AS step, ts + to_hours(s + 1) AS ts, value AS yhat FROM ctx, (SELECT unnest(range(24)) AS s) WHERE pos = 167",
    "e09_forecast_seasonal_naive": f"{_W} SELECT series_id, 'seasonal_naive' AS model, CAST(pos - 144 + 24 * k AS INTEGER) AS step, ts + to_hours(24 * (k + 1)) AS ts, value AS yhat FROM ctx, (SELECT unnest(range(2)) AS k) WHERE pos >= 144",
    "e12_forecast_with_model": f"{_W} SELECT series_id, 'seasonal_naive' AS model, CAST(pos - 144 + 24 * k AS INTEGER) AS step, ts + to_hours(24 * (k + 1)) AS ts, value AS yhat FROM ctx, (SELECT unnest(range(2)) AS k) WHERE pos >= 144",
    "f01_normalize_pair": f"{_T},{_VALUES} SELECT series_id, pos, round(z_pred, 6) + 0.0 AS z_pred, round(z_truth, 6) + 0.0 AS z_truth FROM zp",
    "f02_errors": f"{_T},{_VALUES} SELECT series_id, round(avg((pred - truth) ** 2), 6) + 0.0 AS mse, round(avg(abs(pred - truth)), 6) + 0.0 AS mae FROM aligned GROUP BY 1",
    "f03_f04_format_and_length": f"{_T},{_VALUES} SELECT a.series_id, CAST(CASE WHEN kind = 1 THEN -1 ELSE 0 END AS DOUBLE) AS format_score, round(0.1 * np / 24, 6) + 0.0 AS length_score FROM ax a JOIN (SELECT series_id, CAST(count(*) AS DOUBLE) AS np FROM av GROUP BY 1) USING (series_id)",
    "f05_mse_score": f"{_T},{_VALUES} SELECT series_id, round(mse_score, 6) + 0.0 AS mse_score FROM msc",
    "f06_decompose": f"{_U},{_decomposed('series_user', 'value', 'dc')} SELECT series_id, pos, round(trend, 4) + 0.0 AS trend, round(season, 4) + 0.0 AS season FROM dc",
    "f07_season_trend_score": f"{_T},{_VALUES},{_S} SELECT series_id, round(season_trend_score, 4) + 0.0 AS season_trend_score FROM sts",
    "f08_find_extrema": f"{_U},{_extrema('series_user', 'value', 'xu')} SELECT series_id, pos, is_max, is_min FROM xu",
    "f09_extrema_score": f"{_X} SELECT series_id, round(extrema_score, 6) + 0.0 AS extrema_score FROM exs",
    "f10_total_score": f"""{_X},{_S},{_TOTAL} SELECT series_id, format_score, round(length_score, 4) + 0.0 AS length_score, round(mse_score, 4) + 0.0 AS mse_score, round(extrema_score, 4) + 0.0 AS extrema_score, round(season_trend_score, 4) + 0.0 AS season_trend_score,
      round(CASE WHEN format_score < 0 THEN format_score ELSE length_score + mse_score + extrema_score + season_trend_score END, 4) + 0.0 AS total_score FROM tot""",
    "f11_final_reward": f"{_X},{_S},{_TOTAL} SELECT series_id, round(CASE WHEN series_id LIKE 'error#%' THEN 0 ELSE length_score + mse_score + extrema_score + season_trend_score END, 4) + 0.0 AS reward FROM tot",
    "j02_custom_reward": f"{_T} SELECT series_id, CAST(length(answer_text) - length(truth_text) + length(split_part(series_id, '#', 1)) + CAST(split_part(series_id, '#', 2) AS INTEGER) AS DOUBLE) AS reward FROM answers JOIN truths USING (series_id)",
}
ORACLE_SQL["e12_forecast_with_factory"] = ORACLE_SQL["e12_forecast_with_model"]
