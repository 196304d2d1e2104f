"""How the given tables become the inputs of the library: series, texts, steps, samples.

Each binding has a DataFrame form and a SQL form (a common table expression) for checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.decimals import fixed_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per user: the values of its events in order of time."""
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")  # named first, so that later steps share this shuffle
    named = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", "event_id", "value")
    return named.select("series_id", (F.row_number().over(w) - 1).alias("pos"), "ts", "value")


def series_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per event type, of which there are few: its events in order of time, numbered over ranges."""
    from chronoloom.operators.ranges import numbered

    named = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return numbered(named, ["series_id"], ["ts", "event_id"], "pos").select("series_id", "pos", "ts", "value")


def series_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per event type: hourly sums from the first to the last hour of all events, empty hours 0."""
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("hour", "ts").cast("timestamp_ntz")).cast("int")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), hour.alias("h"), "value")
    low, high = events.agg(F.min("h"), F.max("h")).first()  # two numbers
    sums = events.groupBy("series_id", "h").agg(F.sum("value").alias("value")).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "value"))).alias("sums"))
    out = sums.select("series_id", "sums", F.explode(F.sequence(F.lit(low or 0), F.lit(high or 0))).alias("h"))
    stamp = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 0, 0)").cast("timestamp_ntz")
    return out.select("series_id", (F.col("h") - (low or 0)).alias("pos"), stamp.alias("ts"), F.round(F.coalesce(F.try_element_at("sums", F.col("h")), F.lit(0.0)), 2).alias("value"))


def series_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per return flag: daily revenue in order of the days that have any."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"))
    return daily.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).alias("pos"), "ts", "value")


def series_text(spark: SparkSession, sf_dir: str, case: str = "partial") -> DataFrame:
    """(series_id, text): a line per point of series_user, by ``case`` without some stamps.

    full: all have stamps; partial: not where pos % 7 = 3; none: none has; anchor: only pos 2 has.
    """
    drop = {"full": F.lit(False), "partial": F.col("pos") % 7 == 3, "none": F.lit(True), "anchor": F.col("pos") != 2}[case]
    value = fixed_text(F.col("value"), 2)
    line = F.when(drop, value).otherwise(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), value))
    lines = series_user(spark, sf_dir).select("series_id", F.struct("pos", line.alias("line")).alias("p"))
    return lines.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n").alias("text"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent steps from conversations: a trajectory per conversation, a step per turn."""
    c = table(spark, sf_dir, "conversations").withColumn("trajectory_id", F.col("conv_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n\\t]+"), lambda w: w != "")
    return c.select(
        F.floor(F.col("conv_id") / 4).cast("string").alias("uid"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("data_source"), "trajectory_id",
        (F.row_number().over(Window.partitionBy("trajectory_id").orderBy("turn")) - 1).alias("step_index"), F.transform(words, lambda w: F.length(w)).alias("response_ids"),
        F.transform(words, lambda w: F.lit(1)).alias("response_mask"), F.slice(F.transform(words, lambda w: F.length(w)), 1, 8).alias("prompt_ids"),
        ((F.length("text") % 100) / 100).alias("reward_score"), ((F.length("text") % 37) / 37).alias("value"), F.col("text").alias("response_text"), F.col("role"),
        (F.size(words) / 50).alias("t_generate"), (F.size(words) % 7 / 10).alias("t_tool"),
    )


def val_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation samples from labelled documents: reward, acc and the text pred."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    base = j.select(F.col("source").alias("data_source"), F.col("lang").alias("uid"), (F.row_number().over(w) - 1).alias("sample_no"), "quality", "toxic")
    each = F.array(
        F.struct(F.lit("reward").alias("var"), F.col("quality").cast("double").alias("num"), F.lit(None).cast("string").alias("str")),
        F.struct(F.lit("acc").alias("var"), (1 - F.col("toxic")).cast("double").alias("num"), F.lit(None).cast("string").alias("str")),
        F.struct(F.lit("pred").alias("var"), F.lit(None).cast("double").alias("num"), F.col("quality").cast("string").alias("str")),
    )
    return base.select("data_source", "uid", "sample_no", F.explode(each).alias("e")).select("data_source", "uid", "sample_no", "e.*")


SQL = {
    "series_user": "series_user AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, ts, value FROM events)",
    "series_type": "series_type AS (SELECT event_type AS series_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, ts, value FROM events)",
    "series_hour": """hs AS (SELECT event_type AS series_id, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS h, sum(value) AS v FROM events GROUP BY 1, 2),
hb AS (SELECT min(h) AS low, max(h) AS high FROM hs),
series_hour AS (SELECT t.series_id, CAST(p.h - low AS INTEGER) AS pos, TIMESTAMP '1970-01-01' + to_hours(CAST(p.h AS INTEGER)) AS ts, round(coalesce(hs.v, 0.0), 2) AS value
  FROM (SELECT DISTINCT event_type AS series_id FROM events) t CROSS JOIN (SELECT low, unnest(range(low, high + 1)) AS h FROM hb) p LEFT JOIN hs ON hs.series_id = t.series_id AND hs.h = p.h)""",
    "series_day": """series_day AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS pos, ts, value
  FROM (SELECT l_returnflag AS series_id, l_shipdate AS ts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem GROUP BY 1, 2))""",
    "steps": r"""sw AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step_index,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\t]+'), lambda w: w <> '') AS words FROM conversations),
steps AS (SELECT CAST(conv_id // 4 AS VARCHAR) AS uid, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS data_source, CAST(conv_id AS VARCHAR) AS trajectory_id, step_index,
    len(words) AS n_tokens, list_transform(words, lambda w: length(w)) AS response_ids, list_transform(words, lambda w: length(w))[1:8] AS prompt_ids, (length(text) % 100) / 100 AS reward_score, (length(text) % 37) / 37 AS value,
    text AS response_text, role, len(words) / 50 AS t_generate, (len(words) % 7) / 10 AS t_tool FROM sw)""",
    "val_samples": """vb AS (SELECT source AS data_source, lang AS uid, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS sample_no, quality, toxic FROM documents JOIN labels USING (doc_id)),
val_samples AS (SELECT data_source, uid, sample_no, 'reward' AS var, CAST(quality AS DOUBLE) AS num, NULL AS str FROM vb
  UNION ALL SELECT data_source, uid, sample_no, 'acc', CAST(1 - toxic AS DOUBLE), NULL FROM vb UNION ALL SELECT data_source, uid, sample_no, 'pred', NULL, CAST(quality AS VARCHAR) FROM vb)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def windows_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of 168 and targets of 24 hours, cut every 24 hours."""
    from chronoloom.operators.forecasts import make_windows

    return make_windows(series_hour(spark, sf_dir), 168, 24, 24)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.operators.forecasts import windows_as_series

    return windows_as_series(windows_hour(spark, sf_dir), "context")


def _window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, kind, ctx, tgt): the points of a window's two parts as arrays; kind: window number mod 5."""
    point = F.struct("pos", "ts", "value")
    part = lambda name: F.array_sort(F.filter(F.collect_list(F.when(F.col("part") == name, point)), lambda x: x.isNotNull()))
    w = windows_hour(spark, sf_dir).groupBy("series_id", "window").agg(part("context").alias("ctx"), part("target").alias("tgt"))
    return w.select(F.concat_ws("#", "series_id", "window").alias("series_id"), (F.col("window") % 5).alias("kind"), "ctx", "tgt")


def _stamped(ts, value):
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), fixed_text(value, 3))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, truth_text): stamped lines of the targets."""
    return _window_rows(spark, sf_dir).select("series_id", F.array_join(F.transform("tgt", lambda p: _stamped(p["ts"], p["value"])), "\n").alias("truth_text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, answer_text): seasonal forecasts in five dresses, by window number.

    0: tagged; 1: without tags; 2: tagged, 12 lines; 3: tagged table rows; 4: tagged copy of the context's end.
    """
    day = F.slice("ctx", -24, 24)
    line = lambda p, i: F.when(F.col("kind") == 3, F.concat(F.format_string("| %d | ", i), fixed_text(p["value"], 3), F.lit(" |"))).when(F.col("kind") == 4, _stamped(p["ts"], p["value"])).otherwise(_stamped(p["ts"] + F.expr("interval 1 day"), p["value"]))
    text = F.array_join(F.slice(F.transform(day, line), F.lit(1), F.when(F.col("kind") == 2, 12).otherwise(24)), "\n")
    tagged = F.concat(F.lit("Done.\n<answer>\n"), text, F.lit("\n</answer>"))
    return _window_rows(spark, sf_dir).select("series_id", F.when(F.col("kind") == 1, text).otherwise(tagged).alias("answer_text"))


def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with tool calls by rule, and answers in every third step."""
    call = lambda name, args: F.struct(F.lit(name).alias("name"), F.lit(args).alias("arguments"))
    feature, predict = call("extract_data_quality", '{"model_name": null}'), call("predict_time_series", '{"model_name": " ARIMA "}')
    odd = call("predict_time_series", '{"model_name": "prophet"')
    t, c = F.col("trajectory_id").cast("bigint"), F.col("step_index") % 3
    none = F.slice(F.array(feature), 1, 0)
    calls = F.when((c == 0) & (t % 4 != 3), F.array(feature)).when((c == 1) & (t % 5 == 0), F.array(feature, predict)).when((c == 1) & (t % 5 == 1), F.array(odd, feature)).when(c == 1, F.array(predict)).otherwise(none)
    text = F.when(c == 2, F.concat(F.lit("so <answer> "), F.when(t % 7 == 0, "").otherwise(F.col("response_text")), F.lit(" </answer>"))).otherwise(F.col("response_text"))
    return steps(spark, sf_dir).withColumn("tool_calls", calls).withColumn("response_text", text).withColumn("is_copy", t % 6 == 0)


SQL |= {
    "windows": """ws AS (SELECT h.series_id, w.w AS window_no, h.pos - w.w * 24 AS offs, ts, value FROM series_hour h JOIN (SELECT unnest(range((max(pos) + 1 - 192) // 24 + 1)) AS w FROM series_hour) w ON h.pos BETWEEN w.w * 24 AND w.w * 24 + 191),
ctx AS (SELECT series_id || '#' || window_no AS series_id, CAST(offs AS INTEGER) AS pos, ts, value FROM ws WHERE offs < 168),
tgt AS (SELECT series_id || '#' || window_no AS series_id, CAST(offs - 168 AS INTEGER) AS pos, ts, value FROM ws WHERE offs >= 168),
fc AS (SELECT series_id, CAST(pos - 144 AS INTEGER) AS step, ts + INTERVAL 24 HOUR AS ts, value AS yhat FROM ctx WHERE pos >= 144)""",
    "texts": r"""truths AS (SELECT series_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || printf('%.3f', value), chr(10) ORDER BY pos) AS truth_text FROM tgt GROUP BY 1),
al AS (SELECT series_id, CAST(split_part(series_id, '#', 2) AS INTEGER) % 5 AS kind, step AS k, ts, yhat AS v FROM fc
  UNION ALL SELECT series_id, 4, pos - 144, ts, value FROM ctx WHERE pos >= 144 AND CAST(split_part(series_id, '#', 2) AS INTEGER) % 5 = 4),
ax AS (SELECT a.series_id, a.kind, string_agg(CASE WHEN a.kind = 3 THEN '| ' || k || ' | ' || printf('%.3f', v) || ' |' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || printf('%.3f', v) END, chr(10) ORDER BY k) AS t
  FROM al a WHERE NOT (kind = 2 AND k >= 12) AND NOT (kind = 4 AND ts >= (SELECT max(c.ts) + INTERVAL 1 HOUR FROM ctx c WHERE c.series_id = a.series_id)) GROUP BY 1, 2),
answers AS (SELECT series_id, CASE WHEN kind = 1 THEN t ELSE 'Done.' || chr(10) || '<answer>' || chr(10) || t || chr(10) || '</answer>' END AS answer_text FROM ax)""",
    "agent_steps": r"""agent_steps AS (SELECT * REPLACE (CASE WHEN step_index % 3 = 2 THEN 'so <answer> ' || CASE WHEN CAST(trajectory_id AS BIGINT) % 7 = 0 THEN '' ELSE response_text END || ' </answer>' ELSE response_text END AS response_text),
    CASE WHEN step_index % 3 = 0 AND CAST(trajectory_id AS BIGINT) % 4 <> 3 THEN ['F'] WHEN step_index % 3 = 1 AND CAST(trajectory_id AS BIGINT) % 5 = 0 THEN ['F', 'P'] WHEN step_index % 3 = 1 AND CAST(trajectory_id AS BIGINT) % 5 = 1 THEN ['X', 'F']
      WHEN step_index % 3 = 1 THEN ['P'] ELSE CAST([] AS VARCHAR[]) END AS calls, CAST(trajectory_id AS BIGINT) % 6 = 0 AS is_copy FROM steps)""",
}
