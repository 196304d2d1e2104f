"""Series and answers in text form, read into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line with a time stamp in front, and one that is a number as programs write them (fixed values).
STAMPED = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(-?\d+\.?\d*)$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_rollouts(spark: SparkSession, path: str, max_samples: int = -1, max_prompt_tokens: int | None = None, order_by: tuple[str, ...] = (), length: Column | None = None) -> DataFrame:
    """Prompt files (Parquet, or JSON by suffix): prompts over the limit dropped, then the first ones kept.

    The files carry no order of their own, so ``order_by`` names the keys that say what first means.
    ``length`` counts the tokens of a prompt, by default those of prompt_ids.
    """
    df = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    if max_prompt_tokens is not None:
        df = df.filter((F.size("prompt_ids") if length is None else length) <= max_prompt_tokens)
    if max_samples >= 0:
        df = (df.orderBy(*order_by) if order_by else df).limit(max_samples)
    return df


def parse_series_text(df: DataFrame, id_col: str = "series_id", text_col: str = "text") -> DataFrame:
    """(series_id, line_no, pos, ts_str, value): a row per line that is a stamped or a bare number."""
    lines = df.select(F.col(id_col).alias("series_id"), F.posexplode(F.split(strip(F.col(text_col)), "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    stamp = F.nullif(F.regexp_extract("line", STAMPED, 1), F.lit(""))
    bare = F.when(F.col("line").rlike(NUMBER), F.col("line").try_cast("double"))
    value = F.when(stamp.isNotNull(), F.regexp_extract("line", STAMPED, 2).try_cast("double")).otherwise(bare)
    kept = lines.select("series_id", "line_no", stamp.alias("ts_str"), value.alias("value")).filter("value is not null")
    pos = F.row_number().over(Window.partitionBy("series_id").orderBy("line_no")) - 1
    return kept.select("series_id", "line_no", pos.alias("pos"), "ts_str", "value")


def parsed_times(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("ts", F.try_to_timestamp("ts_str", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def _gaps(df: DataFrame) -> DataFrame:
    """Adds gap: seconds since the known time before, null unless positive."""
    known = F.last("ts", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.timestamp_diff("SECOND", known, F.col("ts"))
    return df.withColumn("gap", F.when(F.col("ts").isNotNull() & (gap > 0), gap))


def _most_common(df: DataFrame) -> DataFrame:
    """Adds to rows with a gap: how many of the series have it (times), and where the first of them is (seen)."""
    same = Window.partitionBy("series_id", "gap")
    return df.withColumn("times", F.count("gap").over(same)).withColumn("seen", F.min("pos").over(same))


def frequencies(df: DataFrame) -> DataFrame:
    """(series_id, gap): the most common positive gap between consecutive known times, as seconds;
    of equally common ones that seen first. Series with fewer than two times have none."""
    counted = _gaps(df).filter("gap is not null").groupBy("series_id", "gap").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("series_id").agg(F.max_by("gap", F.struct("n", (-F.col("first")).alias("f"))).alias("gap"))


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return (ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def build_series(parsed: DataFrame, default_seconds: int = 3600, base_ts: str = "2017-01-01 00:00:00") -> DataFrame:
    """(series_id, pos, ts, value) from parsed lines.

    All times known: they stand. None: ``base_ts`` and steps of the default. Some: all times are
    set anew from the first known one, in steps of the most common gap (or the default).
    """
    x = parsed_times(parsed) if "ts" not in parsed.columns else parsed
    w = Window.partitionBy("series_id")
    x = x.withColumn("n", F.count("*").over(w)).withColumn("known", F.count("ts").over(w))
    x = x.withColumn("anchor", F.min(F.when(F.col("ts").isNotNull(), F.struct("pos", "ts"))).over(w))
    x = _most_common(_gaps(x))
    x = x.withColumn("common", F.max(F.when(F.col("gap").isNotNull(), F.struct("times", (-F.col("seen")).alias("f"), "gap"))).over(w))
    step = F.coalesce("common.gap", F.lit(default_seconds))
    made = _plus_seconds(F.col("anchor.ts"), step * (F.col("pos") - F.col("anchor.pos")))
    base = _plus_seconds(F.lit(base_ts).cast("timestamp_ntz"), F.lit(default_seconds) * F.col("pos"))
    ts = F.when(F.col("known") == F.col("n"), F.col("ts")).when(F.col("known") == 0, base).otherwise(made)
    return x.select("series_id", "pos", ts.alias("ts"), "value")


def answer_body(text: Column) -> Column:
    """What is in the first answer tags, else all of the text; stripped."""
    return strip(F.when(text.rlike("(?s)<answer>.*?</answer>"), F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)).otherwise(text))


#: Numbers after a time stamp, in a table row, or at the end of a line, tried in this order (fixed values).
ANSWER_PATTERNS = (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+(-?\d+\.?\d*)", r"\|\s*\d+\s*\|\s*(-?\d+\.?\d*)\s*\|", r"(-?\d+\.?\d*)$")


def answer_values(text: Column) -> Column:
    """The values of an answer's lines, in order, as one array; lines without a number have none."""

    def value(line: Column) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(strip(line), p, 1), F.lit("")) for p in ANSWER_PATTERNS)).try_cast("double")

    return F.filter(F.transform(F.split(answer_body(text), "\n"), value), lambda v: v.isNotNull())


def parse_answer_values(df: DataFrame, id_col: str = "series_id", text_col: str = "text") -> DataFrame:
    """(series_id, pos, value): per line a number after a time stamp, in a table row, or at its end."""
    return df.select(F.col(id_col).alias("series_id"), F.posexplode(answer_values(F.col(text_col))).alias("pos", "value"))


def last_timestamp(parsed: DataFrame) -> DataFrame:
    """(series_id, ts_str): the stamp of the last line that was kept, null if it had none."""
    w = Window.partitionBy("series_id").orderBy(F.desc("pos"))
    return parsed.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("series_id", "ts_str")
