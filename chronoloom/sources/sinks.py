"""Text and JSON lines out of typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.decimals import fixed_text
from chronoloom.operators.rows import resolve_value_column


def format_forecast_text(df: DataFrame, value_col: str | None = None, last_ts: str | None = None, freq_hours: int = 1) -> DataFrame:
    """(series_id, text): a line per step with its time and value to three places.

    Without a column ts, times are last_ts + (step + 1) hours times ``freq_hours``.
    """
    value = value_col or resolve_value_column(df)
    order = "step" if "step" in df.columns else "pos"
    base = F.lit(last_ts or "2017-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts") if "ts" in df.columns else (base + F.make_dt_interval(F.lit(0), ((F.col(order) + 1) * freq_hours).cast("int"))).cast("timestamp_ntz")
    line = F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), fixed_text(F.col(value).cast("double"), 3))
    lines = df.select("series_id", F.struct(F.col(order).alias("k"), line.alias("line")).alias("p"))
    return lines.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n").alias("text"))


def write_generations(df: DataFrame, path: str) -> None:
    """JSON lines input, output, gts, score and further columns, in a folder per step; a rerun replaces its steps."""
    needed = {"input", "output", "gts", "score", "step"}
    if missing := needed - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").json(path)


def append_io_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines; nothing is written for no rows."""
    if not df.isEmpty():
        df.write.mode("append").json(path)
