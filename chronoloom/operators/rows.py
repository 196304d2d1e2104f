"""Projections, filters and text building on steps, answers and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forecasters that agents may name (fixed values).
MODELS = ("chronos2", "arima", "patchtst", "itransformer")


def strict_answer(text: Column) -> Column:
    """The first answer's body, stripped; null without tags or with an empty body."""
    body = F.regexp_replace(F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1), r"^\s+|\s+$", "")
    return F.when(text.rlike("(?s)<answer>.*?</answer>") & (body != ""), body)


def extract_answer(df: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    from chronoloom.sources.series_text import answer_body

    return df.withColumn("answer", strict_answer(F.col(text_col)) if strict else answer_body(F.col(text_col)))


def resolve_value_column(df: DataFrame) -> str:
    """The first of 0.5, target_0.5 in column order, else predictions, else the last number column."""
    for c in df.columns:
        if c in ("0.5", "target_0.5"):
            return f"`{c}`"
    if "predictions" in df.columns:
        return "predictions"
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        raise ValueError("no value column")
    return f"`{numeric[-1]}`"


def truncate_history(df: DataFrame, text_col: str = "text", head: int = 5, tail: int = 5) -> DataFrame:
    """Long texts keep their first and last lines and say how many are left out."""
    lines = F.split(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", ""), "\n")
    note = F.concat(F.lit("... ("), (F.size(lines) - head - tail).cast("string"), F.lit(" rows omitted) ..."))
    short = F.array_join(F.concat(F.slice(lines, 1, head), F.array(note), F.slice(lines, -tail, tail)), "\n")
    return df.withColumn(text_col, F.when(F.size(lines) <= head + tail, F.col(text_col)).otherwise(short))


def last_step(steps: DataFrame) -> DataFrame:
    w = Window.partitionBy("trajectory_id").orderBy(F.desc("step_index"))
    return steps.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("is_pad", F.lit(False)))


def response_length() -> Column:
    return F.coalesce(F.aggregate("response_mask", F.lit(0), lambda a, m: a + m), F.lit(0))


def non_aborted(steps: DataFrame, fail_when_none: bool = True) -> DataFrame:
    """Rows with a response; an error when no row has one."""
    kept = steps.filter(response_length() > 0)
    if fail_when_none and kept.isEmpty():
        raise ValueError("all rows were aborted")
    return kept


def normalize_model_name(c: Column, default: str | None = "chronos2") -> Column:
    """Lower case and stripped; unknown names become the default, or an error where there is none."""
    name = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    other = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("unknown model: "), name))
    return F.when(name.isin(*MODELS), name).otherwise(other)


def cap_tool_calls(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("tool_calls", F.slice("tool_calls", 1, n))


def tool_argument(arguments: Column, name: str = "model_name") -> Column:
    """A field of JSON arguments; null for bad JSON."""
    return F.get_json_object(arguments, f"$.{name}")


def truncate_responses(df: DataFrame, max_len: int, columns: tuple[str, ...] = ("response_ids", "response_mask", "response_logprobs")) -> DataFrame:
    return df.withColumns({c: F.slice(c, 1, max_len) for c in columns if c in df.columns})


def validate_series_request(df: DataFrame) -> DataFrame:
    """Adds reason: null for good requests (timestamps and values of one length, two points or more)."""
    reason = F.when(F.size("timestamps") != F.size("values"), "length mismatch").when(F.size("values") < 2, "too few points")
    return df.withColumn("reason", reason)


def sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and infinite numbers become 0.0, in arrays too; strings stay."""
    out = {}
    for c in cols:
        kind = df.schema[c].dataType
        good = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
        if isinstance(kind, T.ArrayType):
            out[c] = F.transform(F.col(c).cast("array<double>"), good)
        elif isinstance(kind, T.NumericType):
            out[c] = good(F.col(c).cast("double"))
        elif not isinstance(kind, T.StringType):
            out[c] = F.lit(0.0)
    return df.withColumns(out)


#: What the three turns ask of the agent (fixed values).
ACTIONS = (
    "Call feature extraction tools (e.g., extract_basic_statistics). Do NOT call predict_time_series yet.",
    "Call predict_time_series with your chosen model (e.g., 'chronos2').",
    "Output your final answer in <think>...</think><answer>...</answer> format using the model predictions. Do NOT output any text outside these tags.",
)
#: Sentences for what is not there yet, and how both prompts end (fixed values).
NO_ANALYSIS = "No previous analysis performed."
NO_PREDICTION = "No predictions available yet. Call predict_time_series to generate forecasts."
INSTRUCTIONS = """**Instructions**:
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
STATE_CHECK = """**Check your current state and act accordingly:**
- If "Analysis History" is empty → Call feature extraction tools. Do NOT call predict_time_series yet.
- If "Analysis History" has features but "Model Predictions" is empty → Call predict_time_series with model_name.
"""


def turn_info(has_features: Column, has_predictions: Column) -> Column:
    """struct(turn, action): which of the three turns is next and what it asks for. Without features it is
    the first, whatever is predicted."""
    turn = F.when(~has_features, 1).when(~has_predictions, 2).otherwise(3)
    return F.struct(turn.alias("turn"), F.get(F.array(*map(F.lit, ACTIONS)), turn - 1).alias("action"))


def render_prompt(state: DataFrame) -> DataFrame:
    """(series_id, prompt) from lookback, horizon, history, analysis (array) and prediction (nullable).

    The turn is found from the analysis (or from a column has_features) and the prediction. With a
    prediction the history is cut to its first and last lines, and the final answer is asked for.
    """
    analysis = F.when(F.size("analysis") > 0, F.array_join("analysis", "\n")).otherwise(NO_ANALYSIS)
    predicted = F.coalesce("prediction", F.lit("")) != ""
    prediction = F.when(predicted, F.concat(F.format_string("Model Predictions (%d steps):\n", "horizon"), "prediction")).otherwise(NO_PREDICTION)
    known = F.col("has_features") if "has_features" in state.columns else F.coalesce(F.size("analysis") > 0, F.lit(False))
    now = turn_info(known, F.col("prediction").isNotNull())
    cut = truncate_history(state.select("*", F.coalesce("history", F.lit("")).alias("__cut"), now.alias("__now")), "__cut")
    parts = [
        F.format_string("**[Turn %d] Action: %s**", "__now.turn", "__now.action"), F.format_string("### Lookback Window: %d rows", "lookback"), F.format_string("### Forecast Horizon: %d rows", "horizon"),
        F.when(predicted, F.lit("### Historical Data (truncated)")).otherwise("### Historical Data"), F.when(predicted, F.col("__cut")).otherwise(F.coalesce("history", F.lit(""))),
        F.lit("\n### Analysis History"), analysis, F.lit("\n### Model Predictions"), prediction, F.when(predicted, "\n" + INSTRUCTIONS).otherwise("\n" + STATE_CHECK),
    ]
    return cut.select("series_id", F.concat_ws("\n", *parts).alias("prompt"))
