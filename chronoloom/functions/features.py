"""Features of many series at once.

A series frame has the columns series_id, pos (0, 1, ...), ts and value. Every function
returns one row per series unless it says otherwise. All windows and aggregates share one
hash distribution on series_id, so families cost one shuffle together; what is inherently
sequential (spectra, peaks, change points) runs with numpy on one array per series, in Arrow
batches of a bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.decimals import fixed_text
from chronoloom.functions.segmentation import half_widths, median_squared_distance, peaks_of, pelt_rbf  # noqa: F401


def by() -> WindowSpec:
    return Window.partitionBy("series_id")


def ordered() -> WindowSpec:
    return by().orderBy("pos")


def finite(c: Column) -> Column:
    """Null, NaN and infinite values become 0.0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b != 0, b))


def _with_lags(series: DataFrame, *lags: int) -> DataFrame:
    out = series.select("series_id", "pos", "value").withColumn("n", F.count("*").over(by()))
    for k in lags:
        out = out.withColumn(f"lag{k}", F.lag("value", k).over(ordered()))
    return out


# -- basic statistics ---------------------------------------------------------------


def _array() -> Column:
    """The values of a series in order, as an aggregate."""
    return F.array_sort(F.collect_list(F.struct("pos", "value")))["value"]


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType()) for c in names])


def _spectrum(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    power = np.abs(np.fft.fft(x)[: n // 2]) ** 2
    peak = entropy = 0.0
    if len(power) and np.isfinite(power).all():
        peak = float(np.argmax(power)) / n
        total = power.sum()
        share = power[power > 0] / total if total > 0 else np.zeros(0)
        entropy = float(-(share * np.log2(share)).sum()) if len(share) > 1 else 0.0
    return peak, entropy


@F.pandas_udf(_doubles("peak_freq", "spec_entropy"))
def spectrum(values: pd.Series) -> pd.DataFrame:
    """Of arrays of values: peak_freq and spec_entropy of the power at bins 0 .. n // 2 - 1, the mean included."""
    return pd.DataFrame([_spectrum(np.asarray(v, float)) for v in values], columns=["peak_freq", "spec_entropy"])


#: What the tails and the middle of the quantile kurtosis reach to.
_SHARES = (0.025, 0.25, 0.75, 0.975)


def quantile(x: np.ndarray, share: float) -> float:
    """Of sorted values, interpolated as the SQL's engine does, the upper part rounded first and then the sum once:
    ratios of quantiles of decimals may lie on a tie of their text, where the last bit tells the side."""
    at = (len(x) - 1) * share
    low, high = float(x[math.floor(at)]), float(x[math.ceil(at)])
    part = at - math.floor(at)
    if not part or not math.isfinite(low) or not math.isfinite(high):
        return low if low == high or not part else low * (1.0 - part) + high * part
    return math.fma(low, 1.0 - part, high * part)


def _kurtosis(x: np.ndarray) -> float | None:
    x = np.sort(x[~np.isnan(x)])
    if not len(x):
        return None
    tail_low, low, high, tail_high = (quantile(x, s) for s in _SHARES)
    return (tail_high - tail_low) / (high - low) if high != low else None


@F.pandas_udf(T.DoubleType())
def quantile_kurtosis(values: pd.Series) -> pd.Series:
    """Of arrays of values: the width of the middle 95 % over that of the middle half; null where that is 0."""
    return pd.Series([_kurtosis(np.asarray(v, float)) for v in values], dtype=float)


def basic_statistics(series: DataFrame, seasonal_period: int = 24, with_spectrum: bool = True) -> DataFrame:
    """median, mad, acf1, acf_seasonal, cusum_max, qkurt, mean_abs_corr, pca_var_ratio1
    (and peak_freq, spec_entropy). A NaN in a series makes its statistics 0."""
    s = seasonal_period
    x = _with_lags(series, 1, s)
    x = x.withColumn("mu", F.avg("value").over(by())).withColumn("med", F.median("value").over(by()))
    x = x.withColumn("run", F.sum(F.col("value") - F.col("med")).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    d = F.col("value") - F.col("mu")
    lagged = lambda k: F.sum(d * (F.col(f"lag{k}") - F.col("mu")))
    agg = x.groupBy("series_id").agg(
        F.max("n").alias("n"), F.max(F.isnan("value").cast("int")).alias("bad"), F.first("med").alias("median"),
        F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.sum(d * d).alias("ss"), lagged(1).alias("s1"), lagged(s).alias("ss_season"),
        F.max(F.abs("run")).alias("cusum_max"), _array().alias("x"),
    )
    values = {
        "median": F.col("median"), "mad": F.col("mad"), "acf1": ratio(F.col("s1"), F.col("ss")),
        "acf_seasonal": F.when(F.col("n") > s, ratio(F.col("ss_season"), F.col("ss"))), "cusum_max": F.col("cusum_max"),
        "qkurt": F.col("qkurt"),
    }
    out = agg.withColumn("qkurt", quantile_kurtosis("x")).select(
        "series_id", *(F.when(F.col("bad") == 1, 0.0).otherwise(finite(c)).alias(k) for k, c in values.items()), F.lit(0.0).alias("mean_abs_corr"), F.lit(1.0).alias("pca_var_ratio1"),
        *([spectrum("x").alias("f")] if with_spectrum else []),
    )
    return out.select("*", "f.*").drop("f") if with_spectrum else out


# -- dynamics -----------------------------------------------------------------------


def slopes_and_runs(series: DataFrame) -> DataFrame:
    """slope_max, slope_second_diff_max and monotone_duration; 0 for fewer than three points."""
    x = _with_lags(series, 1, 2)
    x = x.withColumn("sign", F.signum(F.col("value") - F.col("lag1")))
    before = F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    breaks = (F.col("pos") > 1) & (F.col("sign") != 0) & (F.col("sign") != F.coalesce(before, F.lit(0.0)))
    x = x.withColumn("run", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("length", F.count(F.when(F.col("pos") > 0, 1)).over(Window.partitionBy("series_id", "run")))
    few = F.col("n") < 3
    agg = x.groupBy("series_id").agg(
        F.max("n").alias("n"), F.max(F.abs(F.col("value") - F.col("lag1"))).alias("d1"),
        F.max(F.abs(F.col("value") - 2 * F.col("lag1") + F.col("lag2"))).alias("d2"), F.max("length").alias("length"),
    )
    values = {"slope_max": F.col("d1"), "slope_second_diff_max": F.col("d2"), "monotone_duration": F.col("length") / F.col("n")}
    return agg.select("series_id", *(F.when(few, 0.0).otherwise(finite(c)).alias(k) for k, c in values.items()))


CHANGES = ("changepoint_count", "changepoint_score")
PEAKS = ("peak_count", "peak_max_width", "peak_spacing_cv")


def _peaks_and_changes(x: np.ndarray, penalty: float, most: int, prominence: float, changes: bool) -> dict[str, float]:
    out = dict.fromkeys((*(CHANGES if changes else ()), *PEAKS), 0.0)
    if changes and len(x) >= 10 and np.isfinite(x).all():
        breaks = pelt_rbf(x, penalty)
        out["changepoint_count"] = float(min(len(breaks) - 1, most))
        if len(breaks) > 1:
            means = [np.cumsum(s)[-1] / len(s) for s in np.split(x, breaks[:-1]) if len(s)]  # in order, as the SQL
            out["changepoint_score"] = float(np.abs(np.diff(means)).max()) if len(means) > 1 else 0.0
    if len(x) >= 3 and np.isfinite(x).all():
        z = (x - x.mean()) / (x.std() + 1e-8)
        peaks, proms = peaks_of(z, prominence)
        out["peak_count"] = float(len(peaks))
        if len(peaks):
            out["peak_max_width"] = float(half_widths(z, peaks, proms).max())
        if len(peaks) > 1:
            gaps = np.diff(peaks)
            out["peak_spacing_cv"] = float(gaps.std() / (gaps.mean() + 1e-8))
    return out


def peaks_and_changes(series: DataFrame, penalty: float = 5.0, most: int = 5, prominence: float = 1.0, changes: bool = True) -> DataFrame:
    """changepoint_count, changepoint_score (unless not ``changes``), peak_count, peak_max_width, peak_spacing_cv.

    Sequential in each series, parallel over series; a million points of noise take a task some 17 s for
    change points and less than a second for peaks.
    """
    names = (*(CHANGES if changes else ()), *PEAKS)

    @F.pandas_udf(_doubles(*names))
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_peaks_and_changes(np.asarray(v, float), penalty, most, prominence, changes) for v in values], columns=list(names))

    return series.groupBy("series_id").agg(_array().alias("x")).select("series_id", run("x").alias("f")).select("series_id", "f.*")


def channel_dynamics(series: DataFrame, penalty: float = 5.0, most: int = 5, prominence: float = 1.0, changes: bool = True) -> DataFrame:
    return slopes_and_runs(series).join(peaks_and_changes(series, penalty, most, prominence, changes).hint("shuffle_merge"), "series_id")


# -- residuals ----------------------------------------------------------------------


def _residual_rows(series: DataFrame, order: int) -> DataFrame:
    """(series_id, pos, residual) of all points, null for the first ``order`` ones."""
    if order == 1:
        x = _with_lags(series, 1)
        pair = F.col("lag1").isNotNull() & F.col("value").isNotNull()
        y, z = F.when(pair, F.col("value")), F.when(pair, F.col("lag1"))
        x = x.withColumn("my", F.avg(y).over(by())).withColumn("mz", F.avg(z).over(by()))
        dy, dz = F.col("value") - F.col("my"), F.when(pair, F.col("lag1")) - F.col("mz")
        x = x.withColumn("slope", ratio(F.sum(dy * dz).over(by()), F.sum(dz * dz).over(by())))
        fitted = F.col("my") + F.coalesce("slope", F.lit(0.0)) * (F.col("lag1") - F.col("mz"))
        return x.select("series_id", "pos", (F.col("value") - fitted).alias("residual"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["value"].to_numpy(float)
        residual = np.full(len(x), None, object)
        if len(x) > order:
            design = np.column_stack([np.ones(len(x) - order), *(x[order - k : len(x) - k] for k in range(1, order + 1))])
            residual[order:] = x[order:] - design @ np.linalg.lstsq(design, x[order:], rcond=None)[0]
        return pdf[["series_id", "pos"]].assign(residual=residual)

    return series.select("series_id", "pos", "value").groupBy("series_id").applyInPandas(one, "series_id string, pos int, residual double")


def ar_residuals(series: DataFrame, order: int = 1) -> DataFrame:
    """(series_id, pos, residual) of an autoregression with intercept; pos >= order.

    Order 1 is a window regression; a constant series has residuals 0. Higher orders are least
    squares in a grouped map.
    """
    return _residual_rows(series, order).filter(F.col("pos") >= order)


def residual_diagnostics(series: DataFrame, order: int = 1) -> DataFrame:
    """residual_mean, _max, _exceed_ratio, _acf1, _concentration; 0 for n <= order + 2."""
    by_size = by().orderBy(F.abs("residual").asc_nulls_last(), "pos")
    r = _residual_rows(series, order).select(
        "series_id", "residual", F.count("residual").over(by()).alias("m"), F.avg("residual").over(by()).alias("mu"), F.stddev_pop("residual").over(by()).alias("sd"),
        F.lag("residual").over(ordered()).alias("lag"), F.row_number().over(by_size).alias("rank"),
    )
    size, d = F.abs("residual"), F.col("residual") - F.col("mu")
    agg = r.groupBy("series_id").agg(
        F.max("m").alias("m"), F.first("mu").alias("residual_mean"), F.max(size).alias("residual_max"),
        F.avg((size > 2 * (F.col("sd") + 1e-8)).cast("double")).alias("residual_exceed_ratio"),
        ratio(F.sum(d * (F.col("lag") - F.col("mu"))), F.sum(d * d)).alias("residual_acf1"),
        (F.sum(F.when(F.col("rank") > F.floor(0.9 * F.col("m")), size)) / (F.sum(size) + 1e-8)).alias("residual_concentration"),
    )
    names = ("residual_mean", "residual_max", "residual_exceed_ratio", "residual_acf1", "residual_concentration")
    return agg.select("series_id", *(F.when(F.col("m") <= 2, 0.0).otherwise(finite(F.col(c))).alias(c) for c in names))


# -- quality ------------------------------------------------------------------------


def data_quality(series: DataFrame, bins: int = 25, tolerance: float = 1e-3) -> DataFrame:
    """Shares of the fullest bin, of points near the extremes, of constant channels, of gaps."""
    x = series.select("series_id", "value", F.min("value").over(by()).alias("low"), F.max("value").over(by()).alias("high"), F.count("*").over(by()).alias("n"))
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    x = x.withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), F.width_bucket("value", "low", "high", F.lit(bins)))).otherwise(1))
    x = x.withColumn("in_bin", F.count("*").over(Window.partitionBy("series_id", "bin")))
    span = F.greatest((F.col("high") - F.col("low")) * 0.01, F.lit(tolerance))
    agg = x.groupBy("series_id").agg(
        F.max(odd.cast("int")).alias("bad"), (F.max("in_bin") / F.max("n")).alias("quality_quantization_score"),
        F.avg(((F.col("value") <= F.col("low") + span) | (F.col("value") >= F.col("high") - span)).cast("double")).alias("quality_saturation_ratio"),
        F.when(F.stddev_pop("value") < tolerance, 1.0).otherwise(0.0).alias("quality_constant_channel_ratio"), F.avg(odd.cast("double")).alias("quality_dropout_ratio"),
    )
    guard = lambda c: F.when(F.col("bad") == 1, 0.0).otherwise(finite(F.col(c))).alias(c)
    return agg.select("series_id", *(guard(c) for c in ("quality_quantization_score", "quality_saturation_ratio", "quality_constant_channel_ratio")), "quality_dropout_ratio")


# -- events -------------------------------------------------------------------------


def event_segments(series: DataFrame, most: int = 8) -> DataFrame:
    """(series_id, segment, first_pos, last_pos): segments between jumps of the slope.

    Neighbours share their end point. If fewer than three remain, thirds take their place, which
    do not overlap; a series of fewer than four points is one segment.
    """
    x = _with_lags(series, 1, 2)
    x = x.withColumn("jump", F.stddev_pop(F.col("value") - F.col("lag1")).over(by()) * 1.5 + 1e-6)
    # the slope between pos - 1 and pos has index pos - 1, so a cut at slope i is seen from pos i + 1
    x = x.withColumn("cut", F.when((F.col("pos") >= 2) & (F.abs(F.col("value") - 2 * F.col("lag1") + F.col("lag2")) > F.col("jump")), F.col("pos") - 1))
    cuts = x.groupBy("series_id").agg(F.max("n").cast("int").alias("n"), F.array_sort(F.collect_set("cut")).alias("cuts"))
    return segments_of(cuts, most)


def segments_of(cuts: DataFrame, most: int) -> DataFrame:
    """Segments from (series_id, n, cuts); of the cuts, in order, the first ``most`` are enough."""
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3).cast("int"))
    edges = F.concat(F.array(F.lit(0)), F.col("cuts"), F.array(F.col("n") - 1))
    between = F.slice(F.transform(F.slice(edges, 2, F.size(edges)), lambda e, i: F.struct(F.get(edges, i).alias("a"), e.alias("b"))), 1, most)
    thirds = F.array(F.struct(F.lit(0).alias("a"), (third - 1).alias("b")), F.struct(third.alias("a"), (2 * third - 1).alias("b")), F.struct((2 * third).alias("a"), (F.col("n") - 1).alias("b")))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    chosen = F.when(F.col("n") < 4, whole).when(F.size(between) < 3, thirds).otherwise(between)
    return cuts.select("series_id", F.posexplode(chosen).alias("segment", "s")).select("series_id", "segment", F.col("s.a").alias("first_pos"), F.col("s.b").alias("last_pos"))


def event_summary(series: DataFrame) -> DataFrame:
    """event_segment_count, event_counts (rise, fall, flat, oscillation) and event_dominant_pattern."""
    segments = event_segments(series)
    points = series.select("series_id", "pos", "value").withColumn("limit", F.stddev_pop("value").over(by()) * 0.05 + 1e-6)
    inside = segments.join(points, "series_id").filter("pos between first_pos and last_pos")
    each = inside.groupBy("series_id", "segment").agg(
        F.count("*").alias("n"), F.first("limit").alias("limit"), F.stddev_pop("value").alias("sd"), (F.max_by("value", "pos") - F.min_by("value", "pos")).alias("slope")
    )
    return summary_of(segments, each)


def summary_of(segments: DataFrame, each: DataFrame) -> DataFrame:
    """Counts of kinds from the segments and, of each, (series_id, segment, n, limit, sd, slope)."""
    kind = F.when(F.col("n") < 2, None).when(F.col("slope") > F.col("limit"), 0).when(F.col("slope") < -F.col("limit"), 1).when(F.col("sd") > 2 * F.col("limit"), 3).otherwise(2)
    counts = each.withColumn("kind", kind).groupBy("series_id").agg(F.array(*(F.sum((F.col("kind") == k).cast("double")) for k in range(4))).alias("c"))
    counts = counts.withColumn("c", F.transform("c", lambda v: F.coalesce(v, F.lit(0.0))))
    total = segments.groupBy("series_id").agg(F.count("*").cast("double").alias("event_segment_count"))
    return total.join(counts, "series_id").select("series_id", "event_segment_count", F.col("c").alias("event_counts"), (F.array_position("c", F.array_max("c")) - 1).cast("double").alias("event_dominant_pattern"))


# -- reports and the table of all -----------------------------------------------------


#: Titles, labels and formats of the reports, which agents read (fixed values).
REPORTS = {
    "basic": ("Basic Statistics:", {
        "median": ("Median", "%.4f"), "mad": ("MAD", "%.4f"), "acf1": ("ACF(1)", "%.4f"), "acf_seasonal": ("ACF(seasonal)", "%.4f"), "peak_freq": ("Peak Frequency", "%.4f"),
        "spec_entropy": ("Spectral Entropy", "%.4f"), "cusum_max": ("CUSUM Max", "%.4f"), "qkurt": ("Quantile Kurtosis", "%.4f"),
    }),
    "dynamics": ("Within-Channel Dynamics:", {
        "changepoint_count": ("Changepoint Count", "%.1f"), "changepoint_score": ("Changepoint Score", "%.4f"), "slope_max": ("Max Slope", "%.4f"), "slope_second_diff_max": ("Max Second Diff", "%.4f"),
        "monotone_duration": ("Monotone Duration", "%.4f"), "peak_count": ("Peak Count", "%.1f"), "peak_max_width": ("Peak Max Width", "%.4f"), "peak_spacing_cv": ("Peak Spacing CV", "%.4f"),
    }),
    "residuals": ("Forecast Residuals:", {
        "residual_mean": ("Residual Mean", "%.4f"), "residual_max": ("Residual Max", "%.4f"), "residual_exceed_ratio": ("Exceed Ratio", "%.4f"), "residual_acf1": ("ACF(1)", "%.4f"), "residual_concentration": ("Concentration", "%.4f"),
    }),
    "quality": ("Data Quality:", {
        "quality_quantization_score": ("Quantization Score", "%.4f"), "quality_saturation_ratio": ("Saturation Ratio", "%.4f"), "quality_constant_channel_ratio": ("Constant Channel Ratio", "%.4f"), "quality_dropout_ratio": ("Dropout Ratio", "%.4f"),
    }),
    "events": ("Event Summary:", {
        "event_segment_count": ("Segment Count", "%.1f"), "rises": ("Rise Events", "%.1f"), "falls": ("Fall Events", "%.1f"), "flats": ("Flat Events", "%.1f"), "oscillations": ("Oscillation Events", "%.1f"),
    }),
}
PATTERNS, DOMINANT = ("rise", "fall", "flat", "oscillation"), "Dominant Pattern"


def shown(c: Column, fmt: str) -> Column:
    """A number as text, rounded as its exact value demands; what rounds to zero has no sign."""
    return fixed_text(c, int(fmt[2]), signed_zero=False)


def report(features: DataFrame, family: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, report): a title and one line per feature, as agents read them; lines of features ``without`` are left out."""
    title, labels = REPORTS[family]
    labels = {c: v for c, v in labels.items() if c not in without}
    lines = [F.lit(title), *(F.concat(F.lit(f"  {label}: "), shown(_feature(c), fmt)) for c, (label, fmt) in labels.items())]
    if family == "events":
        lines.append(F.concat(F.lit(f"  {DOMINANT}: "), F.get(F.array(*map(F.lit, PATTERNS)), F.col("event_dominant_pattern").cast("int"))))
    return features.select("series_id", F.concat_ws("\n", *lines).alias("report"))


def _feature(name: str) -> Column:
    kinds = ("rises", "falls", "flats", "oscillations")
    return F.get("event_counts", F.lit(kinds.index(name))) if name in kinds else F.col(name)


FAMILIES = {"basic": basic_statistics, "dynamics": channel_dynamics, "residuals": residual_diagnostics, "quality": data_quality, "events": event_summary}


def feature_table(series: DataFrame, families: tuple[str, ...] | list[str] = tuple(FAMILIES), changes: bool = True) -> DataFrame:
    """All chosen families side by side, for series of two points or more; change points only with ``changes``.

    The families use the same columns of the same rows, so their shuffle is one that is reused, and
    their rows meet where they are.
    """
    kept = series.select("series_id", "pos", "value").withColumn("__n", F.count("*").over(by())).filter("__n >= 2").drop("__n")
    out = None
    for family in families:
        one = FAMILIES[family](kept, **({} if changes or family != "dynamics" else {"changes": False}))
        out = one if out is None else out.join(one.hint("shuffle_merge"), "series_id")
    return kept.select("series_id").distinct() if out is None else out
