"""The features of series that don't fit one task: slices, summaries of slices, and a scan over them.

A series is cut into slices of ``rows`` points; each carries a few points of the slice before
(its halo), so that lags are at hand. Windows and aggregates go over (series, slice). What a slice
leaves is a row that merges with others: counts, means with squares about them, extremes, the first
and last sign of a slope, places of breaks, sums. A scan over these rows, one for every ``rows`` points,
adds what comes from the slices before. Facts of a whole series that its points need
(a mean, a median, coefficients) are few rows and are joined back to them. Quantiles come from ranks
in a global order. A series that holds most points is therefore many tasks' work at every step.

Results are those of the functions of the same names in ``features``, to the rounding of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.features import by, finite, ratio, segments_of, summary_of
from chronoloom.operators.ranges import beside, numbered, order_statistics
from chronoloom.sources.storage import stash

#: Points of a slice.
ROWS = 1 << 16


def sliced(series: DataFrame, rows: int, halo: int) -> DataFrame:
    """(series_id, pos, value, slice, own): each point in its slice, and without ``own`` in those that need it as a neighbour."""
    slice_of = lambda pos: F.floor(pos / rows)
    out = series.select("series_id", "pos", "value", F.explode(F.sequence(slice_of(F.col("pos")), slice_of(F.col("pos") + halo))).alias("slice"))
    return out.withColumn("own", F.col("slice") == slice_of(F.col("pos")))


def _in_slice():
    return Window.partitionBy("series_id", "slice").orderBy("pos")


def _before():
    return _in_slice().rowsBetween(Window.unboundedPreceding, -1)


def _slices_before():
    return Window.partitionBy("series_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def _own(c: Column) -> Column:
    return F.when(F.col("own"), c)


# -- slopes and runs ------------------------------------------------------------------


def slopes_and_runs(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """slope_max, slope_second_diff_max and monotone_duration; 0 for fewer than three points.

    A run breaks where the slope's sign differs from the last that was not zero. Of a slice, only the
    first such sign depends on what came before.
    """
    x = sliced(series, rows, 2).withColumn("lag1", F.lag("value", 1).over(_in_slice())).withColumn("lag2", F.lag("value", 2).over(_in_slice()))
    sign = F.signum(F.col("value") - F.col("lag1"))
    x = x.withColumn("turn", F.when(F.col("own") & (sign != 0), sign))
    x = x.withColumn("before", F.last("turn", ignorenulls=True).over(_before()))
    x = x.withColumn("break", F.when(F.col("turn").isNotNull() & F.col("before").isNotNull() & (F.col("turn") != F.col("before")) & (F.col("pos") > 1), F.col("pos")))
    x = x.withColumn("inner", F.col("break") - F.last("break", ignorenulls=True).over(_before()))
    first = F.col("turn").isNotNull() & F.col("before").isNull()
    per = x.groupBy("series_id", "slice").agg(
        F.count_if("own").alias("n"), F.max(_own(F.abs(F.col("value") - F.col("lag1")))).alias("d1"), F.max(_own(F.abs(F.col("value") - 2 * F.col("lag1") + F.col("lag2")))).alias("d2"),
        F.max(F.when(first, F.col("pos"))).alias("first_pos"), F.max(F.when(first, F.col("turn"))).alias("first_sign"), F.max_by("turn", F.when(F.col("turn").isNotNull(), F.col("pos"))).alias("last_sign"),
        F.min("break").alias("low"), F.max("break").alias("high"), F.max("inner").alias("inner"),
    )
    came = F.coalesce(F.last("last_sign", ignorenulls=True).over(_slices_before()), F.lit(0.0))
    per = per.withColumn("entry", F.when((F.col("first_pos") > 1) & (F.col("first_sign") != came), F.col("first_pos")))
    per = per.withColumn("start", F.coalesce("entry", "low")).withColumn("end", F.coalesce("high", "entry"))
    per = per.withColumn("gap", F.col("start") - F.coalesce(F.last("end", ignorenulls=True).over(_slices_before()), F.lit(1)))
    agg = per.groupBy("series_id").agg(F.sum("n").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.greatest(F.max("gap"), F.max(F.col("low") - F.col("entry")), F.max("inner"), F.sum("n") - F.coalesce(F.max("end"), F.lit(1))).alias("length"))
    values = {"slope_max": F.col("d1"), "slope_second_diff_max": F.col("d2"), "monotone_duration": F.col("length") / F.col("n")}
    return agg.select("series_id", *(F.when(F.col("n") < 3, 0.0).otherwise(finite(c)).alias(k) for k, c in values.items()))


# -- basic statistics -------------------------------------------------------------------


def _lag_products(x: DataFrame, value: str, lags: list[int]) -> DataFrame:
    """(series_id, n, bad, mean, square, product<k>...): sums of squares about the mean, and of products with the
    value ``k`` before, of slices with their own centres moved to the series' mean."""
    x = x.withColumns({f"lag{k}": F.lag(value, k).over(_in_slice()) for k in lags}).withColumn("m", F.avg(_own(F.col(value))).over(Window.partitionBy("series_id", "slice")))
    d = _own(F.col(value) - F.col("m"))
    back = lambda k: F.col(f"lag{k}") - F.col("m")
    per = x.groupBy("series_id", "slice").agg(
        F.count(_own(F.col(value))).alias("n"), F.first("m").alias("m"), F.max(_own(F.isnan(value).cast("int"))).alias("bad"), F.sum(d * d).alias("s"),
        *(a for k in lags for a in (F.count(d + back(k)).alias(f"n{k}"), F.sum(d * back(k)).alias(f"s{k}"), F.sum(d + back(k)).alias(f"t{k}"))),
    )
    per = per.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(by()) / F.sum("n").over(by()))
    off = F.col("m") - F.col("mean")
    return per.groupBy("series_id").agg(
        F.sum("n").alias("n"), F.max("bad").alias("bad"), F.first("mean").alias("mean"), F.sum(F.col("s") + F.col("n") * off * off).alias("square"),
        *(F.sum(F.col(f"s{k}") + off * F.col(f"t{k}") + F.col(f"n{k}") * off * off).alias(f"product{k}") for k in lags),
    )


def basic_statistics(series: DataFrame, seasonal_period: int = 24, rows: int = ROWS) -> DataFrame:
    """median, mad, acf1, acf_seasonal, cusum_max and qkurt. A NaN in a series makes its statistics 0."""
    s = seasonal_period
    products = _lag_products(sliced(series, rows, s), "value", [1, s])
    quantiles = stash(order_statistics(series, "value", {"median": 0.5, "q1": 0.025, "q2": 0.25, "q3": 0.75, "q4": 0.975}), "quantiles")
    centred = beside(series.select("series_id", "pos", "value"), quantiles.select("series_id", "median"), "series_id").withColumn("value", F.col("value") - F.col("median"))
    mad = order_statistics(centred.withColumn("value", F.abs("value")), "value", {"mad": 0.5})
    # running sums within slices, then those of the slices before
    run = sliced(centred, rows, 0).withColumn("run", F.sum("value").over(_in_slice()))
    per = run.groupBy("series_id", "slice").agg(F.sum("value").alias("total"), F.min("run").alias("low"), F.max("run").alias("high"))
    came = F.coalesce(F.sum("total").over(_slices_before()), F.lit(0.0))
    cusum = per.select("series_id", F.greatest(F.abs(came + F.col("low")), F.abs(came + F.col("high"))).alias("c")).groupBy("series_id").agg(F.max("c").alias("cusum_max"))
    every = products.join(quantiles, "series_id").join(mad, "series_id").join(cusum, "series_id")
    values = {
        "median": F.col("median"), "mad": F.col("mad"), "acf1": ratio(F.col("product1"), F.col("square")), "acf_seasonal": F.when(F.col("n") > s, ratio(F.col(f"product{s}"), F.col("square"))),
        "cusum_max": F.col("cusum_max"), "qkurt": ratio(F.col("q4") - F.col("q1"), F.col("q3") - F.col("q2")),
    }
    return every.select("series_id", *(F.when(F.col("bad") == 1, 0.0).otherwise(finite(c)).alias(k) for k, c in values.items()))


# -- residuals ----------------------------------------------------------------------------


def ar_residuals(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """(series_id, pos, residual) of an autoregression of order 1 with intercept; pos >= 1."""
    x = sliced(series, rows, 1).withColumn("lag1", F.lag("value").over(_in_slice())).filter("own")
    pair = F.col("lag1").isNotNull() & F.col("value").isNotNull()
    y, z = F.when(pair, F.col("value")), F.when(pair, F.col("lag1"))
    # means and moments about them merge from task to task
    fit = x.groupBy("series_id").agg(F.avg(y).alias("my"), F.avg(z).alias("mz"), (F.covar_pop(y, z) * F.count(y)).alias("yz"), (F.var_pop(z) * F.count(z)).alias("zz"))
    fit = fit.select("series_id", "my", "mz", F.coalesce(ratio(F.col("yz"), F.col("zz")), F.lit(0.0)).alias("slope"))
    fitted = F.col("my") + F.col("slope") * (F.col("lag1") - F.col("mz"))
    return beside(x, fit, "series_id").select("series_id", "pos", (F.col("value") - fitted).alias("residual")).filter("pos >= 1")


def residual_diagnostics(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """residual_mean, _max, _exceed_ratio, _acf1, _concentration; 0 for two residuals or fewer."""
    residuals = stash(ar_residuals(series, rows), "residuals")
    products = _lag_products(sliced(residuals.withColumnRenamed("residual", "value"), rows, 1), "value", [1])
    facts = products.withColumn("sd", F.sqrt(F.col("square") / F.col("n"))).select("series_id", F.col("n").alias("m"), F.col("mean").alias("residual_mean"), "sd", ratio(F.col("product1"), F.col("square")).alias("residual_acf1"))
    facts = stash(facts, "residual-facts")
    size = F.abs("residual")
    ranked = numbered(residuals.select("series_id", "pos", "residual", size.alias("size")).filter("size is not null"), ["series_id"], ["size", "pos"], "rank")
    tail = beside(ranked, facts.select("series_id", "m", "sd"), "series_id").groupBy("series_id").agg(
        F.max("size").alias("residual_max"), F.avg((F.col("size") > 2 * (F.col("sd") + 1e-8)).cast("double")).alias("residual_exceed_ratio"),
        (F.sum(F.when(F.col("rank") + 1 > F.floor(0.9 * F.col("m")), F.col("size"))) / (F.sum("size") + 1e-8)).alias("residual_concentration"),
    )
    names = ("residual_mean", "residual_max", "residual_exceed_ratio", "residual_acf1", "residual_concentration")
    every = series.select("series_id").distinct().join(facts, "series_id", "left").join(tail, "series_id", "left")
    return every.select("series_id", *(F.when(F.coalesce("m", F.lit(0)) <= 2, 0.0).otherwise(finite(F.col(c))).alias(c) for c in names))


# -- quality --------------------------------------------------------------------------------


def data_quality(series: DataFrame, bins: int = 25, tolerance: float = 1e-3) -> DataFrame:
    """Shares of the fullest bin, of points near the extremes, of constant channels, of gaps."""
    value = F.col("value")
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    facts = series.groupBy("series_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.max(odd.cast("int")).alias("bad"),
        F.when(F.stddev_pop("value") < tolerance, 1.0).otherwise(0.0).alias("quality_constant_channel_ratio"), F.avg(odd.cast("double")).alias("quality_dropout_ratio"),
    )
    facts = stash(facts, "quality-facts")
    x = beside(series.select("series_id", "value"), facts.select("series_id", "low", "high"), "series_id")
    x = x.withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), F.width_bucket("value", "low", "high", F.lit(bins)))).otherwise(1))
    span = F.greatest((F.col("high") - F.col("low")) * 0.01, F.lit(tolerance))
    near = (value <= F.col("low") + span) | (value >= F.col("high") - span)
    counts = x.groupBy("series_id", "bin").agg(F.count("*").alias("c"), F.sum(near.cast("double")).alias("near"), F.count(near).alias("seen"))
    agg = counts.groupBy("series_id").agg(F.max("c").alias("c"), (F.sum("near") / F.sum("seen")).alias("quality_saturation_ratio")).join(facts, "series_id")
    agg = agg.withColumn("quality_quantization_score", F.col("c") / F.col("n"))
    guard = lambda c: F.when(F.col("bad") == 1, 0.0).otherwise(finite(F.col(c))).alias(c)
    return agg.select("series_id", *(guard(c) for c in ("quality_quantization_score", "quality_saturation_ratio", "quality_constant_channel_ratio")), "quality_dropout_ratio")


# -- events ---------------------------------------------------------------------------------


def event_segments(series: DataFrame, most: int = 8, rows: int = ROWS) -> DataFrame:
    """(series_id, segment, first_pos, last_pos) as in ``features``. Only the first ``most`` cuts of a series can
    bound a segment, so each task keeps no more of them."""
    x = sliced(series, rows, 2).withColumn("lag1", F.lag("value", 1).over(_in_slice())).withColumn("lag2", F.lag("value", 2).over(_in_slice())).filter("own")
    facts = x.groupBy("series_id").agg(F.count("*").cast("int").alias("n"), (F.stddev_pop(F.col("value") - F.col("lag1")) * 1.5 + 1e-6).alias("jump"))
    facts = stash(facts, "segment-facts")
    jumps = beside(x, facts.select("series_id", "jump"), "series_id").filter((F.col("pos") >= 2) & (F.abs(F.col("value") - 2 * F.col("lag1") + F.col("lag2")) > F.col("jump")))
    early = jumps.select("series_id", (F.col("pos") - 1).alias("cut")).withColumn("nth", F.row_number().over(Window.partitionBy("series_id").orderBy("cut"))).filter(F.col("nth") <= most)
    cuts = facts.select("series_id", "n").join(early.groupBy("series_id").agg(F.array_sort(F.collect_list("cut")).alias("cuts")), "series_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    return segments_of(cuts, most)


def event_summary(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """event_segment_count, event_counts (rise, fall, flat, oscillation) and event_dominant_pattern."""
    segments = stash(event_segments(series, rows=rows), "segments")
    limit = series.groupBy("series_id").agg((F.stddev_pop("value") * 0.05 + 1e-6).alias("limit"))
    spans = segments.groupBy("series_id").agg(F.collect_list(F.struct("segment", "first_pos", "last_pos")).alias("spans")).join(limit, "series_id")
    inside = F.filter("spans", lambda s: F.col("pos").between(s["first_pos"], s["last_pos"]))
    x = beside(series.select("series_id", "pos", "value"), stash(spans, "spans"), "series_id").select("series_id", "pos", "value", "limit", F.explode(inside).alias("s"))
    each = x.groupBy("series_id", F.col("s.segment").alias("segment")).agg(
        F.count("*").alias("n"), F.first("limit").alias("limit"), F.stddev_pop("value").alias("sd"), (F.max_by("value", "pos") - F.min_by("value", "pos")).alias("slope")
    )
    return summary_of(segments, each)
