"""Windows, normalisation, patches, horizons and forecasters for many series at once."""

from __future__ import annotations

import contextlib
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.arma import fit_orders, inside
from chronoloom.sources.series_text import _plus_seconds


def extend_timestamps(series: DataFrame, horizon: int, rule: str = "first", default_seconds: int = 3600) -> DataFrame:
    """(series_id, step, ts): times after the last, in steps of the first or the last gap."""
    w = Window.partitionBy("series_id").orderBy("pos")
    gaps = series.select("series_id", "pos", "ts", F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")).alias("gap"))
    pick = F.min_by if rule == "first" else F.max_by
    ends = gaps.groupBy("series_id").agg(F.max_by("ts", "pos").alias("last"), pick(F.when(F.col("gap").isNotNull(), F.col("gap")), F.when(F.col("gap").isNotNull(), F.col("pos"))).alias("gap"))
    ends = ends.select("series_id", "last", (F.coalesce("gap", F.lit(default_seconds * 1_000_000)) / 1_000_000).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    return ends.select("series_id", "step", _plus_seconds(F.col("last"), F.col("s") * (F.col("step") + 1)).alias("ts"))


def make_windows(series: DataFrame, lookback: int = 168, horizon: int = 24, stride: int | None = None) -> DataFrame:
    """(series_id, window, part, pos, ts, value): context and target pairs.

    Window k starts at pos k * stride. A point knows the windows that it is in, so there is no join;
    ``pos`` counts from 0 in each part.
    """
    stride = stride or horizon
    span = lookback + horizon
    n = F.max("pos").over(Window.partitionBy("series_id")) + 1
    x = series.withColumn("n", n)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (span - 1)) / stride)).cast("int")
    high = F.least(F.floor(F.col("pos") / stride), F.floor((F.col("n") - span) / stride)).cast("int")
    x = x.filter((F.col("n") >= span) & (low <= high)).withColumn("window", F.explode(F.sequence(low, high)))
    at = F.col("pos") - F.col("window") * stride
    return x.select("series_id", "window", F.when(at < lookback, "context").otherwise("target").alias("part"), F.when(at < lookback, at).otherwise(at - lookback).cast("int").alias("pos"), "ts", "value")


def windows_as_series(windows: DataFrame, part: str = "context") -> DataFrame:
    """One part of the windows as series of their own, named series_id#window."""
    return windows.filter(F.col("part") == part).select(F.concat_ws("#", "series_id", "window").alias("series_id"), "pos", "ts", "value")


def instance_normalize(series: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Adds mean, scale = sqrt(population variance + eps) and norm."""
    w = Window.partitionBy("series_id")
    out = series.withColumn("mean", F.avg("value").over(w)).withColumn("scale", F.sqrt(F.var_pop("value").over(w) + eps))
    return out.withColumn("norm", (F.col("value") - F.col("mean")) / F.col("scale"))


def denormalize(df: DataFrame, column: str = "norm") -> DataFrame:
    return df.withColumn("value", F.col(column) * F.col("scale") + F.col("mean"))


def spread(series: DataFrame) -> DataFrame:
    """``series`` dealt by id over all cores. Models cost far more than their series' bytes, by which a small shuffle
    would be merged into one task; a grouping by series afterwards needs no other shuffle."""
    spark = series.sparkSession
    return series.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "series_id")


def value_arrays(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("values"))


def make_patches(arrays: DataFrame, patch_len: int = 16, stride: int = 8) -> DataFrame:
    """(series_id, patch_no, patch): sliding patches after the last value was repeated stride times."""
    padded = F.concat("values", F.array_repeat(F.element_at("values", -1), stride))
    count = F.floor((F.size("values") + stride - patch_len) / stride).cast("int") + 1
    x = arrays.filter(F.size("values") + stride >= patch_len).select("series_id", padded.alias("p"), count.alias("n"))
    return x.select("series_id", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("patch_no")).select("series_id", "patch_no", F.slice("p", F.col("patch_no") * stride + 1, patch_len).alias("patch"))


def median_quantile(df: DataFrame, quantiles: str = "quantiles") -> DataFrame:
    """The middle of (0.1, 0.5, 0.9) as yhat."""
    return df.withColumn("yhat", F.get(quantiles, F.lit(1)))


def sample_median(paths: DataFrame) -> DataFrame:
    """(series_id, step, yhat) from sample paths (series_id, sample, step, value)."""
    return paths.groupBy("series_id", "step").agg(F.percentile("value", F.lit(0.5)).alias("yhat"))


def fit_length(forecasts: DataFrame, horizon: int) -> DataFrame:
    """(series_id, step, yhat) of exactly ``horizon`` steps: cut, or continued with the last value."""
    kept = forecasts.filter(F.col("step") < horizon)
    ends = kept.groupBy("series_id").agg(F.max("step").alias("last"), F.max_by("yhat", "step").alias("yhat"))
    more = ends.filter(F.col("last") < horizon - 1).select("series_id", F.explode(F.sequence(F.col("last") + 1, F.lit(horizon - 1))).alias("step"), "yhat")
    return kept.select("series_id", "step", "yhat").unionByName(more)


def forecast_naive(series: DataFrame, horizon: int) -> DataFrame:
    """(series_id, model, step, ts, yhat): the last value again."""
    last = series.groupBy("series_id").agg(F.max_by("value", "pos").alias("yhat"))
    return extend_timestamps(series, horizon).join(last, "series_id").select("series_id", F.lit("naive").alias("model"), "step", "ts", "yhat")


def forecast_seasonal_naive(series: DataFrame, horizon: int, season: int = 24) -> DataFrame:
    """The value one season before; shorter series take their last value."""
    w = Window.partitionBy("series_id")
    tail = series.withColumn("back", F.max("pos").over(w) - F.col("pos")).filter(F.col("back") < season)
    tail = tail.withColumn("n", F.count("*").over(w)).withColumn("lastv", F.max_by("value", "pos").over(w))
    full = tail.filter(F.col("n") == season).select("series_id", (season - 1 - F.col("back")).cast("int").alias("phase"), "value")
    short = tail.groupBy("series_id").agg(F.first("lastv").alias("lastv"))
    steps = extend_timestamps(series, horizon).withColumn("phase", F.col("step") % season).join(short, "series_id").join(full, ["series_id", "phase"], "left")
    return steps.select("series_id", F.lit("seasonal_naive").alias("model"), "step", "ts", F.coalesce("value", "lastv").alias("yhat"))


# -- ARIMA --------------------------------------------------------------------------

#: Candidate orders (p, q) for given d, in the order in which they are tried (fixed values).
CANDIDATES = ((1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (0, 1), (1, 0), (5, 0), (0, 5))
#: The order (p, d, q) where no candidate can be fitted (fixed value).
FALLBACK = (1, 1, 1)
#: Polynomial of the published surface: the unit root test's statistic to the normal quantile of its
#: asymptotic p-value, with a constant (fixed values).
_SURFACE = (2.1659, 1.4412, 0.038269)


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta


def _unit_root_design(x: np.ndarray, lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Constant, level and lagged differences, and the differences they explain, from the ``start``-th on."""
    d = np.diff(x)
    m = len(d) - start
    return np.column_stack([np.ones(m), x[start : start + m], *(d[start - k : start - k + m] for k in range(1, lags + 1))]), d[start:]


def stationarity(x: np.ndarray) -> int:
    """0 if the augmented test (with a constant) rejects a unit root at 5 %, else 1; 1 where it can't be made.

    Lags: of 0 to min(10, n // 3) those of the least AIC on the points that all of them have (of
    equal ones the fewest); the test itself uses all points that these lags leave.
    """
    n = len(x)
    most = min(10, n // 3)
    if most > n // 2 - 2 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return 1
    best = None
    for lags in range(most + 1):
        design, y = _unit_root_design(x, lags, most)
        r = _least_squares(design, y)[1]
        aic = len(y) * np.log(max(float(r @ r) / len(y), 1e-300)) + 2 * design.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    design, y = _unit_root_design(x, best[1], best[1])
    if len(y) <= design.shape[1]:
        return 1
    beta, e = _least_squares(design, y)
    cov = np.linalg.pinv(design.T @ design) * (e @ e) / (len(y) - design.shape[1])
    if not cov[1, 1] > 0:
        return 1
    t = float(beta[1] / np.sqrt(cov[1, 1]))
    if t > 2.74:  # beyond the surface, whose p-value is 1
        return 1
    quantile = sum(c * max(t, -18.83) ** k for k, c in enumerate(_SURFACE))
    return int(0.5 * math.erfc(-quantile / math.sqrt(2)) >= 0.05)


def _long_residuals(x: np.ndarray, constant: bool, k: int) -> np.ndarray:
    """Residuals of a long autoregression; the first ``k`` are 0."""
    e = np.zeros(len(x))
    lags = [x[k - j : len(x) - j] for j in range(1, k + 1)]
    e[k:] = _least_squares(np.column_stack([np.ones(len(x) - k)] * constant + lags), x[k:])[1]
    return e


def start_values(x: np.ndarray, p: int, q: int, constant: bool = True, least: int = 5) -> np.ndarray:
    """Mean if ``constant``, then coefficients of ARMA(p, q): long autoregression first, then least squares on
    lagged values and lagged residuals; drawn to zero until they are stationary and invertible.

    Too few points are an error; orders up to ``least`` need as many.
    """
    n = len(x)
    most = max(p, q, least)
    k = min(most + 5, n // 4)
    start = k + most
    m, c = n - start, int(constant)
    if k < 1 or m < p + q + c + 3:
        raise ValueError("too few points")
    e = _long_residuals(x, constant, k)
    design = np.column_stack([np.ones((m, c)), *(x[start - j : n - j] for j in range(1, p + 1)), *(e[start - j : n - j] for j in range(1, q + 1))])
    beta = _least_squares(design, x[start:])[0]
    if not np.isfinite(beta).all():
        raise ValueError("no estimate")
    ar, ma = beta[c : c + p], beta[c + p :]
    for part, sign in ((ar, 1), (ma, -1)):
        while not inside(sign * part):
            part *= 0.9 ** np.arange(1, len(part) + 1)
    return np.concatenate([[x.mean()] * c, ar, ma])


def arima_search(x: np.ndarray, candidates=CANDIDATES) -> tuple[tuple[int, int, int] | None, float | None, Callable[[int], np.ndarray]]:
    """The order (p, d, q) of the least AIC by exact likelihood (of equal ones the first), that AIC, and a forecaster of x.

    A constant is part of models with d = 0 alone, so differenced series don't drift. Where no
    candidate can be fitted, ``FALLBACK`` is tried; where that fails too, the order is None and the
    last value goes on.
    """
    if np.isfinite(x).all():
        d = stationarity(x)
        for orders, at, least in ((candidates, d, 5), ([(FALLBACK[0], FALLBACK[2])], FALLBACK[1], 1)):
            y, starts = np.diff(x) if at else x, {}
            for p, q in orders:
                with contextlib.suppress(ValueError, np.linalg.LinAlgError):
                    starts[p, q] = start_values(y, p, q, not at, least)
            try:
                found = fit_orders(y, starts, not at) if starts else []
            except np.linalg.LinAlgError:
                found = []
            if found:
                best = min(found, key=lambda f: f.aic)
                return (best.p, at, best.q), best.aic, (lambda h: x[-1] + np.cumsum(best.forecast(h))) if at else best.forecast
    return None, None, lambda h: np.full(h, x[-1])


def arima_fit(x: np.ndarray, candidates=CANDIDATES) -> tuple[tuple[int, int, int] | None, Callable[[int], np.ndarray]]:
    """The order that ``arima_search`` finds, and its forecaster."""
    order, _, forecast = arima_search(x, candidates)
    return order, forecast


def arima_values(x: np.ndarray, horizon: int) -> np.ndarray:
    return arima_fit(x)[1](horizon)


def stationarity_order(series: DataFrame) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "d": [stationarity(pdf.sort_values("pos")["value"].to_numpy(float))]})

    return spread(series.select("series_id", "pos", "value")).groupBy("series_id").applyInPandas(one, "series_id string, d int")


# -- models by name -------------------------------------------------------------------

Model = Callable[[np.ndarray, int], np.ndarray]


def _naive(x: np.ndarray, h: int) -> np.ndarray:
    return np.full(h, x[-1])


def _seasonal(x: np.ndarray, h: int, season: int = 24) -> np.ndarray:
    return np.resize(x[-season:], h) if len(x) >= season else _naive(x, h)


@dataclass(frozen=True)
class ModelFactory:
    """A model that each Python worker makes once and keeps: ``load`` of the path of its weights there, or of None.

    A file of weights is sent to the executors beside the job, not in the closure of every task.
    """

    name: str
    load: Callable[[str | None], Model]
    weights: str | None = None

    def ship(self, spark: SparkSession) -> None:
        if self.weights:
            spark.sparkContext.addFile(self.weights)

    def model(self) -> Model:
        key = (self.name, self.weights)
        if key not in _LOADED:
            _LOADED[key] = self.load(SparkFiles.get(os.path.basename(self.weights)) if self.weights else None)
        return _LOADED[key]


#: Models that this Python worker has made.
_LOADED: dict[tuple[str, str | None], Model] = {}

#: Models by name: a callable from context values and horizon to values. Users add their own.
MODELS: dict[str, Model | ModelFactory] = {"naive": _naive, "seasonal_naive": _seasonal, "arima": arima_values}


def forecast_with_model(series: DataFrame, model: str, horizon: int, models: dict[str, Model | ModelFactory] | None = None, normalize: bool = False) -> DataFrame:
    """(series_id, model, step, ts, yhat). Series go to the model in Arrow batches of arrays; results
    longer or shorter than the horizon are cut or continued. A ``ModelFactory`` is loaded once per worker."""
    chosen = (models or MODELS).get(model)
    if chosen is None:
        raise ValueError(f"unknown model {model!r}; known: {sorted(models or MODELS)}")
    if isinstance(chosen, ModelFactory):
        chosen.ship(series.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = chosen.model() if isinstance(chosen, ModelFactory) else chosen
        for pdf in batches:
            ids, steps, values = [], [], []
            for name, x in zip(pdf["series_id"], pdf["values"], strict=True):
                x = np.asarray(x, float)
                mean, scale = (x.mean(), np.sqrt(x.var() + 1e-5)) if normalize else (0.0, 1.0)
                y = np.asarray(made((x - mean) / scale, horizon), float)[:horizon] * scale + mean
                ids += [name] * len(y)
                steps += range(len(y))
                values += y.tolist()
            yield pd.DataFrame({"series_id": ids, "step": steps, "yhat": values})

    made = value_arrays(spread(series)).filter(F.size("values") > 0).mapInPandas(run, "series_id string, step int, yhat double")
    return extend_timestamps(series, horizon, "last").join(fit_length(made, horizon), ["series_id", "step"]).select("series_id", F.lit(model).alias("model"), "step", "ts", "yhat")


def forecast_arima(series: DataFrame, horizon: int) -> DataFrame:
    """(series_id, model, order, aic, step, ts, yhat): ``order`` is the (p, d, q) that was chosen as text, with its
    AIC; 'naive' and null where none could be fitted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, x in zip(pdf["series_id"], pdf["values"], strict=True):
                order, aic, forecast = arima_search(np.asarray(x, float))
                text = "naive" if order is None else ",".join(map(str, order))
                rows += [(name, text, aic, step, v) for step, v in enumerate(forecast(horizon).tolist())]
            yield pd.DataFrame(rows, columns=["series_id", "order", "aic", "step", "yhat"])

    made = value_arrays(spread(series)).filter(F.size("values") > 0).mapInPandas(run, "series_id string, order string, aic double, step int, yhat double")
    return extend_timestamps(series, horizon).join(made, ["series_id", "step"]).select("series_id", F.lit("arima").alias("model"), "order", "aic", "step", "ts", "yhat")
