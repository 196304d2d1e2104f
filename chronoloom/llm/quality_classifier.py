"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped by ``cos(x W + b)`` with Gaussian
``W`` to ``WIDTH`` random features, whose products approximate a Gaussian kernel. Each
partition sums its part of the normal equations; the sums meet in a grouped sum by matrix
row, and the driver solves a system of fixed size. A monotone step function from raw
values to shares of good rows, found by pooling adjacent violators, gives scores in [0, 1].

Labels: rows whose crc32(doc_id as text) mod 5 is 0 are held out. Of the others, those at
4 calibrate and those at 1 to 3 fit the ridge. At most about ``FIT_ROWS`` labelled rows
fit (drawn by a hash of the id, and documented here as the bound); all of them
calibrate, and every document is scored.

Defined cases: null and empty texts have zero statistics and are scored like others; null
ids are scored and never match a label; repeated labels of an id count once, the larger
quality; without usable labels every score is 1 (nothing speaks against a document); without rows
to calibrate with, the rows that fit do so; repeated documents are scored, and taught, each;
equal raw values have equal scores; an empty table gives an empty one; texts of any length are
scored whole, in some 60 bytes of memory a byte of the longest text; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import fold, small_batches, stash
from chronoloom.llm.doc_stats import FEATURES, statistics

WIDTH, RIDGE, GAMMA = 192, 1e-3, 0.15
FIT_ROWS, FIT_PARTS = 200_000, 32
BINS = 2000
THRESHOLD = 0.3


def document_features(docs: DataFrame) -> DataFrame:
    """(id, x): the statistics of every row of docs (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                x = statistics(part)[1].astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["id", "x"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(scan, "id bigint, x array<float>")


class RandomFeatures:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int = WIDTH, gamma: float = GAMMA, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


def normal_equations(labelled: DataFrame, features) -> np.ndarray:
    """[width + 1, width + 2]: Z'Z beside Z'y, summed over partitions; labelled has x and y."""
    width = len(features.value.b) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = features.value(_matrix(batch.column("x")))
                y = batch.column("y").to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "v": [np.sum(np.stack(pdf["v"]), axis=0)]})

    rows = labelled.mapInArrow(part, "row int, v array<double>").groupBy("row").applyInPandas(add, "row int, v array<double>").collect()
    return np.array([v for _, v in sorted((r["row"], r["v"]) for r in rows)])


def isotonic(values: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over groups in ascending order: breakpoints and means."""
    blocks: list[list[float]] = []
    for v, s, n in zip(values, sums, counts, strict=True):
        blocks.append([v, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class QualityModel:
    def __init__(self, features: RandomFeatures | None, weights: np.ndarray | None, steps: np.ndarray | None, means: np.ndarray | None):
        self.features, self.weights, self.steps, self.means = features, weights, steps, means

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        at = np.searchsorted(self.steps, np.floor(self.raw(x) * BINS), side="right") - 1
        return np.clip(self.means[np.maximum(at, 0)], 0, 1)


def fit(rows: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """rows (id, x) of all documents; labels (doc_id, quality)."""
    spark = rows.sparkSession
    named = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("double").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    named = named.withColumn("fold", fold("id", 5)).filter("fold <> 0")
    labelled = stash(rows.join(named, "id"), "labelled")
    n = labelled.filter("fold < 4").count()
    if not n:
        return QualityModel(None, None, None, None)
    chosen = labelled.filter("fold < 4").filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, fit_rows / n) * (1 << 30)) + 1))
    chosen = chosen.select("x", "y").repartition(FIT_PARTS)  # so the number of partial sums is bounded too
    moments = [f(F.get("x", F.lit(i)).cast("double")) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]
    flat = np.array([v or 0.0 for v in chosen.agg(*moments).first()], float)
    mean, deviation = flat[: len(FEATURES)], flat[len(FEATURES) :]
    features = RandomFeatures(mean, np.maximum(deviation, 1e-6))
    shared = spark.sparkContext.broadcast(features)
    equations = normal_equations(chosen, shared)
    zz, zy = equations[:, :-1], equations[:, -1]
    weights = np.linalg.solve(zz + RIDGE * max(zz[-1, -1], 1) * np.eye(len(zz)), zy)
    model = QualityModel(features, weights, None, None)
    raw = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(raw.value.raw(_matrix(batch.column("x"))) * BINS).astype(np.int32)), batch.column("y")], ["bin", "y"])

    held = labelled.filter("fold = 4") if labelled.filter("fold = 4").head(1) else labelled
    counted = held.select("x", "y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("n")).orderBy("bin").collect()
    steps, means = isotonic(np.array([r["bin"] for r in counted], float), np.array([r["s"] for r in counted]), np.array([r["n"] for r in counted], float))
    return QualityModel(features, weights, steps, means)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) of rows (id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(_matrix(batch.column("x"))))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(scan, "id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    rows = stash(document_features(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))), "features")
    return score(rows, fit(rows, labels))


def quality_classifier_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: doc_id, held_out, score, predicted."""
    scored = quality_scores(docs, labels).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
