"""Quality rules: base rules, and an isolation forest on the statistics behind them.

Each tree splits a small sample of documents at random places of random statistics
until its points stand alone or a depth limit is reached. Odd documents are isolated on
short paths, so 2 ** (-mean path / expected path) is near 1 for them. A document whose
anomaly score is above a threshold is rejected; the threshold comes from labelled rows.

Only the trees are grown on a sample, as those of isolation forests are: about ``TREES * TREE_ROWS``
documents, drawn by a hash of the id, so the draw does not depend on partitioning. The threshold
comes from all labelled documents, counted in a histogram. All documents are scored where they lie,
without a shuffle of texts.

The threshold is the one with the fewest labelled bad rows kept plus ``GOOD_WEIGHT`` times the
good rows rejected (the highest of equal ones), among those at which at most
``FALSE_REJECTS`` of the good rows, and at most half as many good rows as bad rows, are
rejected; without labels the forest rejects nothing.

Defined cases: null and wordless texts have zero counts and fail the base rule (fewer
than 50 words); null ids take part like others but never match a label and are not drawn for
the trees; labels without quality are not used, and of several labels of one id the largest
holds; repeated documents are judged, and counted for the threshold, each; an empty table
gives an empty one; texts of any length are judged whole, in some 60 bytes of memory a byte
of the longest text; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import BROADCAST_IDS, rows_of, small_batches, stash
from chronoloom.llm.doc_stats import COUNTS, FEATURES, statistics

MIN_WORDS, REPEAT_PERCENT = 50, 50
TREES, TREE_ROWS = 128, 256
#: Labelled good rows that the forest may reject, as a share.
FALSE_REJECTS, GOOD_WEIGHT = 0.002, 4
BINS = 1000
#: The statistics that the rules speak of; length and repetition are left to the base rule, as good
#: texts differ widely in them.
RULE_FEATURES = [FEATURES.index(f) for f in ("word_length", "symbol_share", "upper_share", "mark_share", "bang_per_word", "distinct_share", "bar_per_word")]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


class IsolationForest:
    """Trees as flat arrays; ``fit`` takes a sample, ``score`` any rows."""

    def __init__(self, feature: np.ndarray, split: np.ndarray, child: np.ndarray, length: np.ndarray, roots: np.ndarray, rows: int):
        self.feature, self.split, self.child, self.length, self.roots, self.rows = feature, split, child, length, roots, rows

    @staticmethod
    def expected_path(n: int | np.ndarray) -> np.ndarray:
        """Mean path of unsuccessful searches in a binary search tree of n."""
        n = np.asarray(n, float)
        m = np.maximum(n - 1, 1)
        return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        feature, split, child, length, roots = [], [], [], [], []
        rows = min(rows, len(sample))
        limit = int(np.ceil(np.log2(max(rows, 2))))

        def grow(x: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1), split.append(0.0), child.append((0, 0)), length.append(0.0)
            low, high = x.min(0), x.max(0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(x) <= 1 or not len(free):
                length[me] = depth + float(cls.expected_path(len(x)))
                return me
            f = int(rng.choice(free))
            s = float(rng.uniform(low[f], high[f]))
            left = x[:, f] <= s
            feature[me], split[me] = f, s
            child[me] = (grow(x[left], depth + 1), grow(x[~left], depth + 1))
            return me

        for _ in range(trees if len(sample) else 0):
            roots.append(grow(sample[rng.choice(len(sample), rows, replace=False)], 0))
        return cls(np.array(feature, np.int64), np.array(split), np.array(child, np.int64).reshape(-1, 2), np.array(length), np.array(roots, np.int64), rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.zeros(len(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                break
            right = x[row, np.maximum(f, 0)] > self.split[at]
            at = np.where(f >= 0, self.child[at, right.astype(np.int64)], at)
        return 2.0 ** (-self.length[at].mean(1) / max(float(self.expected_path(self.rows)), 1e-9))


def _rows(docs: DataFrame, forest=None, threshold=None) -> DataFrame:
    """docs (id, text) -> id, counts, base_failed, score (with a forest) and features (without)."""
    extra = "score double" if forest is not None else "x array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forest.value if forest is not None else None
        for batch in batches:
            for part in bw.slices(batch, "text"):
                counts, x = statistics(part)
                x = x[:, RULE_FEATURES]
                last = pa.array(model.score(x)) if model is not None else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(counts[c]) for c in COUNTS), pa.array(base_failed(counts)), last], ["id", *COUNTS, "base_failed", "score" if model is not None else "x"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(scan, f"id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, {extra}")


def fit_forest(docs: DataFrame, trees: int = TREES, rows: int = TREE_ROWS) -> IsolationForest:
    """On a draw of about trees * rows of the documents (id, text) that pass the base rule."""
    total, want = docs.count(), trees * rows
    share = min(1.0, 1.2 * want / max(total, 1))  # a hash below a bound: the count is binomial, near the wanted one
    drawn = docs if share >= 1 else docs.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    sample = sorted(tuple(r["x"]) for r in _rows(drawn).filter("not base_failed").select("x").collect())
    return IsolationForest.fit(np.array(sample).reshape(-1, len(RULE_FEATURES)), trees, rows)


def named_labels(labels: DataFrame) -> DataFrame:
    """(id, quality) of all labelled ids; of several labels of one id the largest."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("quality")).filter("id is not null and quality is not null")
    return named.groupBy("id").agg(F.max("quality").alias("quality"))


def fit_threshold(scored: DataFrame, named: DataFrame, false_rejects: float = FALSE_REJECTS) -> float:
    """``scored`` (id, base_failed, score), ``named`` (id, quality); a histogram of at most BINS rows reaches the driver."""
    bins = scored.filter("not base_failed").join(named, "id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, is_good, n in bins:
        (good if is_good else bad)[b] += n
    above_good, above_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    ok = (above_good <= false_rejects * max(good.sum(), 1)) & (2 * above_good <= above_bad) & (above_bad > 0)
    if not ok.any():
        return float("inf")
    loss = np.where(ok, (bad.sum() - above_bad) + GOOD_WEIGHT * above_good, np.inf)
    return float(np.flatnonzero(loss == loss.min()).max()) / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five counts, base_failed, score and kept of every row of ``docs``."""
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    forest = _forest(inner)
    rows = stash(_rows(inner, forest), "rules")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(fit_threshold(rows, named_labels(labels)))))


def _forest(inner: DataFrame):
    """The fitted forest, broadcast; its size is bounded."""
    return inner.sparkSession.sparkContext.broadcast(fit_forest(inner))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rejected rows, in place: texts are not joined, columns as they were."""
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    forest, named = _forest(inner), stash(named_labels(labels), "named")
    # labelled documents alone are scored twice, or all if the labelled are too many to be told without a shuffle of texts
    labelled = rows_of(inner, named) if named.count() <= BROADCAST_IDS else inner
    threshold = fit_threshold(_rows(labelled, forest).select("id", "base_failed", "score"), named)
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, text_col):
                counts, x = statistics(pa.RecordBatch.from_arrays([part.column(text_col)], ["text"]))
                good = ~base_failed(counts) & (forest.value.score(x[:, RULE_FEATURES]) < threshold)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(scan, docs.schema)


def quality_rules_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: doc_id, the counts, base_failed, kept, and the anomaly score."""
    return quality_rules(docs.select("doc_id", "text"), labels).withColumnRenamed("id", "doc_id").select("doc_id", *COUNTS, "base_failed", "kept", "score")
