"""Numbers that follow from a global order, without a task that holds a whole key or all rows.

Rows are dealt by ranges of the order and written once, so that counts and places are of the same
ranges. What a range needs from those before it (how many rows of its first key there are, how long
the run is that reaches into it) follows from one summary row per range; there are as many as
shuffle partitions, which bounds what comes to the driver and what is broadcast.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.sources.storage import stash

#: Most rows of a side that is sent to where the others are; more are joined by shuffling.
SMALL_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to join with, broadcast if it has few rows, so that the other side stays where it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def beside(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has the same keys, nulls among them."""
    renamed = facts.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(small(renamed), same).drop(*(f"__{k}" for k in keys))


def dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in ranges of ``order``, with __part and __place: the range, and the place in it from 0."""
    at = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    return at.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at") - F.shiftleft("__part", 33)).drop("__at")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no", count: str | None = None) -> DataFrame:
    """Adds ``name``: the place from 0 of a row among those of equal ``keys``, in ``order``; and, as ``count``, how many there are."""
    ranges = dealt(df, *keys, *order)
    sizes = sorted(map(tuple, ranges.groupBy("__part").agg(F.count("*")).collect()))  # a row a range
    before = zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False)
    starts = df.sparkSession.createDataFrame(list(before), "__part bigint, __before bigint")
    placed = ranges.join(F.broadcast(starts), "__part").withColumn("__n", F.col("__before") + F.col("__place"))
    facts = placed.groupBy(*keys).agg(F.min("__n").alias("__first"), *([F.count("*").alias(count)] if count else []))
    return beside(placed, facts, *keys).withColumn(name, (F.col("__n") - F.col("__first")).cast("int")).drop("__part", "__place", "__before", "__n", "__first")


def numbered_runs(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the place from 0 within a run of equal neighbours of ``column``, in ``order``; nulls are runs of one."""
    ranges = dealt(df, order)
    w = Window.partitionBy("__part").orderBy("__place")
    # null: the first row of a range, whose run may have begun before
    fresh = F.when(F.col("__place") > 0, F.coalesce(F.lag(column).over(w) != F.col(column), F.lit(True)))
    x = ranges.withColumn("__run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__run", F.coalesce("__run", F.lit(0)))
    runs = x.groupBy("__part", "__run").agg(F.count("*").alias("n"), F.first(column).alias("v"))
    ends = sorted(tuple(r) for r in runs.groupBy("__part").agg(F.max("__run"), F.min_by("v", "__run"), F.max_by("v", "__run"), F.max_by("n", "__run")).collect())  # a row a range
    carry, last, length = [], None, 0
    for part, run, low, high, n in ends:
        into = length if low is not None and low == last else 0
        carry.append((part, into))
        last, length = high, n + (into if run == 0 else 0)
    starts = df.sparkSession.createDataFrame(carry, "__part bigint, __into bigint")
    inside = F.row_number().over(Window.partitionBy("__part", "__run").orderBy("__place")) - 1
    x = x.withColumn("__inside", inside).join(F.broadcast(starts), "__part")
    return x.withColumn(name, (F.col("__inside") + F.when(F.col("__run") == 0, F.col("__into")).otherwise(0)).cast("int")).drop("__part", "__place", "__run", "__inside", "__into")


def order_statistics(rows: DataFrame, value: str, shares: dict[str, float], key: str = "series_id") -> DataFrame:
    """(key, one column a name): exact quantiles of each key's values, between neighbours in proportion.

    Values are sorted over ranges and each takes its rank there; no buffer grows with a key. Nulls don't
    count, NaN is the largest."""
    ranked = numbered(rows.filter(F.col(value).isNotNull()).select(key, value), [key], [value], "__rank", "__count")
    picks = {}
    for name, share in shares.items():
        h = (F.col("__count") - 1) * F.lit(float(share))
        for side, at in (("low", F.floor(h)), ("high", F.ceil(h))):
            picks[f"{name}_{side}"] = F.max(F.when(F.col("__rank") == at, F.col(value)))
    out = ranked.groupBy(key).agg(F.max("__count").alias("__count"), *(c.alias(k) for k, c in picks.items()))

    def between(name: str, share: float) -> Column:
        h = (F.col("__count") - 1) * F.lit(float(share))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(F.floor(h) == F.ceil(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high).alias(name)

    return out.select(key, *(between(n, s) for n, s in shares.items()))
