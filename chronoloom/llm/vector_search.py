"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A tree over a bounded sample cuts space into cells: each node has a vantage point and a radius,
and a vector belongs inside or outside. Every vector is put into its cell, cells are cut into
shards of some ``SHARD_ROWS`` vectors, and each shard gets a tree of its own. What a node knows of
the distances from its vantage point to the vectors below it bounds, by the triangle inequality,
how near they can be to a query. A subtree is left out if ``factor`` times that bound is more than
the distance of the k-th nearest vector found so far. Factor 1 is exact search; larger factors
leave out more and may miss neighbours.

A query begins with the k-th smallest distance to the sample as its limit and goes to those cells
alone that may be nearer; there it visits leaves in the order of their bounds. Distances that are
returned are sums of squares in the order of components, in double precision.

Equal vectors are one point that carries the smallest ``k + 1`` ids that have it: beyond them
no id can be among the k nearest of any query, as ties go to smaller ids. So a vector that very
many rows share is one point of one shard, and one query. Queries of a cell are dealt in blocks.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and
rows without id, take no part; vectors of different lengths aren't compared; repeated rows are rows
each, and each is a query if its id makes it one; a table without vectors gives no rows; further
columns are ignored. A task holds one shard and one batch of queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import small_batches, stash

#: Vectors of a shard, about; those of a leaf of its tree at most; queries that one copy of a shard meets, about.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 64, 1 << 16
#: Vectors that the tree of cells is fitted on at most, and those of each of its leaves at least.
FIT_VECTORS, FIT_LEAF = 8192, 16
#: Vectors of a batch that meet at once.
_AT_ONCE = 512


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """From each row of ``x`` to one vector or to the row beside it, components summed in their order."""
    d = x - to
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])


def _squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by a matrix product, and how far off they may be."""
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None]
    return qq + xx - 2 * q @ x.T, 1e-15 * (q.shape[1] + 16) * (qq + xx)


class VantageTree:
    """A vantage-point tree over the rows of ``x``: leaves of row numbers, nodes of bounds on distances."""

    def __init__(self, x: np.ndarray, leaf: int, exact_bounds: bool = True):
        self.leaves: list[np.ndarray] = []
        #: (vantage point, radius, inside child, outside child, largest distance inside, smallest outside); leaves are ~number.
        self.nodes: list[tuple] = []
        self._x, self._leaf, self._exact = x, leaf, exact_bounds
        self.root = self._build(np.arange(len(x)))
        del self._x

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) <= self._leaf:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        far = rows[int(np.argmax(_distances(self._x[rows], self._x[rows[0]])))]
        d = _distances(self._x[rows], self._x[far])
        radius = float(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inside = d <= radius
        if inside.all():  # ties at the radius: all but them are inside
            inside = d < radius
            radius = float(d[inside].max()) if inside.any() else 0.0
        if not inside.any() or inside.all():  # one distance for all: no radius tells them apart
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        high, low = (float(d[inside].max()), float(d[~inside].min())) if self._exact else (radius, radius)
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (self._x[far].copy(), radius, self._build(rows[inside]), self._build(rows[~inside]), high, low)
        return at

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf, the least distance that the triangle inequality allows."""
        out = np.zeros((len(q), len(self.leaves)))
        todo = [(self.root, np.zeros(len(q)))]
        while todo:
            at, bound = todo.pop()
            if at < 0:
                out[:, ~at] = bound
                continue
            point, _, inside, outside, high, low = self.nodes[at]
            d = _distances(q, point)
            todo += [(inside, np.maximum(bound, d - high)), (outside, np.maximum(bound, low - d))]
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf in whose region each vector lies."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = ~at
            elif len(rows):
                point, radius, inside, outside, _, _ = self.nodes[at]
                near = _distances(x[rows], point) <= radius
                todo += [(inside, rows[near]), (outside, rows[~near])]
        return out


def _out(bound: np.ndarray, limit: np.ndarray, factor: float) -> np.ndarray:
    """What may be left out; a margin for rounding stays in."""
    return factor * bound > limit * (1 + 1e-9) + 1e-12


class Shard:
    """The vectors of a shard with their first ids, and their tree."""

    def __init__(self, x: np.ndarray, first: np.ndarray):
        tree = VantageTree(x, LEAF_ROWS)
        order = np.concatenate(tree.leaves)
        self.x, self.first, self.rows, self.tree = x[order], first[order], order, tree
        self.ends = np.cumsum([len(leaf) for leaf in tree.leaves])

    def nearest(self, q: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances of the ``k`` nearest of each query within its limit, ties to the smaller
        first id; -1 and inf where there are fewer."""
        n = len(q)
        best, score, tie = np.full((n, k), -1), np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        limit = limit.copy()
        bound = self.tree.bounds(q)
        order = np.argsort(bound, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            live = np.flatnonzero(~_out(bound[np.arange(n), leaf], limit, factor))
            if not len(live):
                break  # bounds only grow from here
            for one in np.unique(leaf[live]):
                self._visit(live[leaf[live] == one], int(one), q, limit, best, score, tie, k)
        return best, score

    def _visit(self, who: np.ndarray, leaf: int, q: np.ndarray, limit: np.ndarray, best: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> None:
        low, high = (int(self.ends[leaf - 1]) if leaf else 0), int(self.ends[leaf])
        square, off = _squares(q[who], self.x[low:high])
        i, j = np.nonzero(~(square - off > (limit[who] ** 2 * (1 + 1e-9))[:, None]))
        if not len(i):
            return
        d = _distances(q[who[i]], self.x[low + j])
        found, rows = np.full(square.shape, np.inf), np.broadcast_to(np.arange(low, high), square.shape)
        found[i, j] = d
        every = np.concatenate([score[who], found], axis=1)
        ids = np.concatenate([tie[who], np.broadcast_to(self.first[low:high], square.shape)], axis=1)
        take = np.lexsort((ids, every), axis=1)[:, :k]
        score[who], tie[who] = np.take_along_axis(every, take, 1), np.take_along_axis(ids, take, 1)
        best[who] = np.take_along_axis(np.concatenate([best[who], self.rows[rows]], axis=1), take, 1)
        best[~np.isfinite(score)] = -1
        limit[who] = np.minimum(limit[who], score[who, k - 1])


# -- Spark ---------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Rows of packed vectors of one length, as doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(float)


def _packed(vectors: DataFrame, vec_id: str, vec: str) -> tuple[DataFrame, str]:
    """(vec_id, key, dim, vec) of the vectors that take part, packed in bytes; key is a hash of 128 bits."""
    single = isinstance(vectors.schema[vec].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(1), ([], [], [], [])
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts, ids = lists.offsets.to_numpy()[:-1], b.column(0).to_numpy()
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)] + 0.0  # no -0.0
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                for i, v in zip(ids[rows[ok]].tolist(), x[ok].astype(kind), strict=True):
                    raw = v.tobytes()
                    for to, value in zip(out, (i, hashlib.blake2b(raw, digest_size=16).digest(), dim, raw), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["vec_id", "key", "dim", "vec"])

    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vec).alias("vec")).filter("vec_id is not null and vec is not null")
    return given.mapInArrow(run, "vec_id bigint, key binary, dim int, vec binary"), kind


def _smallest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each key; each task keeps no more of a key before rows are shuffled."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("nth") <= n).drop("nth")


class Cells:
    """The tree of cells of each length of vectors in a sample, and the sample itself."""

    def __init__(self, sample: dict[int, np.ndarray], cells: int):
        self.sample = sample
        self.trees = {dim: VantageTree(x, max(FIT_LEAF, -(-len(x) // cells)), exact_bounds=False) for dim, x in sample.items()}

    def of(self, dim: int, x: np.ndarray) -> np.ndarray:
        return self.trees[dim].leaf_of(x) if dim in self.trees else np.zeros(len(x), np.int64)

    def limits(self, dim: int, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest distance to the sample, or a little more."""
        x = self.sample.get(dim, np.zeros((0, dim)))
        if len(x) < k:
            return np.full(len(q), np.inf)
        square, off = _squares(q, x)
        return np.sqrt(np.partition(np.maximum(square, 0) + off, k - 1, axis=1)[:, k - 1]) * (1 + 1e-9)

    def reach(self, dim: int, q: np.ndarray, limit: np.ndarray, factor: float) -> np.ndarray:
        """Which cells a query has to visit; its own is one of them."""
        if dim not in self.trees:
            return np.ones((len(q), 1), bool)
        out = ~_out(self.trees[dim].bounds(q), limit[:, None], factor)
        out[np.arange(len(q)), self.of(dim, q)] = True
        return out


def _by_dim(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for b in batches:
        dims = b.column(b.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(dims).tolist():
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            for at in range(0, part.num_rows, _AT_ONCE):
                some = part.slice(at, _AT_ONCE)
                yield dim, some, _matrix(some.column(some.schema.get_field_index("vec")), dim, kind)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row that ``queries`` (on vec_id) picks."""
    spark, most = vectors.sparkSession, k + 1
    small_batches(spark)
    packed, kind = _packed(vectors, vec_id, vec)
    packed = stash(packed, "vectors")
    points = stash(_smallest(packed, most, "vec_id").groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    count = points.count()
    sample: dict[int, list[bytes]] = {}
    for row in points.select("key", "dim", "vec").orderBy("key").limit(FIT_VECTORS).collect():  # keys are hashes
        sample.setdefault(row["dim"], []).append(bytes(row["vec"]))
    cells = Cells({dim: np.frombuffer(b"".join(v), kind).reshape(len(v), dim).astype(float) for dim, v in sample.items()}, max(1, -(-count // SHARD_ROWS)))

    def assign(batches):
        for dim, b, x in _by_dim(batches, kind):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(dim, x).astype(np.int32))], [*b.schema.names, "cell"])

    def route(batches):
        for dim, b, q in _by_dim(batches, kind):
            limit = cells.limits(dim, q, most)
            i, c = np.nonzero(cells.reach(dim, q, limit, factor))
            some = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(limit[i]), pa.array(c.astype(np.int32))], [*some.schema.names, "reach", "cell"])

    asked = packed.filter(queries).select("vec_id", "key", "dim", "vec")
    placed = stash(points.mapInArrow(assign, "key binary, dim int, vec binary, ids array<bigint>, cell int"), "cells")
    routed = stash(asked.select("key", "dim", "vec").dropDuplicates(["key"]).mapInArrow(route, "key binary, dim int, vec binary, reach double, cell int"), "queries")
    # two counts of each cell, of which there are no more than leaves of the fitted trees and lengths
    size = F.broadcast(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("subs")))
    load = F.broadcast(routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks")))
    name, deal = F.concat_ws(".", "dim", "cell", "sub", "block").alias("shard"), F.xxhash64("key")
    held = placed.join(size, ["dim", "cell"]).join(load, ["dim", "cell"]).withColumn("sub", F.pmod(deal, "subs")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    goes = routed.join(load, ["dim", "cell"]).join(size, ["dim", "cell"]).withColumn("block", F.pmod(deal, "blocks")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    both = held.select(name, F.lit(0).alias("is_query"), "key", "dim", "vec", "ids", F.lit(0.0).alias("reach")).union(goes.select(name, F.lit(1), "key", "dim", "vec", F.array().cast("array<bigint>"), "reach"))

    def search(batches):
        at, held, shard = None, [], None
        for b in batches:
            names, asks = b.column(0).to_pylist(), b.column(1).to_numpy()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1] or asks[i] != asks[i - 1]] + [len(names)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = b.slice(low, high - low)
                if names[low] != at:
                    at, held, shard = names[low], [], None
                if not asks[low]:
                    held.append(part)
                    continue
                if not held:
                    continue
                dim = part.column(3)[0].as_py()
                if shard is None:
                    ids = [i for p in held for i in p.column(5).to_pylist()]
                    shard = Shard(np.concatenate([_matrix(p.column(4), dim, kind) for p in held]), np.array([i[0] for i in ids]))
                for start in range(0, part.num_rows, _AT_ONCE):
                    some = part.slice(start, _AT_ONCE)
                    best, score = shard.nearest(_matrix(some.column(4), dim, kind), some.column(6).to_numpy(), most, factor)
                    keys, out = some.column(2).to_pylist(), ([], [], [])
                    for i, j in zip(*np.nonzero(best >= 0), strict=True):
                        for one in ids[best[i, j]]:
                            out[0].append(keys[i])
                            out[1].append(score[i, j])
                            out[2].append(one)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], ["key", "score", "vec_id"])

    found = both.repartition("shard").sortWithinPartitions("shard", "is_query").mapInArrow(search, "key binary, score double, vec_id bigint")
    top = _smallest(found, most, "score", "vec_id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
    # its own row is the one at distance 0 with its id; where it isn't there, smaller ids fill the list
    rows = asked.select(F.col("vec_id").alias("query_id"), "key").join(top, "key").withColumn("own", F.array_position("top", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id"))))
    others = F.slice(F.filter("top", lambda x, i: i != F.coalesce(F.col("own"), F.lit(0)) - 1), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def vector_search_digest(vectors: DataFrame) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100, by exact search."""
    return nearest(vectors, F.col("vec_id") % 100 == 0)
