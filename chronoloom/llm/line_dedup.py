"""Line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks at both ends and with A-Z in lower case.
Keys of at least ``min_chars`` code points that are in at least ``min_docs``
documents are *shared*: all their lines go except those in the largest doc_id.

``postings`` (one row per key and document) is the exact table; its counts decide.
The cuckoo filters hold the shared keys, a filter per shard, and let a scan of
documents skip nearly all lines before the exact join. Filters of ``BROADCAST_BYTES`` in
all go to the scan; larger ones stay, and keys are sent to the filter of their shard
instead, hot shards split over several tasks. They support insertion and deletion, so ``LineIndex.insert`` and ``LineIndex.delete`` move an index both ways:
deleting what was inserted gives the index as it was, in effect.

Defined cases: a null or empty text is one empty line and stays; rows with a null id
neither count as documents nor lose lines; rows that share an id count as one
document and lose the same keys; of repeated lines in the kept document all stay; an
empty table gives an empty one; texts of any length are cut into lines whole, in some
60 bytes of memory a byte of the longest text; other columns are carried through
untouched, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import hinted, schema_plus, small_batches, stash

KEY_SEEDS = (11, 12)
#: Keys a shard's filter is planned for, and the total size up to which filters are broadcast.
SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 32 << 20
#: Keys of documents that one task probes where filters are not broadcast, about.
PROBE_ROWS = 1 << 22


class CuckooFilter:
    """16-bit fingerprints in buckets of four; an entry may be in two buckets.

    It grows instead of failing, which needs the keys again: ``insert`` returns False
    and the caller rebuilds from the exact table.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        n = 1
        while n * self.SLOTS * 0.85 < max(capacity, 1):
            n *= 2
        self.table = np.zeros((n, self.SLOTS), np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        keys = np.unique(keys)  # equal entries beyond two buckets' slots would never fit
        capacity = max(len(keys), 4)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)  # 0 marks a free slot
        one = (keys & mask).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (bw.mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        table = self.table
        prints, one, two = self._places(keys)
        for fp, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            bucket = a
            for kick in range(self.KICKS):
                free = np.flatnonzero(table[bucket] == 0)
                if not len(free) and kick == 0:
                    bucket = b
                    free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = fp
                    break
                slot = kick % self.SLOTS
                fp, table[bucket, slot] = int(table[bucket, slot]), fp
                bucket = int(self._other(np.array([bucket]), np.array([fp]))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only for keys that were inserted."""
        prints, one, two = self._places(keys)
        for fp, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == fp)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)


def _line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Line ranges, and of the lines long enough: index and both key hashes."""
    start, end, first = bw.line_ranges(data, offsets)
    s, e = bw.strip_ranges(data, offsets, start, end)
    points = bw.code_points(data)
    long = np.flatnonzero(points[e] - points[s] >= min_chars)
    if not len(long):
        return start, end, first, long, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k1, k2 = (bw.RangeHash(data, bw.byte_table(seed, True)).of(s[long], e[long]) for seed in KEY_SEEDS)
    return start, end, first, long, k1, k2


def line_keys(docs: DataFrame, min_chars: int = 20, probe=None) -> DataFrame:
    """(id, k1, k2): the distinct keys of each row; with ``probe`` only those it may hold.

    ``docs`` has the columns id and text; null ids are left out.
    """
    schema = "id bigint, k1 bigint, k2 bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = probe.value if probe is not None else None
        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                _, _, first, long, k1, k2 = _line_keys(data, offsets, min_chars)
                if not len(long):
                    continue
                owner = np.searchsorted(first, long, side="right") - 1
                if filters is not None:
                    maybe = probe_filters(filters, k1)
                    owner, k1, k2 = owner[maybe], k1[maybe], k2[maybe]
                order = np.lexsort((k2, k1, owner))
                owner, k1, k2 = owner[order], k1[order], k2[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                ids = part.column("id").take(pa.array(owner[new]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(bw.signed(k1[new])), pa.array(bw.signed(k2[new]))], ["id", "k1", "k2"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("id").cast("bigint"), "text").filter("id is not null").mapInArrow(scan, schema)


def shared_keys(postings: DataFrame, min_docs: int) -> DataFrame:
    """Exact reference counts: (k1, k2, n_docs, top_doc) of the keys in enough documents."""
    return postings.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("id").alias("top_doc")).filter(F.col("n_docs") >= min_docs)


def _shard(n: int):
    return F.pmod(F.shiftrightunsigned("k1", 17), F.lit(n)).cast("int")


def shard_of(k1: np.ndarray, n: int) -> np.ndarray:
    return ((k1 >> np.uint64(17)) % np.uint64(n)).astype(np.int64)


def build_filters(shared: DataFrame, n_shards: int) -> DataFrame:
    """(shard, n_keys, filter): a cuckoo filter over the keys of each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["k1"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n_keys": [len(keys)], "filter": [CuckooFilter.build(keys).dump()]})

    return shared.select("k1", _shard(n_shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, n_keys bigint, filter binary")


def probe_filters(filters: tuple[int, dict[int, CuckooFilter]], k1: np.ndarray) -> np.ndarray:
    n, by_shard = filters
    shard = shard_of(k1, n)
    out = np.zeros(len(k1), bool)
    for s in np.unique(shard):
        if s in by_shard:
            at = shard == s
            out[at] = by_shard[s].contains(k1[at])
    return out


class LineIndex:
    """Postings, shared keys and filters over a growing and shrinking set of documents."""

    def __init__(self, postings: DataFrame, min_chars: int = 20, min_docs: int = 3, filters: DataFrame | None = None, n_shards: int | None = None, before: DataFrame | None = None):
        self.min_chars, self.min_docs = min_chars, min_docs
        self.postings = postings
        self.shared = stash(shared_keys(postings, min_docs), "shared")
        n_keys = self.shared.count()
        need = max(1, -(-n_keys // SHARD_KEYS))
        if filters is None or need > 2 * n_shards:
            self.n_shards, self.filters = need, stash(build_filters(self.shared, need), "filters")
        else:
            self.n_shards, self.filters = n_shards, stash(self._changed(filters, n_shards, before), "filters")
        self.bytes = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep_postings: bool = True) -> LineIndex:
        postings = line_keys(docs, min_chars)
        return cls(stash(postings, "postings") if keep_postings else postings, min_chars, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        added = self.postings.union(line_keys(docs, self.min_chars)).distinct()
        return LineIndex(stash(added, "postings"), self.min_chars, self.min_docs, self.filters, self.n_shards, self.shared)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of ``ids`` (column id)."""
        rest = self.postings.join(ids.select("id").distinct(), "id", "left_anti").select("id", "k1", "k2")
        return LineIndex(stash(rest, "postings"), self.min_chars, self.min_docs, self.filters, self.n_shards, self.shared)

    def _changed(self, filters: DataFrame, n: int, before: DataFrame) -> DataFrame:
        """The filters after the keys that became shared went in and the others out.

        A filter that overflows is rebuilt from the exact keys of its shard.
        """
        now = self.shared.select("k1", "k2", F.lit(1).alias("now"))
        then = before.select("k1", "k2", F.lit(1).alias("then"))
        keys = now.join(then, ["k1", "k2"], "full_outer").select("k1", "now", "then", _shard(n).alias("shard"))

        def change(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            k1 = keys["k1"].to_numpy(np.int64).view(np.uint64)
            here, was = keys["now"].notna().to_numpy(), keys["then"].notna().to_numpy()
            if len(old):
                made = CuckooFilter.load(old["filter"].iloc[0])
                made.delete(k1[was & ~here])
                if not made.insert(k1[here & ~was]):
                    made = CuckooFilter.build(k1[here])
            else:
                made = CuckooFilter.build(k1[here])
            return pd.DataFrame({"shard": [key[0]], "n_keys": [int(here.sum())], "filter": [made.dump()]})

        return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, "shard int, n_keys bigint, filter binary")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(id, drop): for each document that loses lines, their keys as one array."""
        if self.bytes <= BROADCAST_BYTES:
            rows = self.filters.select("shard", "filter").collect()
            probe = docs.sparkSession.sparkContext.broadcast((self.n_shards, {r[0]: CuckooFilter.load(bytes(r[1])) for r in rows}))
            maybe = line_keys(docs, self.min_chars, probe)
        else:
            maybe = self._probe_in_shards(line_keys(docs, self.min_chars))
        found = maybe.join(self.shared, ["k1", "k2"]).filter("id <> top_doc")
        return found.groupBy("id").agg(F.collect_set("k1").alias("drop"))

    def _probe_in_shards(self, keys: DataFrame) -> DataFrame:
        """The keys (id, k1, k2) that the filter of their shard may hold.

        Each task gets its shard's filter in front of the keys and streams them past it. A shard
        of many occurrences has several tasks, by a hash of the id, each with a copy of the filter.
        """
        load = self.shared.groupBy(_shard(self.n_shards).alias("shard")).agg(F.ceil(F.sum("n_docs") / PROBE_ROWS).cast("int").alias("parts"))
        filters = self.filters.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter")
        split = keys.withColumn("shard", _shard(self.n_shards)).join(hinted(load.filter("parts > 1")), "shard", "left")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
        both = filters.select("shard", "part", "filter", *(F.lit(None).cast("bigint").alias(c) for c in ("id", "k1", "k2"))).unionByName(
            split.select("shard", part.alias("part"), F.lit(None).cast("binary").alias("filter"), "id", "k1", "k2")
        )
        dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, current = None, None
            for batch in batches:
                shard, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
                borders = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(shard)]
                for low, high in itertools.pairwise(borders) if len(shard) else ():
                    some = batch.slice(low, high - low)
                    if (place := (shard[low], part[low])) != at:
                        at, current = place, None
                    if some.column("filter")[0].is_valid:
                        current = CuckooFilter.load(some.column("filter")[0].as_py())
                        some = some.slice(1)
                    if current is not None and some.num_rows:  # without a filter the shard has no shared key
                        hit = current.contains(some.column("k1").to_numpy().view(np.uint64))
                        yield some.select(["id", "k1", "k2"]).filter(pa.array(hit))

        return dealt.mapInArrow(scan, "id bigint, k1 bigint, k2 bigint")


def apply_drops(docs: DataFrame, drops: DataFrame, min_chars: int = 20) -> DataFrame:
    """docs (any columns, among them id and text) with the lines dropped.

    Adds n_lines (before) and n_dropped; text is replaced.
    """
    small_batches(docs.sparkSession)
    drops = drops.select(F.col("id").alias("__drop_id"), F.col("drop").alias("__drop"))
    joined = docs.join(drops, docs["id"] == drops["__drop_id"], "left").drop("__drop_id")
    schema = schema_plus(joined.drop("__drop"), "n_lines bigint, n_dropped bigint")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                start, end, first, long, k1, _ = _line_keys(data, offsets, min_chars)
                keys, texts = bw.signed(k1), part.column("text").to_pylist()
                n_dropped = np.zeros(len(texts), np.int64)
                at = np.searchsorted(long, first)
                for i, drop in enumerate(part.column("__drop").to_pylist()):
                    if not drop:
                        continue
                    mine = long[at[i] : at[i + 1]]
                    gone = set(mine[np.isin(keys[at[i] : at[i + 1]], np.array(drop, np.int64))].tolist())
                    n_dropped[i] = len(gone)
                    texts[i] = b"\n".join(data[start[j] : end[j]].tobytes() for j in range(first[i], first[i + 1]) if j not in gone).decode()
                out = {name: part.column(name) for name in part.schema.names if name != "__drop"}
                out |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(np.diff(first)), "n_dropped": pa.array(n_dropped)}
                yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, all other columns as they were,
    and the columns n_lines and n_dropped (replacing any of that name)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # short names of our own keep clear of the names that docs may have
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(names) if c != text_col))
    index = LineIndex.build(inner.select("id", "text"), min_chars, min_docs, keep_postings=False)
    cut = apply_drops(inner, index.drops(inner.select("id", "text")), min_chars)
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col(f"__c{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The registered query: doc_id, n_lines, n_dropped, kept_sha256."""
    cut = dedup_lines(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

