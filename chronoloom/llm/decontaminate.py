"""Benchmark decontamination with an FM-index per shard of the training text.

Test phrases are all windows of ``window`` consecutive words of each benchmark item
(an item of fewer words is one phrase). A *shard* is a bounded run of documents in a
task. Its words become symbols: the words of the benchmark get numbers, all other
words are one break symbol, since no phrase can hold them; stretches between breaks
that are shorter than the shortest phrase cannot hold a phrase either and are left
out, which changes no result. Over the symbols the shard gets a suffix order, its
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every
``SAMPLE``-th position. Backward search by wavelet ranks narrows all phrases at once;
occurrences are located by walking to sampled positions, and overlapping ones merge
into spans of hit words.

The benchmark travels to the tasks in blocks of bounded size (``BLOCK_WORDS``), each
against all documents; with one block, documents are not shuffled at all.

Defined cases: null or wordless texts have no words and no hits; items with null id
or without words are left out; repeated item_ids count once; a phrase in several
items counts for each; repeated documents and null doc_ids are rows like others; without
benchmark items nothing is hit, and an empty table gives an empty one; a text longer than a
shard is a shard of its own, in some 40 bytes of memory a byte; other columns are carried
through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import schema_plus, small_batches, stash

WINDOW = 10
#: Most benchmark words in a block; a phrase per word takes 80 bytes when broadcast, and its items some more.
BLOCK_WORDS = 1_000_000
#: Bytes of text in a shard, and the distance between sampled suffix positions.
SHARD_BYTES = 4 << 20
SAMPLE = 8
_WORD = bw.byte_table(31, True)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return bw.RangeHash(data, _WORD).of(start, end) if len(start) else np.zeros(0, np.uint64)


class WaveletMatrix:
    """Rank and access over a sequence of small integers, for whole arrays of queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros, self.levels = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(bit.astype(bool))
            self.ranks.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` values."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ranks[k][low], self.ranks[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at positions, and how often each is before its position."""
        value, low, pos = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            one = self.levels[k][pos]
            a, b = self.ranks[k][low], self.ranks[k][pos]
            low = np.where(one, self.zeros[k] + a, low - a)
            pos = np.where(one, self.zeros[k] + b, pos - b)
            value = (value << 1) | one
        return value, pos - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. ``text`` ends stretches with 0; each 0 is taken as smaller
    than all others and as distinct, in order of position, so comparisons stop there."""
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ranked = rank[order]
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new) - 1
        if new.all():
            return order
        after = np.zeros(n, np.int64)
        after[: n - width] = dense[width:] + 1
        rank = dense * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        width *= 2


class FmIndex:
    """Over an array of symbols (0: break, at the end too)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        self.n = len(text)
        previous = text[order - 1]  # the text is a cycle; breaks are never searched across
        self.bits = max(1, int(n_symbols).bit_length())
        self.wavelet = WaveletMatrix(previous.astype(np.int64), self.bits)
        self.before = np.zeros(n_symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols + 1), out=self.before[1:])
        self.sampled = order % SAMPLE == 0
        self.sampled |= previous == 0  # a step back over a break is not needed, so walks end there
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order that start with each phrase (rows padded at the end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (low < high))
            if not len(live):
                continue
            c = phrases[live, k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.positions[self.slot[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            if len(live):
                symbol, rank = self.wavelet.access_rank(at)
                at = self.before[symbol] + rank
                steps[live] += 1
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges, and the range each is from."""
    counts = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts), owner


class Phrases:
    """A block of benchmark items as phrases of symbols."""

    def __init__(self, rows: list[tuple[int, list[int]]], window: int):
        hashes = [np.array(words, np.int64).view(np.uint64) for _, words in rows]
        self.vocabulary = np.unique(np.concatenate(hashes))
        width = window
        found: dict[bytes, list[int]] = {}
        for (item, _), words in zip(rows, hashes, strict=True):
            symbols = np.searchsorted(self.vocabulary, words) + 1
            for i in range(max(1, len(symbols) - width + 1)):
                items = found.setdefault(symbols[i : i + width].tobytes(), [])
                if not items or items[-1] != item:
                    items.append(item)
        phrases = [np.frombuffer(p, np.int64) for p in found]
        self.lengths = np.array([len(p) for p in phrases])
        self.symbols = np.zeros((len(phrases), width), np.int64)
        for i, p in enumerate(phrases):
            self.symbols[i, : len(p)] = p
        self.items = list(found.values())
        self.shortest = int(self.lengths.min())

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, 0 for words that are in no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of all occurrences among the words of a shard's texts."""
        symbols = self.numbers(words)
        # one more place for a break after each text
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        padded = np.zeros(len(words) + len(first) - 1, np.int64)
        padded[np.arange(len(words)) + text_of] = symbols
        source = np.full(len(padded), -1, np.int64)
        source[np.arange(len(words)) + text_of] = np.arange(len(words))
        solid = padded > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        if not long.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, _ = _expand(starts[long], ends[long] + 1)  # each stretch with the break after it
        index = FmIndex(padded[places], len(self.vocabulary))
        low, high = index.search(self.symbols, self.lengths)
        rows, phrase = _expand(low, high)
        return source[places[index.locate(rows)]], phrase


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, item, words): word hashes of the items, packed into blocks of bounded size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                start, end, first = bw.word_ranges(data, offsets, bw.ALNUM)
                hashes = bw.signed(_word_hashes(data, start, end))
                words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([part.column("item"), words], ["item", "words"])

    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null").mapInArrow(scan, "item string, words array<bigint>")
    items = stash(items.filter("size(words) > 0"), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words))
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def shard_hits(part: pa.RecordBatch, phrases: Phrases):
    """For the texts of a shard: bytes, offsets, word ranges, first words, hit flags, items by text."""
    data, offsets = bw.text_bytes(part.column("text"))
    start, end, first = bw.word_ranges(data, offsets, bw.ALNUM)
    hit = np.zeros(len(start), bool)
    items: dict[int, set] = {}
    if len(start):
        at, phrase = phrases.occurrences(_word_hashes(data, start, end), first)
        if len(at):
            delta = np.zeros(len(start) + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + phrases.lengths[phrase], -1)
            hit = np.cumsum(delta[:-1]) > 0
            text = np.searchsorted(first, at, side="right") - 1
            for t, p in set(zip(text.tolist(), phrase.tolist(), strict=True)):
                items.setdefault(t, set()).update(phrases.items[p])
    return data, offsets, start, end, first, hit, items


def _collected(items: DataFrame, block: int) -> list:
    """The items of one block, whose size is bounded by BLOCK_WORDS (or a single item's length)."""
    return [(r[0], r[1]) for r in items.filter(F.col("block") == block).select("item", "words").orderBy("item").collect()]


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, list]:
    items = benchmark_blocks(benchmark)
    return items, [r[0] for r in items.select("block").distinct().orderBy("block").collect()] or [None]


def _shared_phrases(items: DataFrame, block: int | None, window: int):
    rows = _collected(items, block) if block is not None else []
    return items.sparkSession.sparkContext.broadcast(Phrases(rows, window) if rows else None)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (columns id, text, and any others but text are carried) ->
    the others, n_words, hit (word indexes as spans [from, to)), items (array<string>, sorted)."""
    return _contamination(docs, *_blocks(benchmark), window)


def _contamination(docs: DataFrame, items: DataFrame, blocks: list, window: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    many = len(blocks) > 1
    if many:  # rows are told apart when the blocks' results meet
        docs = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
        others = ["__row"]
    schema = schema_plus(docs.select(*others), "n_words bigint, hit array<struct<a:int,b:int>>, items array<string>")

    def scan_for(block):
        shared = _shared_phrases(items, block, window)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                for part in bw.slices(batch, "text", SHARD_BYTES):
                    n, hits, by_text = _shard_result(part, phrases)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(n), pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(by_text, pa.list_(pa.string()))], [*others, "n_words", "hit", "items"])

        return scan

    out = None
    for block in blocks:
        found = docs.select(*others, "text").mapInArrow(scan_for(block), schema)
        out = found if out is None else out.unionByName(found)
    if not many:
        return out
    merged = out.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return docs.drop("text").join(merged, "__row").drop("__row")


def _shard_result(part: pa.RecordBatch, phrases: Phrases | None):
    if phrases is None:
        data, offsets = bw.text_bytes(part.column("text"))
        first = bw.word_ranges(data, offsets, bw.ALNUM)[2]
        return np.diff(first), [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
    _, _, _, _, first, hit, items = shard_hits(part, phrases)
    hits, by_text = [], []
    for i in range(part.num_rows):
        a, b = _spans(hit[first[i] : first[i + 1]]) if i in items else ((), ())
        hits.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)])
        by_text.append(sorted(items.get(i, ())))
    return np.diff(first), hits, by_text


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of hit spans, from the first to the last byte of each span.

    All columns stay; only ``text_col`` changes, and only in contaminated rows.
    """
    names = docs.columns
    inner = docs.select(F.col(text_col).alias("text"), F.col(text_col).alias("__kept"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(names) if c != text_col))
    items, blocks = _blocks(benchmark)
    named = lambda df: df.select(*(F.col("__kept").alias(c) if c == text_col else F.col(f"__c{i}").alias(c) for i, c in enumerate(names)))
    if len(blocks) == 1:
        return named(_cut_in_place(inner.drop("__kept"), _shared_phrases(items, blocks[0], window)).withColumnRenamed("text", "__kept"))
    found = _contamination(inner, items, blocks, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__kept").to_pylist()
            for i, spans in enumerate(batch.column("hit").to_pylist()):
                if spans:
                    texts[i] = remove_spans(texts[i], _merge([(s["a"], s["b"]) for s in spans]))
            at = batch.schema.get_field_index("__kept")
            out = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return named(found.mapInArrow(cut, found.schema))


def _cut_in_place(docs: DataFrame, shared) -> DataFrame:
    """docs (text and any others) with hit words removed, in one scan."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text", SHARD_BYTES):
                if shared.value is None:
                    yield part
                    continue
                data, offsets, start, end, first, hit, items = shard_hits(part, shared.value)
                texts = part.column("text").to_pylist()
                for i in items:
                    a, b = _spans(hit[first[i] : first[i + 1]])
                    texts[i] = _without(data, offsets[i], offsets[i + 1], start[first[i] :], end[first[i] :], zip(a.tolist(), b.tolist(), strict=True))
                at = part.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)], part.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(scan, docs.schema)


def _without(data: np.ndarray, low: int, high: int, start: np.ndarray, end: np.ndarray, spans) -> str:
    """Bytes low to high without the word spans, each from its first to its last byte."""
    keep = []
    for a, b in spans:
        keep.append(data[low : start[a]].tobytes())
        low = int(end[b - 1])
    return b"".join([*keep, data[low:high].tobytes()]).decode()


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = bw.word_ranges(data, np.array([0, len(data)]), bw.ALNUM)
    return _without(data, 0, len(data), start, end, spans)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    if_merged = F.when(F.size("hit") > 1, _hit_words("hit")).otherwise(F.coalesce(F.get("hit", F.lit(0))["b"] - F.get("hit", F.lit(0))["a"], F.lit(0)))
    return found.select(
        "doc_id", "n_words", if_merged.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def _hit_words(column: str):
    """Size of the union of spans, which blocks may have found overlapping."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")
    )
    return F.aggregate(F.array_sort(column), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])
