"""Cross-entropy difference of documents under two matched n-gram models.

The *background* model is counted over all documents, the *target* model over the
documents that labels call good. They are matched: same order (bigrams that back off to
unigrams by interpolation), same smoothing and one shared vocabulary. Every distinct word
and every distinct (previous, word) has a count of its own, by 64-bit hashes; nothing is
dropped or shares a cell, so what is gathered grows with the corpus and stays in tables.

Documents are taken in blocks of about ``BLOCK_TOKENS`` words. A block asks once for each of
its distinct words and bigrams: its sorted hashes and its own counts go to shards by the
first bits of the hash, a shard sums what all blocks sent, and the sums go back to the block
in the order in which it asked. So a very common word is one entry of a block, however
often it occurs, and no count of the whole corpus is ever in one place.

Per token, loss(w | v) = -log(L2 * c(vw) / c(v.) + (1 - L2) * (L1 * c(w) / N + (1 - L1) / V)),
and a document's score is the mean over its tokens of target loss minus background loss:
the lower, the more it is like the target.

Words are what lies between blanks, A-Z in lower case; a text's first word follows a start
mark of its own.

Defined cases: null and wordless texts have no tokens, no losses (null) and a score of 0;
a null id counts towards the background and is returned; repeated rows count each; with no
target rows the target model is the uniform one; repeated target ids mark once; an empty table
gives an empty one; a text of any length is one document of a block, in some 60 bytes of
memory a byte; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import hinted, small_batches, stash

#: The uniform part is over ``1 << UNIGRAM_BITS`` words unless a caller gives or asks for another size.
UNIGRAM_BITS = 18
L1, L2 = 0.9, 0.6
#: Words after which a block ends, with its document: some 200 MB in a task.
BLOCK_TOKENS = 1 << 21
#: Words of a block whose losses are worked out at a time.
SLICE_TOKENS = 1 << 18
#: Shards are ``1 << LEAST_BITS`` at least and as many as there are blocks.
LEAST_BITS = 10
#: Tasks of a stage at most, twice as many as there are blocks up to that; a task takes its blocks or shards in turn.
MOST_TASKS = 20_000
_WORD = bw.byte_table(61, True)
_START = np.uint64(0xA5B3C7D91E2F4861)


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones, which compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, len(b) // width).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, which are hashes, and each key's place among them. One range of keys after another is
    sorted, so that what a sort takes is a sixteenth of the block."""
    part, found, n = (keys >> np.uint64(60)).astype(np.uint8), [], 0
    places = np.empty(len(keys), np.int32)
    for k in range(16):
        here = np.flatnonzero(part == k)
        some, at = np.unique(keys[here], return_inverse=True)
        places[here] = at + n
        n += len(some)
        found.append(some)
    return np.concatenate(found), places


BLOCK = "block bigint, ids binary, no_id binary, lengths binary, good binary, words binary, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """docs (id, text, good) as rows of many documents: the distinct words by hash, and each token's place among them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, serial = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, no_id, lengths, good, hashes = map(np.concatenate, zip(*parts, strict=True))
            parts.clear()
            words, tokens = distinct(np.append(hashes, _START))
            row = [pack(ids), pack(no_id), pack(lengths), pack(good), pack_sorted(words), pack(tokens[:-1].view(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                start, end, first = bw.word_ranges(data, offsets, bw.NOT_SPACE)
                hashes = bw.RangeHash(data, _WORD).of(start, end) if len(start) else np.zeros(0, np.uint64)
                ids = part.column("id")
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.diff(first), good, hashes))
                held += len(hashes)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    held, serial = 0, serial + 1
        if parts:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select("id", "text", "good").mapInArrow(scan, BLOCK)


class Block:
    """A row of ``blocks`` read back; ``word`` and ``ahead`` are places in ``words``, ``pair`` is one in ``pairs``."""

    def __init__(self, row: dict):
        self.block, self.ids, self.no_id = row["block"], unpack(row["ids"], np.int64), unpack(row["no_id"], bool)
        self.lengths, self.words = unpack(row["lengths"], np.int64), unpack_sorted(row["words"])
        self.word = unpack(row["tokens"], np.uint32).view(np.int32)
        self.good = np.repeat(unpack(row["good"], bool), self.lengths)
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.ahead = np.empty_like(self.word)
        self.ahead[1:] = self.word[:-1]
        self.ahead[first] = np.searchsorted(self.words, _START)

    def read_pairs(self) -> None:
        keys = np.empty(len(self.word), np.uint64)
        for low in range(0, len(keys), SLICE_TOKENS):
            some = slice(low, low + SLICE_TOKENS)
            keys[some] = bw.mix(self.words[self.word[some]] + self.words[self.ahead[some]] * np.uint64(0x9E3779B97F4A7C15))
        self.pairs, self.pair = distinct(keys)

    def asked(self, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sorted keys and the counts of this block: words, and words as the one before, or bigrams; background, then target."""
        if kind == "words":
            keys, places = self.words, (self.word, self.ahead)
        else:
            self.read_pairs()
            keys, places = self.pairs, (self.pair,)
        return keys, [np.bincount(p, minlength=len(keys)) for place in places for p in (place, place[self.good])]


SUMS = "block bigint, shard int, sums binary, n_keys bigint, background bigint, target bigint"


def requests(blocked: DataFrame, kind: str, bits: int) -> DataFrame:
    """(shard, block, keys, counts): what each block asks of each shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                pa.default_memory_pool().release_unused()  # a worker is kept, and with it what earlier blocks took
                keys, counts = Block(batch.slice(i, 1).to_pylist()[0]).asked(kind)
                bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(bounds))
                for some in np.array_split(full, max(1, len(full) // 100)):
                    cuts = [slice(bounds[s], bounds[s + 1]) for s in some]
                    columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), pa.array([pack_sorted(keys[c]) for c in cuts], pa.binary())]
                    columns.append(pa.array([pack(np.concatenate([n[c] for n in counts]).astype(np.int64)) for c in cuts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "keys", "counts"])

    return blocked.select(*(c.split()[0] for c in BLOCK.split(", "))).mapInArrow(scan, "shard int, block bigint, keys binary, counts binary")


def tasks_of(n_blocks: int) -> int:
    """A number of one's own, as tasks merged by their bytes would sort many blocks' rows at once."""
    return min(MOST_TASKS, 2 * n_blocks + 1)


def summed(asked: DataFrame, n_blocks: int) -> DataFrame:
    """The sums of each shard, a row for each request, in its order; a row without a block has the shard's totals of the first two counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(shard: int, rows: list) -> pa.RecordBatch:
            keys = [unpack_sorted(k) for _, k, _ in rows]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.cumsum([len(k) for k in keys])
            counts = [unpack(c, np.int64).reshape(-1, len(k)) for (_, _, c), k in zip(rows, keys, strict=True)]
            sums = np.zeros((len(counts[0]), len(distinct)), np.int64)
            for here, add in zip(np.split(at, ends[:-1]), counts, strict=True):
                sums[:, here] += add  # the keys of a request are distinct
            packed = [pack(sums[:, here].reshape(-1)) for here in np.split(at, ends[:-1])]
            none = [None] * len(rows)
            columns = [pa.array([*(b for b, _, _ in rows), None], pa.int64()), pa.array([shard] * (len(rows) + 1), pa.int32()), pa.array([*packed, None], pa.binary())]
            columns += [pa.array([*none, int(n)], pa.int64()) for n in ((sums[0] > 0).sum(), sums[0].sum(), sums[1].sum())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUMS.split(", ")])

        now, rows = None, []
        for batch in batches:
            for shard, *rest in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "keys", "counts")), strict=True):
                if shard != now and rows:
                    yield answers(now, rows)
                    rows = []
                now = shard
                rows.append(rest)
        if rows:
            yield answers(now, rows)

    return asked.repartition(tasks_of(n_blocks), "shard").sortWithinPartitions("shard").mapInArrow(add, SUMS)


def _gathered(parts: list[bytes], n: int) -> np.ndarray:
    """The counts of ``n`` kinds of all parts, which are given up one after another."""
    out, at = np.empty((n, sum(map(len, parts)) // (8 * n)), np.int64), 0
    parts.reverse()
    while parts:
        counts = unpack(parts.pop(), np.int64).reshape(n, -1)
        out[:, at : at + counts.shape[1]] = counts
        at += counts.shape[1]
    return out


def score_blocks(blocked: DataFrame, words: DataFrame, pairs: DataFrame, totals: tuple[int, int], vocabulary: int, n_blocks: int) -> DataFrame:
    """id, n_tokens, target_loss, background_loss, score; the answers come to their block."""

    def score(block: Block, answers: dict[int, list[bytes]]) -> pa.RecordBatch:
        block.read_pairs()
        one_ahead, two = _gathered(answers[1], 4), _gathered(answers[2], 2)
        if one_ahead.shape[1] != len(block.words) or two.shape[1] != len(block.pairs):
            raise ValueError("a block has not got the counts it asked for")
        n = block.lengths
        last, mean = np.cumsum(n), []
        for k in (0, 1):
            unigram = L1 * one_ahead[k] / max(totals[k], 1) + (1 - L1) / vocabulary
            sums = np.zeros(len(block.word) + 1)
            for low in range(0, len(block.word), SLICE_TOKENS):
                some = slice(low, low + SLICE_TOKENS)
                bigram = two[k][block.pair[some]] / np.maximum(one_ahead[2 + k], 1)[block.ahead[some]]
                losses = -np.log(L2 * bigram + (1 - L2) * unigram[block.word[some]])
                np.cumsum(losses, out=sums[low + 1 : low + 1 + len(losses)])
                sums[low + 1 : low + 1 + len(losses)] += sums[low]
            mean.append((sums[last] - sums[last - n]) / np.maximum(n, 1))
        none = n == 0
        return pa.RecordBatch.from_arrays(
            [pa.array(block.ids, mask=block.no_id), pa.array(n), pa.array(mean[1], mask=none), pa.array(mean[0], mask=none), pa.array(np.where(none, 0.0, mean[1] - mean[0]))],
            ["id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, {}
        for batch in batches:
            for i, (block, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if kind == 0:
                    if now is not None:
                        yield score(now, answers)
                    pa.default_memory_pool().release_unused()
                    now, answers = Block(batch.slice(i, 1).to_pylist()[0]), {1: [], 2: []}
                elif now is None or now.block != block:
                    raise ValueError("counts without their block")
                else:
                    answers[kind].append(batch.column("sums")[i].as_py())
        if now is not None:
            yield score(now, answers)

    rows = blocked.withColumns({"kind": F.lit(0), "shard": F.lit(-1)})
    for kind, found in ((1, words), (2, pairs)):
        rows = rows.unionByName(found.filter("block is not null").select("block", F.lit(kind).alias("kind"), "shard", "sums"), allowMissingColumns=True)
    rows = rows.repartition(tasks_of(n_blocks), "block").sortWithinPartitions("block", "kind", "shard")
    return rows.mapInArrow(scan, "id bigint, n_tokens bigint, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = 1 << UNIGRAM_BITS) -> DataFrame:
    """Scores of all ``docs``; those whose id is in ``target_ids`` (column id) are the target text.

    vocabulary: V of the uniform part; None: the number of distinct words of ``docs``.
    """
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    marks = target_ids.select(F.col("id").cast("bigint").alias("__target")).filter("__target is not null").distinct()
    marked = inner.join(hinted(stash(marks, "target")), F.col("id") == F.col("__target"), "left").select("id", "text", F.col("__target").isNotNull().alias("good"))
    blocked = stash(blocks(marked), "blocks")
    n_blocks = blocked.count()
    bits = max(LEAST_BITS, n_blocks.bit_length())
    small_batches(docs.sparkSession)
    words = stash(summed(requests(blocked, "words", bits), n_blocks), "words")
    n_words, *totals = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "background", "target"))).first()
    return score_blocks(blocked, words, summed(requests(blocked, "pairs", bits), n_blocks), tuple(totals), max(n_words, 1) if vocabulary is None else vocabulary, n_blocks)


def lm_score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: target text is what labels call good and not toxic; V is the number of distinct words;
    losses to six places."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("id"))
    scored = cross_entropy_difference(docs, good, vocabulary=None)
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "score")))
