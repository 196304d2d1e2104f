"""Documents drawn to be like a target: importance resampling on hashed word features.

A text's features are its words and its pairs of consecutive words, each in a bucket by its
CRC-32. Buckets counted over all documents and over all target texts give each bucket a gain, the
logarithm of how much likelier it is in the target. A document's weight is the mean gain of its
features; weight plus Gumbel noise, the same for an id in every run, ranks the documents, and
the best of them are a draw without replacement in proportion to their importance.

CRC-32 is linear but for a constant of the length: a message's value is the XOR of what each
byte contributes at its distance from the end. ``POSITIONS`` holds that for every byte and for
distances below ``REACH``; one gather and one ``bitwise_xor.reduceat`` over the spans of all words
of a part give all their values. A pair is its first word farther from the end, XOR its
second word. Longer spans are cut into blocks of ``REACH`` bytes that are folded pairwise from the
end, with tables that move a value on by a block, two, four and so on.

Counts of buckets are summed inside each task before they are shuffled; the table of gains has
one entry a bucket, whatever the input. Texts are read twice and never shuffled. Ranks come from
a range partitioning: the place within a partition plus the sizes of those before it.

Defined cases: null and empty texts, and those without a word, have no features, weight 0 and no
rank; texts of any length are taken whole, part by part, in memory for a part, the longest word
and 20 bytes a word of a batch; repeated rows count and are ranked each; null ids draw their noise from
the text '' and come last among ties; an empty table gives no rows, an empty target only
gains from the sizes of buckets; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.bytewise import ALNUM, slices, text_bytes, word_ranges
from chronoloom.llm.common import small_batches, stash

BUCKETS = 10_000
#: Distances from the end that the table covers, and bytes of a block of longer spans.
REACH = 64
#: Bytes of text whose words are handled at a time.
PART_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _zero_bytes(register: np.ndarray, n: int, one: np.ndarray) -> np.ndarray:
    """The register after ``n`` bytes of 0."""
    for _ in range(n):
        register = (register >> np.uint32(8)) ^ one[register & np.uint32(255)]
    return register


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """POSITIONS, whose row d + 1 is of bytes with d bytes after them and whose row 0 is 0, and the CRC of n zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1)).astype(np.uint32)
    rows = [np.zeros(256, np.uint32), one]
    while len(rows) <= REACH:
        rows.append(_zero_bytes(rows[-1], 1, one))
    return np.stack(rows), np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


POSITIONS, LENGTHS = _tables()


def _moves() -> Iterator[np.ndarray]:
    """Tables [byte of a value, its content] that move values on by 1, 2, 4, ... blocks."""
    table = np.stack([_zero_bytes(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), REACH, POSITIONS[1]) for i in range(4)])
    while True:
        yield table
        table = _moved(table, table)


def _moved(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][values & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ table[i][(values >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of groups of these sizes: its group, and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges of one byte or more, block by block."""
    size = end - start
    blocks = -(-size // REACH)
    owner, place = _ragged(blocks)
    high = end[owner] - (blocks[owner] - 1 - place) * REACH
    low = np.maximum(high - REACH, start[owner])
    block, at = _ragged(high - low)
    place = low[block] + at
    values = np.bitwise_xor.reduceat(POSITIONS[high[block] - place, data[place]], np.cumsum(high - low) - (high - low)) if len(place) else np.zeros(0, np.uint32)
    for move in _moves():
        if not len(blocks) or blocks.max() <= 1:
            break
        owner, place = _ragged(blocks)
        right = np.flatnonzero((blocks[owner] - 1 - place) % 2 == 0)
        values = values[right] ^ np.where(place[right] > 0, _moved(values[np.maximum(right - 1, 0)], move), np.uint32(0))
        blocks = (blocks + 1) // 2
    lengths, which = np.unique(size, return_inverse=True)
    return values ^ np.array([zlib.crc32(bytes(int(n))) for n in lengths], np.uint32)[which]


def word_crcs(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of words that lie in ``data`` one after the other with one byte after each, a blank, and of
    each word, blank and next word; ``size`` are the words' bytes."""
    end = np.cumsum(size + 1) - 1
    start = end - size
    distance = np.repeat(end, size + 1) - np.arange(len(data))  # 0 at the blank
    value = lambda d: np.bitwise_xor.reduceat(POSITIONS.ravel()[(np.minimum(d, REACH) << 8) + data], start)
    one = value(distance)
    words = one ^ LENGTHS[np.minimum(size, REACH)]
    after, both = size[1:], size[:-1] + 1 + size[1:]
    pairs = value(distance + np.repeat(np.append(after, 0) + 1, size + 1))[:-1] ^ one[1:] ^ LENGTHS[np.minimum(both, REACH)]
    for long, out, low, high in ((size > REACH, words, start, end), (both > REACH, pairs, start[:-1], end[1:])):
        if long.any():
            out[long] = folded(data, low[long], high[long])
    return words, pairs


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that end where no word goes on."""
    low, n = 0, len(data)
    while low < n:
        high = min(low + PART_BYTES, n)
        if high < n:
            gaps = np.flatnonzero(~ALNUM[data[low:high]])
            bound = int(offsets[np.searchsorted(offsets, high, side="right") - 1])
            cut = max(low + int(gaps[-1]) + 1 if len(gaps) else low, bound)
            while cut <= low:  # a word of more than a part: on to its end
                gaps = np.flatnonzero(~ALNUM[data[high : high + PART_BYTES]])
                bound = int(offsets[np.searchsorted(offsets, high, side="left")])
                cut = min(bound, high + int(gaps[0]) + 1) if len(gaps) else bound if bound <= high + PART_BYTES else low
                high += PART_BYTES
            high = cut
        yield low, high
        low = high


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: the text of each word, and the text and bucket of each feature."""
    data, offsets = text_bytes(column)
    held, held_text = np.zeros(0, np.uint8), -1  # the last word of the part before
    for low, high in _parts(data, offsets):
        part = data[low:high]
        start, end, first = word_ranges(part, np.clip(offsets - low, 0, high - low), ALNUM)
        if not len(start):
            continue
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        size = end - start
        place = np.arange(int((size + 1).sum())) + np.repeat(start - (np.cumsum(size + 1) - size - 1), size + 1)
        packed = _LOWER[part[np.minimum(place, len(part) - 1)]]
        packed[np.cumsum(size + 1) - 1] = 0x20
        goes_on = held_text == text[0]
        if goes_on:
            packed, size, every = np.concatenate([held, packed]), np.append(len(held) - 1, size), np.append(held_text, text)
        else:
            every = text
        words, pairs = word_crcs(packed, size)
        beside = every[:-1] == every[1:]
        yield text, np.concatenate([text, every[1:][beside]]), np.concatenate([words[int(goes_on) :], pairs[beside]]) % np.uint32(BUCKETS)
        held, held_text = packed[len(packed) - int(size[-1]) - 1 :].copy(), int(text[-1])


# -- Spark ---------------------------------------------------------------------------


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for some in slices(batch, "text"):
                for _, _, bucket in features(some.column(0)):
                    total += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                n = some.num_rows
                words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for text, owner, bucket in features(some.column(1)):
                    words += np.bincount(text, minlength=n)
                    count += np.bincount(owner, minlength=n)
                    total += np.bincount(owner, gain[bucket], minlength=n).astype(np.int64)  # whole numbers below 2 ** 53
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                score = weight + np.array([noise(i, seed) for i in some.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, (words, count, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place in that order as ``rank``, from 1: no task holds more than a range of them.

    The order has to tell rows apart, or those that it doesn't are alike."""
    # a task numbers its rows in order, with its number in the higher bits
    placed = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    before = dict(zip([r["__part"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist(), strict=False))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "__part bigint, __before bigint"))
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn("rank", F.col("__at") - F.shiftleft("__part", 33) + F.col("__before") + 1).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``share`` percent of the documents of ``least`` words
    or more are drawn and have a rank."""
    scored = stash(importance_scores(docs, target, seed), "scores")
    able = scored.filter(F.col("n_words") >= least)
    most = share * able.count() // 100
    rank = F.when(F.col("rank") <= most, F.col("rank")).alias("rank")
    drawn = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.monotonically_increasing_id())
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    return drawn.select(*names, rank).union(scored.filter(F.col("n_words") < least).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
