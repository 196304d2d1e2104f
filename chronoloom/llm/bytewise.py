"""Vectorised text work on the UTF-8 bytes of Arrow batches.

Splitting into words or lines and hashing the pieces are done for a whole slice
of a batch at once with numpy: a table tells which bytes belong to a word, and a
prefix sum of ``table[byte] * P**position`` (mod 2**64) gives the hash of any
byte range in constant time. Separators of every contract here are ASCII, so
working on bytes equals working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a single longer text is handled whole.
SLICE_BYTES = 1 << 19

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of words split at blanks, and of words of ASCII letters, digits and any non-ASCII.
NOT_SPACE = ~SPACE_BYTES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_P = 0x9E3779B97F4A7C55 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """256 random uint64; with ``lower`` A-Z have the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919 + 1))
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class RangeHash:
    """Hashes of byte ranges of ``data``: of each, the sum of ``table[byte] * P**place``, mixed.

    Prefix sums give them; as these take many times the bytes, longer data goes through part by
    part, each ending where a range does, and a range longer than a part is summed over parts of it.
    """

    def __init__(self, data: np.ndarray, table: np.ndarray):
        self._data, self._table = data, table

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``start`` and ``end`` ascending, ranges apart from each other."""
        return mix(self._raw(start, end))

    def _raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, i, n = np.zeros(len(start), np.uint64), 0, len(start)
        while i < n:
            low = int(start[i])
            j = int(np.searchsorted(end, low + SLICE_BYTES, side="right"))
            if j > i:
                out[i:j] = self._sums(low, int(end[j - 1]), start[i:j], end[i:j])
            else:
                j, total = i + 1, 0
                for at in range(low, int(end[i]), SLICE_BYTES):
                    to = min(int(end[i]), at + SLICE_BYTES)
                    total += int(self._sums(at, to, np.array([at]), np.array([to]))[0]) * pow(_P, at - low, 1 << 64)
                out[i] = total % (1 << 64)
            i = j
        return out

    def _sums(self, low: int, high: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        data = self._data[low:high]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._table[data] * _powers_of(_P, len(data)), out=sums[1:])
        return (sums[end - low] - sums[start - low]) * _powers_of(_P_INV, len(data) + 1)[start - low]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row slices of a batch with about ``limit`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start, before = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def word_ranges(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    cut = np.zeros(n, bool)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | cut[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(start, offsets)


def line_ranges(data: np.ndarray, offsets: np.ndarray, at: int = 0x0A) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines; every text has one line at least."""
    breaks = np.flatnonzero(data == at)
    texts = np.searchsorted(offsets[1:], breaks, side="right")
    counts = np.bincount(texts, minlength=len(offsets) - 1) + 1
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=first[1:])
    start = np.empty(first[-1], np.int64)
    end = np.empty(first[-1], np.int64)
    lead = np.zeros(first[-1], bool)
    lead[first[:-1]] = True
    start[lead] = offsets[:-1]
    start[~lead] = breaks + 1
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    end[tail] = offsets[1:]
    end[~tail] = breaks
    return start, end, first


def strip_ranges(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges, which lie between line breaks, without blanks at both ends; empty ones become (start, start)."""
    first, last, _ = word_ranges(data, offsets, NOT_SPACE)
    low, high = np.searchsorted(first, start), np.searchsorted(first, end)
    full = low < high
    s, e = start.copy(), start.copy()
    s[full], e[full] = first[low[full]], last[high[full] - 1]
    return s, e


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts (n + 1) of code points, taken at their first bytes."""
    out = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive entries (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text, and the text of each.

    A text of fewer than ``k`` words, but not none, gives its whole sequence as one.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    every = runs(words, k)
    ok = text[: len(every)] == text[k - 1 : k - 1 + len(every)] if len(every) else np.zeros(0, bool)
    hashes, owner = every[ok], text[: len(every)][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([runs(words[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        extra = mix(extra + counts[short].astype(np.uint64))  # not the hash of a longer run
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
