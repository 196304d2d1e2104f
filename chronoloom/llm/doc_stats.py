"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from chronoloom.llm import bytewise as bw

#: The symbols whose share speaks of junk (fixed value).
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER, _DIGIT, _STOP, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_STOP[list(b".!?")] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_WORD = bw.byte_table(41, False)
_LINE = bw.byte_table(42, False)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "stop_per_word", "bang_per_word", "distinct_share", "longest_word", "words_per_line", "non_ascii_share", "bar_per_word", "short_share",
)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of numbers, or counts of what is true, between the bounds."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), bounds))
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one before them in their text, and which have any equal one."""
    n = len(hashes)
    earlier, any_equal = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.argsort(hashes, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        h, o = hashes[order], owner[order]
        same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        earlier[order[1:][same]] = True
        any_equal[order[1:][same]] = True
        any_equal[order[:-1][same]] = True
    return earlier, any_equal


def statistics(part: pa.RecordBatch, features: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five base counts by name, and the float matrix of FEATURES (or of none)."""
    data, offsets = bw.text_bytes(part.column("text"))
    n = len(offsets) - 1
    start, end, first = bw.word_ranges(data, offsets, bw.NOT_SPACE)
    n_words = np.diff(first)
    points = bw.code_points(data)
    chars = points[end] - points[start]
    word_of = np.repeat(np.arange(n), n_words)
    hashes = bw.RangeHash(data, _WORD).of(start, end) if len(start) else np.zeros(0, np.uint64)

    lines_start, lines_end, lines_first = bw.line_ranges(data, offsets)
    with_word = np.searchsorted(start, lines_start) < np.searchsorted(start, lines_end)
    at = np.flatnonzero(with_word)
    dup = np.zeros(len(lines_start), bool)
    if len(at):
        line_of = np.searchsorted(lines_first, at, side="right") - 1
        dup[at] = _repeated(bw.RangeHash(data, _LINE).of(lines_start[at], lines_end[at]), line_of)[0]

    covered = np.zeros(len(start), bool)
    windows = bw.runs(hashes, 3)
    if len(windows):
        inside = word_of[: len(windows)] == word_of[2:]
        at = np.flatnonzero(inside)
        twice = at[_repeated(windows[at], word_of[at])[1]]
        for k in range(3):
            covered[twice + k] = True

    counts = {
        "n_words": n_words,
        "word_chars": _per_text(chars, first),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": _per_text(dup, lines_first),
        "n_repeat_words": _per_text(covered, first),
    }
    if not features:
        return counts, np.zeros((n, 0))
    length = np.maximum(points[offsets[1:]] - points[offsets[:-1]], 1)
    words = np.maximum(n_words, 1)
    lines = np.maximum(np.diff(lines_first), 1)
    share = lambda table: _per_text(table[data], offsets) / length
    of = lambda byte: _per_text(data == byte, offsets) / words
    longest = np.zeros(n)
    if len(chars):
        full = np.flatnonzero(n_words)
        longest[full] = np.maximum.reduceat(chars, first[full])
    fresh = ~_repeated(hashes, word_of)[0]
    columns = [
        np.log1p(n_words), counts["word_chars"] / words, counts["n_symbols"] / length, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words,
        share(_UPPER), share(_DIGIT), share(_MARK), _per_text(_STOP[data], offsets) / words, of(0x21),
        _per_text(fresh, first) / words, np.log1p(longest), np.log1p(n_words / lines), _per_text(data >= 0xC0, offsets) / length, of(0x7C), _per_text(chars <= 3, first) / words,
    ]
    return counts, np.stack(columns, axis=1).astype(np.float64)
