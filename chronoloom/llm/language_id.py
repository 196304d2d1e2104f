"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary. A word (a run
of letters and marks, in lower case, with a mark for its beginning) has as probability the
sum over all ways to cut it into pieces, by a forward recursion; single characters are
always pieces, so each word has one way at least. A text's log-probability is the sum over
its words, and languages compete with equal priors. All letter pieces of the vocabulary
take part, whatever their length, and words are never cut.

The probabilities are learned by expectation maximisation: forward and backward sums give
expected piece counts per language in each task, and tasks' sums meet by (language,
piece). Training texts are drawn by a hash of the id, about ``FIT_DOCS`` per language, from
documents with a language whose crc32(doc_id as text) mod 3 is not 1. Every document is
scored, where it lies.

Words are counted once per slice of a batch, and the recursion runs over all distinct
words of one length together; words over ``LONG_WORD`` characters go one by one, in
logarithms, which no length takes out of range.

Defined cases: ``lang_pred`` is ``und`` with score 0 for null texts and texts without a
letter, and where nothing could be learned; null languages do not teach; ties go to the
first language in alphabetical order; null ids and repeated rows are rows like others; an
empty table gives an empty one; texts of any length are taken whole, a slice of words at a
time. The model has a column per language, so more than ``MOST_LANGUAGES`` distinct values of
lang are an error rather than a model of unknown size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import fold, small_batches, stash

FIT_DOCS, ROUNDS, SMOOTHING = 1500, 2, 0.1
MOST_LANGUAGES, LONG_WORD = 500, 32
#: The words of a batch that are treated at a time.
SLICE_BYTES = 1 << 20
MARK = "▁"
_LETTER = regex.compile(r"\p{L}")
_WORD = bw.byte_table(71, False)
_CHAR_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that consist of letters (with or without the mark), in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if regex.fullmatch(MARK + r"?[\p{L}\p{M}]*", p)} - {""})


def _longer(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of pieces that go on by a character each."""
    h = (h ^ chars.astype(np.uint64)) * _CHAR_MIX
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Numbers of pieces; number 0 stands for any character outside the vocabulary.

    ``hashes`` are those of all beginnings of pieces, ``numbers`` the pieces that they are (-1: a
    beginning only), so a piece is found by going on from character to character.
    """

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        number = {p: i + 1 for i, p in enumerate(pieces)}
        beginnings = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len)
        found: dict[str, int] = {}
        for p in beginnings:
            found[p] = int(_longer(np.array([found.get(p[:-1], 0)], np.uint64), np.array([ord(p[-1])]))[0])
        hashes = np.array([found[p] for p in beginnings], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array([number.get(p, -1) for p in beginnings], np.int64)[order]

    def from_start(self, chars: np.ndarray):
        """Of rows of code points: (length, rows, piece numbers) of the pieces at their beginning."""
        rows, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for length in range(1, min(chars.shape[1], self.longest) + 1):
            h = _longer(h, chars[rows, length - 1])
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                numbers = np.where(known, self.numbers[at], -1)
            else:
                known, numbers = np.zeros(len(h), bool), np.full(len(h), -1)
            if length == 1:
                numbers = np.maximum(numbers, 0)
            hit = numbers >= 0
            if hit.any():
                yield length, rows[hit], numbers[hit]
            rows, h = rows[known], h[known]
            if not len(rows):
                return

    def lattice(self, chars: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(end, length) -> rows and piece numbers, for words of equal length, ends ascending."""
        out = {}
        for start in range(chars.shape[1]):
            for length, rows, numbers in self.from_start(chars[:, start:]):
                out[start + length, length] = (rows, numbers)
        return dict(sorted(out.items()))


def forward(lattice: dict, n_words: int, n_chars: int, p: np.ndarray) -> np.ndarray:
    """[n_chars + 1, words, languages]: summed probabilities of all segmentations of each prefix."""
    alpha = np.zeros((n_chars + 1, n_words, p.shape[1]))
    alpha[0] = 1
    for (end, length), (rows, numbers) in lattice.items():
        alpha[end, rows] += alpha[end - length, rows] * p[numbers]
    return alpha


def expected_counts(lattice: dict, alpha: np.ndarray, p: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Adds expected piece counts, weighted by word and language, to out [pieces, languages]."""
    n = len(alpha) - 1
    beta = np.zeros_like(alpha)
    beta[n] = 1
    for (end, length), (rows, numbers) in sorted(lattice.items(), key=lambda x: -x[0][0]):
        beta[end - length, rows] += beta[end, rows] * p[numbers]
    scale = weight / np.maximum(alpha[n], 1e-300)
    for (end, length), (rows, numbers) in lattice.items():
        share = alpha[end - length, rows] * p[numbers] * beta[end, rows] * scale[rows]
        for language in range(p.shape[1]):
            out[:, language] += np.bincount(numbers, weights=share[:, language], minlength=len(out))


class LongWord:
    """Segmentations of one long word (code points): the same recursions in logarithms."""

    def __init__(self, pieces: Pieces, chars: np.ndarray):
        self.n = n = len(chars)
        padded = np.concatenate([chars, np.zeros(pieces.longest, chars.dtype)])  # no piece has a character 0
        windows = np.lib.stride_tricks.sliding_window_view(padded, pieces.longest)[:n]
        found = [(rows, rows + length, numbers) for length, rows, numbers in pieces.from_start(windows)]
        self.start, self.end, self.number = (np.concatenate(x) for x in zip(*found, strict=True))
        self.by_end, self.by_start = np.argsort(self.end, kind="stable"), np.argsort(self.start, kind="stable")

    def sums(self, log_p: np.ndarray, back: bool = False) -> np.ndarray:
        """[n + 1, languages]: logarithms of the sums over segmentations of each prefix (or suffix)."""
        order, here, there = (self.by_start, self.start, self.end) if back else (self.by_end, self.end, self.start)
        borders = np.searchsorted(here[order], np.arange(self.n + 2))
        out = np.zeros((self.n + 1, log_p.shape[1]))
        for at in range(self.n - 1, -1, -1) if back else range(1, self.n + 1):
            some = order[borders[at] : borders[at + 1]]
            x = out[there[some]] + log_p[self.number[some]]
            most = x.max(0)
            out[at] = most + np.log(np.exp(x - most).sum(0))
        return out

    def add_counts(self, log_p: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        head, tail = self.sums(log_p), self.sums(log_p, True)
        share = np.exp(head[self.start] + log_p[self.number] + tail[self.end] - head[self.n]) * weight
        np.add.at(out, self.number, share)


def lowered(part: pa.RecordBatch) -> list[str]:
    return [(t or "").lower() for t in part.column("text").to_pylist()]


#: Words: runs of letters and marks; all else separates.
_WORDS = regex.compile(r"[\p{L}\p{M}]+")


def _ascii_separators() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[0x61:0x7B] = True
    inside[0x80:] = True
    return inside


_INSIDE = _ascii_separators()


def distinct_words(texts: list[str]):
    """Distinct words of texts (already in lower case), and for each word of each text which it is."""
    column = pa.array(texts, pa.large_string())
    data, offsets = bw.text_bytes(column)
    start, end, first = bw.word_ranges(data, offsets, _INSIDE)
    if not len(start):
        return [], np.zeros(0, np.int64), first
    hashes = bw.RangeHash(data, _WORD).of(start, end)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[s:e].decode() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)], which, first


def word_parts(words: list[str]):
    """Marked words as code points, grouped by length: length -> (numbers of words, code points).

    Separators outside ASCII are taken here: one entry of ``words`` may hold several words.
    """
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for i, word in enumerate(words):
        for run in [word] if word.isalpha() else _WORDS.findall(word):
            numbers, strings = groups.setdefault(len(run) + 1, ([], []))
            numbers.append(i)
            strings.append(MARK + run)
    return {n: (np.array(numbers), np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(-1, n)) for n, (numbers, strings) in groups.items()}


def word_scores(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """[words, languages]: log-probabilities."""
    out = np.zeros((len(words), p.shape[1]))
    for n, (numbers, chars) in word_parts(words).items():
        if n > LONG_WORD:
            for number, one in zip(numbers.tolist(), chars, strict=True):
                out[number] += LongWord(pieces, one).sums(np.log(p))[n]
            continue
        alpha = forward(pieces.lattice(chars), len(chars), n, p)
        np.add.at(out, numbers, np.log(np.maximum(alpha[n], 1e-300)))
    return out


class LanguageModel:
    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self.cache: dict[str, np.ndarray] = {}

    def scores(self, words: list[str]) -> np.ndarray:
        """As word_scores; words met before, up to a bound, are looked up."""
        cache = self.cache
        if len(cache) > 150_000:
            cache.clear()
        new = [w for w in words if w not in cache]
        if new:
            cache.update(zip(new, word_scores(new, self.pieces, self.p).astype(np.float32), strict=True))
        return np.stack([cache[w] for w in words]).astype(np.float64) if words else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, which, first = distinct_words([(t or "").lower() for t in texts])
        n = len(self.languages)
        if not n:
            return ["und"] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(which) + 1, n))
        np.cumsum(self.scores(words)[which] if len(which) else np.zeros((0, n)), axis=0, out=sums[1:])
        total = sums[first[1:]] - sums[first[:-1]]
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = share.max(1) / share.sum(1)
        names, scores = [], []
        for i, t in enumerate(texts):
            known = t is not None and _LETTER.search(t) is not None
            names.append(self.languages[best[i]] if known else "und")
            scores.append(float(score[i]) if known else 0.0)
        return names, scores


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """docs: text, lang (not null), id. Piece counts of size languages x pieces reach the driver."""
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct values of lang")
    languages = sorted(sizes)
    pieces = Pieces(load_pieces(path))
    p = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    if not languages:
        return LanguageModel([], pieces, p)
    bound = F.lit(0)
    for name in languages:
        bound = F.when(F.col("lang") == name, F.lit(int(min(1.0, fit_docs / sizes[name]) * (1 << 30)))).otherwise(bound)
    drawn = docs.filter(F.pmod(F.xxhash64("id", "text", F.lit(9)), F.lit(1 << 30)) < bound).select("lang", "text")
    drawn = stash(drawn, "sample")
    number = {name: i for i, name in enumerate(languages)}
    small_batches(spark)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, p))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, p = shared.value
            out = np.zeros(p.shape)
            for batch in batches:
                for part in bw.slices(batch, "text", SLICE_BYTES):
                    words, which, first = distinct_words(lowered(part))
                    if not words:
                        continue
                    language = np.repeat([number[x] for x in part.column("lang").to_pylist()], np.diff(first))
                    weight = np.zeros((len(words), p.shape[1]))
                    np.add.at(weight, (which, language), 1.0)
                    for n, (numbers, chars) in word_parts(words).items():
                        if n > LONG_WORD:
                            for i, one in zip(numbers.tolist(), chars, strict=True):
                                LongWord(pieces, one).add_counts(np.log(p), weight[i], out)
                            continue
                        lattice = pieces.lattice(chars)
                        expected_counts(lattice, forward(lattice, len(chars), n, p), p, weight[numbers], out)
            piece, language = np.nonzero(out > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(out[piece, language])], ["piece", "language", "n"])

        counted = drawn.mapInArrow(scan, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).collect()
        counts = np.full(p.shape, SMOOTHING)
        for piece, language, n in counted:
            counts[piece, language] += n
        p = counts / counts.sum(0)
    return LanguageModel(languages, pieces, p)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(id, lang_pred, score) of docs (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text", SLICE_BYTES):
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(scan, "id bigint, lang_pred string, score double")


def language_digest(docs: DataFrame, path: str) -> DataFrame:
    """The registered query: doc_id, held_out, lang_pred, score."""
    inner = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", "lang")
    model = fit(inner.filter("lang is not null and text is not null").filter(fold("id", 3) != 1), path)
    found = identify(inner, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
