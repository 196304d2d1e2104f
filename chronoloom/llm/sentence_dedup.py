"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line breaks and after ``.``, ``!`` or ``?`` before a blank;
its *words* are what lies between blanks. Every run of ``size`` consecutive sentences with
words is hashed (words only, A-Z in lower case, so spacing does not matter). As short
phrases recur by chance, a run of fewer than ``min_words`` words is not taken as it is: with
``go_on``, as in the registered query, it goes on, once with the sentences after it and once
with those before it, until it holds that many; else it is left alone. Runs are joined globally; of equal runs the first, in the smallest id, stays, and every sentence that another
one covers is removed.

A hot run is counted with partial aggregation, and its later occurrences are found by a
join that splits skewed keys, so no key's rows meet in one task.

Defined cases: null or wordless texts have no sentences and stay; texts with fewer
sentences or words than a run have no runs; rows with null ids stay untouched; rows that share an
id count as one document, so repeats between them stay, while repeats within a text go; an empty
table gives an empty one; texts of any length are cut whole, in some 80 bytes of memory a byte
of the longest text; other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import schema_plus, small_batches, stash

#: Two, as a passage of some fifty words set into other text may hold no more whole sentences.
SIZE, MIN_WORDS = 2, 12
_SEEDS = (51, 52)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Words (start, end, first of text) and sentences (first word, n + 1; first sentence of text, n + 1)."""
    start, end, first = bw.word_ranges(data, offsets, bw.NOT_SPACE)
    if not len(start):
        return start, end, first, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lines = np.searchsorted(np.flatnonzero(data == 0x0A), start)  # line breaks before each word
    opens = np.zeros(len(start), bool)
    opens[first[:-1][first[:-1] < len(start)]] = True
    opens[1:] |= _END[data[end[:-1] - 1]] | (lines[1:] > lines[:-1])
    at = np.flatnonzero(opens)
    return start, end, first, np.append(at, len(start)), np.searchsorted(at, first)


def _runs(data: np.ndarray, offsets: np.ndarray, size: int, min_words: int, go_on: bool):
    """(text, place, span, h1, h2) of the runs; span is the number of sentences, ``size`` if they have the words."""
    start, end, first, sentence, of_text = sentences(data, offsets)
    text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
    n = len(text)
    # from each sentence on, and up to each sentence
    on = np.maximum(np.arange(n) + size, np.searchsorted(sentence, sentence[:-1] + min_words))
    up = np.minimum(np.arange(1, n + 1) - size, np.searchsorted(sentence, sentence[1:] - min_words, side="right") - 1)
    forth, back = np.flatnonzero(on <= of_text[text + 1]), np.flatnonzero(up >= of_text[text])
    at, to = np.concatenate([forth, up[back]]), np.concatenate([on[forth], back + 1])
    at, to = np.divmod(np.unique(at * (n + 1) + to), n + 1)
    if not go_on:
        at, to = at[to - at == size], to[to - at == size]
    hashes = []
    for seed in _SEEDS:
        words = bw.RangeHash(data, bw.byte_table(seed, True)).of(start, end)
        # the hash of a run of words, again by prefix sums
        sums = np.zeros(len(words) + 1, np.uint64)
        powers = bw._powers_of(bw._P, len(words) + 1)
        np.cumsum(words * powers[:-1], out=sums[1:])
        low, high = sentence[at], sentence[to]
        hashes.append(bw.mix((sums[high] - sums[low]) * bw._powers_of(bw._P_INV, len(words) + 1)[low] + (high - low).astype(np.uint64)))
    return text[at], at - of_text[text[at]], to - at, *hashes


def span_hashes(docs: DataFrame, size: int, min_words: int, go_on: bool) -> DataFrame:
    """(id, row, place, again, h1, h2): a row for each run; ``docs`` has id, row and text.

    ``place``: the first sentence, shifted by 32 bits, and the number of sentences.
    ``again``: the run was in the same text before.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                text, place, span, h1, h2 = _runs(data, offsets, size, min_words, go_on)
                if len(text):
                    owner = pa.array(text)
                    order = np.lexsort((place, h1, text))
                    again = np.zeros(len(text), bool)
                    again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                    columns = [part.column("id").take(owner), part.column("row").take(owner), pa.array(place << 32 | span), pa.array(again), pa.array(bw.signed(h1)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "row", "place", "again", "h1", "h2"])

    small_batches(docs.sparkSession)
    return docs.filter("id is not null").select("id", "row", "text").mapInArrow(scan, "id bigint, row bigint, place bigint, again boolean, h1 bigint, h2 int")


def repeated_spans(docs: DataFrame, size: int = SIZE, min_words: int = MIN_WORDS, go_on: bool = False) -> DataFrame:
    """(id, row, places): where the non-first occurrences of repeated runs lie."""
    spans = span_hashes(docs, size, min_words, go_on)
    shared = spans.filter("not again").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h1", "h2", "first")
    shared = stash(shared, "spans")  # far fewer than there are runs
    later = spans.join(shared, ["h1", "h2"], "left").filter("again or id > first")
    return later.groupBy("id", "row").agg(F.collect_set("place").alias("places"))


def dedup_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, min_words: int = MIN_WORDS, go_on: bool = False) -> DataFrame:
    """``docs`` without sentences that a non-first repeated run covers.

    Adds n_sentences, n_removed and words_removed (replacing columns of those names).
    """
    added = ("n_sentences", "n_removed", "words_removed")
    names = [c for c in docs.columns if c not in added]
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(names) if c != text_col))
    # tells rows of one id apart when places are joined back
    inner = inner.withColumn("row", F.coalesce(F.xxhash64("text"), F.lit(0)))
    found = repeated_spans(inner.select("id", "row", "text"), size, min_words, go_on)
    joined = inner.join(found.withColumnsRenamed({"id": "__id", "row": "__row"}), (F.col("id") == F.col("__id")) & (F.col("row") == F.col("__row")), "left").drop("__id", "__row", "row", "id")
    schema = schema_plus(joined.drop("places"), "n_sentences bigint, n_removed bigint, words_removed bigint")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                data, offsets = bw.text_bytes(part.column("text"))
                start, end, first, sentence, of_text = sentences(data, offsets)
                texts = part.column("text").to_pylist()
                removed, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for i, places in enumerate(part.column("places").to_pylist()):
                    if not places:
                        continue
                    gone = np.zeros(of_text[i + 1] - of_text[i], bool)
                    for place in places:
                        gone[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)] = True
                    texts[i], words[i] = _without(data, offsets[i], offsets[i + 1], start, end, sentence[of_text[i] : of_text[i + 1] + 1], gone)
                    removed[i] = gone.sum()
                out = {c: part.column(c) for c in part.schema.names if c != "places"}
                out |= {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(np.diff(of_text)), "n_removed": pa.array(removed), "words_removed": pa.array(words)}
                yield pa.RecordBatch.from_pydict(out)

    small_batches(docs.sparkSession)
    return joined.mapInArrow(cut, schema).select(*(F.col("text").alias(c) if c == text_col else F.col(f"__c{i}").alias(c) for i, c in enumerate(names)), *added)


def _without(data: np.ndarray, low: int, high: int, start: np.ndarray, end: np.ndarray, sentence: np.ndarray, gone: np.ndarray) -> tuple[str, int]:
    """The text without the sentences; each goes from its first byte up to the next sentence's."""
    edges = np.append(start[sentence[:-1]], high)
    kept = [data[low : edges[0]].tobytes()] + [data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~gone)]
    return b"".join(kept).decode(), int((sentence[1:] - sentence[:-1])[gone].sum())


def sentence_dedup_digest(docs: DataFrame, go_on: bool = False) -> DataFrame:
    """The registered query (with ``go_on``): doc_id, n_sentences, n_removed, words_removed, kept_sha256."""
    cut = dedup_sentences(docs.select("doc_id", "text"), go_on=go_on)
    return cut.select("doc_id", "n_sentences", "n_removed", "words_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
