"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks.

A text is cut at added tokens and then into pieces by the vocabulary's pattern; merges
never cross pieces. Within a piece the leaves of a segment tree hold the rank of each
adjacent pair, together with its position, and inner nodes the smaller of their
children. The root is therefore the leftmost pair of lowest rank. A merge changes three
leaves, each in logarithmic time, until the root says that no pair can merge.

The distinct pieces of a slice of texts that a worker has not met are merged side by
side: pieces of like length are rows of one matrix of trees, and each round takes the
root of every row that still has one. Pieces over ``ROW_BYTES`` have a tree of their own.

Texts are encoded where they lie, without a shuffle. A worker keeps up to
``CACHE_PIECES`` pieces within a task and the first ``HOT_PIECES`` of them, which are the
common ones, over tasks.

Defined cases: null and empty texts have no tokens and decode to the empty text; added
tokens in a text become their ids, as the tokenizers library does by default; repeated
rows and ids are rows like others, an empty table gives an empty one; columns named like
the results are replaced. Texts of any length are cut where a blank follows a non-blank,
which always ends a piece, and go through in chunks of ``CHUNK_CHARS``; a single piece (a
run without such a place) of n bytes takes some 30 n bytes of memory.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bytewise as bw
from chronoloom.llm.common import schema_plus, small_batches

#: The pattern that the ByteLevel pre-tokenizer stands for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES, HOT_PIECES = 200_000, 50_000
#: Longest piece that is a row of a matrix, entries of such a matrix, characters taken at a time.
ROW_BYTES, MATRIX, CHUNK_CHARS = 65, 1 << 19, 1 << 20
NONE = 1 << 62
_POSITION = 32
_SAFE_CUT = regex.compile(r"\S(?=\s)")


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only where pieces end anyway."""
    start = 0
    while len(text) - start > limit and (cut := _SAFE_CUT.search(text, start + limit - 1)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


class PairTree:
    """Minimum of ``rank << 32 | position`` over the live adjacent pairs of one piece."""

    __slots__ = ("nodes", "size")

    def __init__(self, keys: Iterable[int]):
        keys = np.asarray(keys, np.int64)
        self.size = size = 1 << (len(keys) - 1).bit_length()
        nodes = np.full(2 * size, NONE, np.int64)
        nodes[size : size + len(keys)] = keys
        while size > 1:
            nodes[size // 2 : size] = nodes[size : 2 * size].reshape(-1, 2).min(1)
            size //= 2
        self.nodes = array("q", nodes.tobytes())

    def set(self, position: int, key: int) -> None:
        nodes = self.nodes
        i = position + self.size
        nodes[i] = key
        while i > 1:
            other = nodes[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if nodes[i] == key:
                return  # nothing changes further up
            nodes[i] = key

    def root(self) -> int:
        return self.nodes[1]


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.table = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)], pa.large_binary())
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocabulary[c]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] << _POSITION | vocabulary[b] for a, b in pairs], np.int64)
        #: Token of each rank; pairs sorted, with their ranks in that order.
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.ranks = np.argsort(keys, kind="stable")
        self.pairs = keys[self.ranks]
        self.pieces = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        #: Packed ids by piece, in the order in which pieces were met.
        self.cache: dict[str, bytes] = {}

    def keys_of(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaves: ``rank << 32 | position`` of pairs that can merge, otherwise NONE (so for ids below 0)."""
        wanted = left.astype(np.int64) << _POSITION | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at] << _POSITION | position, NONE)

    def merge_rows(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``leaves`` + 1 bytes, each a row with a tree of ``leaves`` leaves (a power of two)."""
        rows, width = len(pieces), leaves + 1
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        columns = np.arange(width)
        ids = np.full((rows, width + 1), -1, np.int32)  # the last column stays -1: no neighbour
        ids[:, :width][columns < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.minimum(columns + 1, width).astype(np.int16), (rows, 1))
        before = np.tile((columns - 1).astype(np.int16), (rows, 1))
        trees = np.empty((rows, 2 * leaves), np.int64)
        trees[:, leaves:] = self.keys_of(ids[:, :leaves], ids[:, 1 : leaves + 1], columns[:leaves])
        level = leaves
        while level > 1:
            np.minimum(trees[:, level : 2 * level : 2], trees[:, level + 1 : 2 * level : 2], out=trees[:, level // 2 : level])
            level //= 2
        flat, tokens = trees.reshape(-1), ids.reshape(-1)
        following, preceding = after.reshape(-1), before.reshape(-1)
        live = np.arange(rows)
        while len(live := live[(least := flat[live * (2 * leaves) + 1]) < NONE]):
            least = least[least < NONE]
            i = least & 0xFFFFFFFF
            at, near, tree = live * (width + 1), live * width, live * (2 * leaves)
            j = following[near + i].astype(np.int64)
            k = following[near + j].astype(np.int64)
            h = preceding[near + i].astype(np.int64)
            merged = self.merged[least >> _POSITION]
            tokens[at + i] = merged
            tokens[at + j] = -1
            following[near + i] = k
            more = k < width
            preceding[(near + k)[more]] = i[more]
            first = h < 0
            h[first] = 0
            spot = np.stack([np.where(j < leaves, j, i), np.where(i < leaves, i, 0), h])
            value = np.stack([np.full(len(live), NONE), self.keys_of(merged, tokens[at + k], i), self.keys_of(np.where(first, -1, tokens[at + h]), merged, h)])
            # the pair before the first is none: its leaf is left as it is by writing it first
            flat[(tree + leaves + spot[2])[~first]] = value[2][~first]
            flat[tree + leaves + spot[0]] = value[0]
            flat[tree + leaves + spot[1]] = value[1]
            node = (spot + leaves) >> 1
            for _ in range(leaves.bit_length() - 1):
                child = tree + 2 * node
                flat[tree + node] = np.minimum(flat[child], flat[child + 1])
                node >>= 1
        alive = ids >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        packed = ids[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """Packed ids of one piece of two bytes or more."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        tree = PairTree(self.keys_of(ids[:-1], ids[1:], np.arange(n - 1)))
        nodes, put, size = tree.nodes, tree.set, tree.size
        ids, after, before = array("i", ids.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        known = self.rank_of
        while (least := nodes[1]) < NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            merged = ids[i] = int(self.merged[least >> _POSITION])
            ids[j] = -1
            after[i] = k = after[j]
            if j < n - 1 and nodes[j + size] < NONE:
                put(j, NONE)
            if k < n:
                before[k] = i
            put(i, NONE if k == n or (x := known(merged, ids[k])) is None else x << _POSITION | i)
            if (h := before[i]) >= 0:
                key = NONE if (x := known(ids[h], merged)) is None else x << _POSITION | h
                if nodes[h + size] != key:
                    put(h, key)
        ids = np.frombuffer(ids, np.int32)
        return ids[ids >= 0].astype("<u4").tobytes()

    def rank_of(self, left: int, right: int) -> int | None:
        if not hasattr(self, "_rank"):
            self._rank = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
        return self._rank.get(left << _POSITION | right)

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of all these distinct pieces, by rows of one matrix for each power of two of pairs."""
        raw = {piece: piece.encode() for piece in pieces}
        by_leaves: dict[int, list[str]] = {}
        out = {}
        for piece, data in raw.items():
            n = len(data)
            if n == 1:
                out[piece] = int(self.byte_id[data[0]]).to_bytes(4, "little")
            elif n > ROW_BYTES:
                out[piece] = self.merge_long(data)
            else:
                by_leaves.setdefault(1 << (n - 2).bit_length(), []).append(piece)
        for leaves, group in by_leaves.items():
            step = MATRIX // leaves
            for k in range(0, len(group), step):
                part = group[k : k + step]
                out.update(zip(part, self.merge_rows([raw[p] for p in part], leaves), strict=True))
        return out

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of texts without added tokens."""
        cut = [self.pieces(text) for text in texts]
        cache = self.cache
        new = set().union(*cut).difference(cache)
        if new:
            if len(cache) + len(new) > CACHE_PIECES:
                self.forget()
                new = set().union(*cut).difference(cache)
            learned = self.learn(new)
            long = [p for p in learned if len(p) > 64]
            cache.update(learned)
            packed = [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]
            for p in long:
                del cache[p]
            return packed
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]

    def forget(self) -> None:
        """Keeps the pieces met first."""
        hot = [*zip(range(HOT_PIECES), self.cache.items())]  # noqa: B905
        self.cache.clear()
        self.cache.update(x for _, x in hot)

    def encode_stream(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes]]]:
        """Lists of (index of a text, packed ids of its next part), about ``CHUNK_CHARS`` characters a list."""
        waiting: list[tuple[int, str | int]] = []
        held = 0
        for r, text in enumerate(texts):
            if not text:
                continue
            marked = self.split is not None and any(token in text for token in self.added)
            for p, part in enumerate(self.split(text) if marked else [text]):
                for chunk in [self.added[part]] if p % 2 else chunks(part):
                    waiting.append((r, chunk))
                    held += 1 if p % 2 else len(chunk)
                    if held >= CHUNK_CHARS:
                        yield self._encoded(waiting)
                        waiting, held = [], 0
        if waiting:
            yield self._encoded(waiting)

    def _encoded(self, parts: list[tuple[int, str | int]]) -> list[tuple[int, bytes]]:
        texts = iter(self.encode_chunks([x for _, x in parts if isinstance(x, str)]))
        return [(r, next(texts) if isinstance(x, str) else x.to_bytes(4, "little")) for r, x in parts]

    def bytes_of(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that lists of packed ids stand for."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        tokens = self.table.take(pa.array(ids.astype(np.int32)))
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)
        data = (tokens.buffers()[2] or b"") and tokens.buffers()[2].to_pybytes()
        ends = offsets[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(ids for part in self.encode_stream([text]) for _, ids in part), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of([np.array(ids, "<u4").tobytes()])[0].decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One vocabulary per worker and path; executors read it from their own installation."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the token ids and the text decoded from them (replacing columns of those names)."""
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = schema_plus(docs.select(*names), f"`{ids_col}` array<bigint>, `{decoded_col}` string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in bw.slices(batch, text_col):
                packed: list[list[bytes]] = [[] for _ in range(part.num_rows)]
                for some in bpe.encode_stream(part.column(text_col).to_pylist()):
                    for r, ids in some:
                        packed[r].append(ids)
                whole = [b"".join(x) for x in packed]
                ends = np.cumsum([0, *(len(x) // 4 for x in whole)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(whole), "<u4").astype(np.int64)))
                decoded = [x.decode("utf-8", "replace") for x in bpe.bytes_of(whole)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids, pa.array(decoded, pa.string())], [*names, ids_col, decoded_col])
        bpe.forget()

    small_batches(docs.sparkSession)
    return docs.select(*names).mapInArrow(scan, schema)


class _Digest:
    """Token count and both digests of a text that comes in parts."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.reader = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, packed: bytes, data: bytes) -> None:
        self.n += len(packed) // 4
        self.ids.update(packed)
        self.text.update(self.reader.decode(data).encode())

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.reader.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """The registered query: doc_id, n_tokens, ids_sha256, decoded_sha256.

    As ``encode_decode``, but the ids leave the Python workers only as digests.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = [_Digest() for _ in range(batch.num_rows)]
            for some in bpe.encode_stream(x.as_py() for x in batch.column("text")):
                for (r, packed), data in zip(some, bpe.bytes_of([x for _, x in some]), strict=True):
                    rows[r].add(packed, data)
            n, ids, decoded = zip(*(r.done() for r in rows), strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, schema)
