"""Importance resampling, prefix trie and vector search beside brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import importance, prefix_trie, queries, vector_search

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_prefix_trie", "op13_vector_search"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    assert df.columns == rel.columns and rows_of(df) == sorted(rel.fetchall(), key=repr)


# -- importance resampling -------------------------------------------------------------


def bag(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return w, [*w, *map(" ".join, zip(w, w[1:], strict=False))]


def brute_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    source, aim = defaultdict(int), defaultdict(int)
    for texts, counts in ((docs.values() if isinstance(docs, dict) else [t for _, t in docs], source), (target, aim)):
        for t in texts:
            for f in bag(t)[1]:
                counts[bucket(f)] += 1
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = cache(lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))))
    out = []
    for i, text in docs:
        w, fs = bag(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = defaultdict(list)
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        ranks[tuple(r)].append(place)
    return sorted(((r[0], *r[2:], ranks[tuple(r)].pop(0) if ranks[tuple(r)] else None) for r in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=6))
def test_crcs_of_words_and_pairs(words):
    words = [w.replace(b" ", b"x") for w in words]
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    one, two = importance.word_crcs(data, np.array([len(w) for w in words]))
    assert one.tolist() == [zlib.crc32(w) for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def test_crcs_of_long_spans():
    data = np.random.default_rng(1).integers(0, 256, 100_000, np.uint8).astype(np.uint8)
    start, end = np.array([0, 5, 77, 1000]), np.array([100_000, 6, 77 + 64, 1000 + 64 * 33 + 1])
    assert importance.folded(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_texts_go_part_by_part(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "Ab" + " " * 40 + "ab é", "x" * 90, "...", *("".join(rng.choice("aB é1.\n") for _ in range(rng.randint(0, 200))) for _ in range(30))]
    for size in (1, 7, 33, 1 << 18):
        monkeypatch.setattr(importance, "PART_BYTES", size)
        n, found = np.zeros(len(texts), int), defaultdict(list)
        for text, owner, bucket in importance.features(pa.array(texts)):
            n += np.bincount(text, minlength=len(texts))
            for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                found[i].append(b)
        assert n.tolist() == [len(bag(t)[0]) for t in texts]
        assert all(sorted(found[i]) == sorted(zlib.crc32(f.encode()) % 10000 for f in bag(t)[1]) for i, t in enumerate(texts))


def odd_texts():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeÉñ7") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)).title()) for i in range(80)]
    rows += [(80, None), (81, ""), (82, " .,\n"), (83, "w" * 70_000 + " tail " * 30), (None, text(40)), (None, None), (5, rows[5][1]), (5, text(50)), (-3, text(30)), (84, "日本語 " * 25)]
    return rows, [text(12), text(3), None, "", "one"]


def test_resampling_of_odd_documents(spark):
    rows, target = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, score string, bucket int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(importance.resample_digest(docs, aim)) == brute_resample(rows, target)
    none = docs.filter("false")
    assert importance.resample_digest(none, aim).count() == 0
    assert rows_of(importance.resample_digest(docs, aim.filter("false"))) == brute_resample(rows, [])


def test_ranks_over_many_ranges(spark):
    rows = [(i % 700, i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = [tuple(r) for r in importance.ranked(df, F.desc("b"), F.asc("a")).orderBy("rank").collect()]
    assert [(a, b) for a, b, _ in got] == sorted(rows, key=lambda r: (-r[1], r[0])) and [r for *_, r in got] == list(range(1, 3001))


# -- prefix trie ------------------------------------------------------------------------


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    base = lambda c: c - int(math.fmod(c, 20))
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        convs[c] = tuple(own.get(base(c), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * words
    ends = lambda path, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if convs[c] == path))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items()), key=repr)


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = rng.choice([c, c, c, 1000 + c, -c])
        length = rng.choice([1, 2, 3, 5, 30])
        common = rng.randint(0, length)
        for turn in range(length):
            text = f"common turn {turn} of many" if turn < common else f"own words {rng.randint(0, 3)} " * rng.randint(0, 4)
            rows.append((c, rng.choice([turn, turn, None if turn == 0 else turn]), rng.choice(["user", None if turn % 2 else "user"]), rng.choice([text, text, text, None])))
    return [*rows, (None, 1, "user", "no id"), (7, 0, "user", "tie"), (7, 0, "user", "tied"), (40, 0, "", ""), (40, 1, None, None)]


@pytest.mark.parametrize(("shard", "turns"), [(1, 9), (2, 1 << 16), (5, 40), (4096, 1 << 16)])
def test_trie_of_odd_conversations(spark, monkeypatch, shard, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = talk(shard, 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    assert rows_of(prefix_trie.prefix_trie_digest(df)) == brute_trie(rows)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turns_of(df))) == brute_trie(rows, rebuild=False)


def test_trie_of_copies_and_of_nothing(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(4)]
    df = spark.createDataFrame(copies, "conv_id bigint, turn bigint, role string, text string")
    assert rows_of(prefix_trie.prefix_trie_digest(df)) == brute_trie(copies)
    assert prefix_trie.prefix_trie_digest(df.filter("false")).count() == 0
    long = [(c, t, "user", f"{t if t < 900 else (c, t)}") for c in (20, 40) for t in range(1000)]
    assert rows_of(prefix_trie.prefix_trie_digest(spark.createDataFrame(long, df.schema))) == brute_trie(long)


def test_shards_shuffle_with_the_package(spark):
    """Shards far below the number of conversations: open nodes are merged over them."""
    rows = [(c, t, "user", f"{t} {c % 7 if t > 1 else 0} {c % 50 if t > 3 else 0}") for c in range(0, 12_000, 20) for t in range(6)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert rows_of(prefix_trie.prefix_trie(turns)) == brute_trie(rows, rebuild=False)


# -- vector search -------------------------------------------------------------------------


def brute_nearest(rows, k=10):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 100 == 0:
            near = []
            for m, (j, v) in enumerate(good):
                if m != n and len(v) == len(q):
                    total = 0.0
                    for a, b in zip(q, v, strict=True):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), j))
            out += [(i, r, j, d) for r, (d, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=repr)


def odd_vectors(kind=np.float64):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (60, 5)) for c in rng.normal(0, 3, (5, 5))]).astype(kind).astype(float)
    grid = [[float(a), float(b), 0.0] for a in range(6) for b in range(6)]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(400 + i, v) for i, v in enumerate(grid)]
    rows += [(500 + i, [1.0, 2.0, -0.0]) for i in range(60)] + [(600 + 100 * i, [1.0, 2.0, 0.0]) for i in range(5)]  # one vector of many rows
    rows += [(None, [1.0, 2.0, 0.0]), (1100, None), (1200, []), (1300, [0.0, 0.0, 0.0]), (1400, [1.0, None, 2.0]), (1500, [1.0, float("nan"), 2.0]), (1600, [float("inf"), 0.0, 0.0]), (1700, [3.0]), (1800, [4.0]), (1900, [1.0] * 7)]
    return [*rows, (100, rows[100][1]), (100, rows[100][1]), (200, [0.5, 0.5, 0.0])]


@pytest.mark.parametrize("size", [3, 40, 8192])
def test_search_of_odd_vectors(spark, monkeypatch, size):
    for name, value in (("SHARD_ROWS", size), ("LEAF_ROWS", min(size, 16)), ("FIT_LEAF", 4), ("BLOCK_QUERIES", size), ("FIT_VECTORS", 10 * size)):
        monkeypatch.setattr(vector_search, name, value)
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 0.0, "k") for i, v in rows], "vec_id bigint, embedding array<double>, score double, key string").repartition(4)
    assert rows_of(vector_search.vector_search_digest(df)) == brute_nearest(rows)


def test_search_of_single_floats_and_of_nothing(spark):
    rows = [(i, np.array(v, np.float32).astype(float).tolist() if v and None not in v else v) for i, v in odd_vectors(np.float32)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert rows_of(vector_search.vector_search_digest(df)) == brute_nearest(rows)
    assert vector_search.vector_search_digest(df.filter("false")).count() == 0


def test_factor_trades_recall_for_leaves(spark):
    """Factor 1 is exact; a larger one leaves out more leaves, and what it finds has true distances."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (400, 8)) for c in rng.normal(0, 2, (6, 8))])
    shard, q = vector_search.Shard(x, np.arange(len(x))), x[::50] + 0.01
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    want, limit, recall, kept = np.argsort(true, 1)[:, :10], np.full(len(q), np.inf), [], []
    for factor in (1.0, 2.0, 8.0):
        best, score = shard.nearest(q, limit, 10, factor)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), want.tolist(), strict=True)]))
        kept.append((~vector_search._out(shard.tree.bounds(q), np.sort(true, 1)[:, 9:10], factor)).mean())
        assert np.allclose(score, np.take_along_axis(true, best, 1))
    assert recall[0] == 1.0 >= recall[1] >= recall[2] and kept[0] > kept[1] > kept[2] and kept[0] < 0.6


# -- near duplicates made from a template ------------------------------------------------------


def template(n, exchanged, seed=1, length=200):
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(length)], []
    for i in range(n):
        words = list(base)
        for p in rng.sample(range(length), exchanged):
            words[p] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    return rows


def brute_components(rows, size=4, percent=80):
    sets = [frozenset(" ".join(w[p : p + size]) for p in range(len(w) - size + 1)) for w in (t.split() for _, t in rows)]
    lead = list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    return {i: rows[top(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize(("n", "exchanged", "block"), [(300, 3, 512), (120, 4, 16)])
def test_documents_of_a_template(spark, monkeypatch, n, exchanged, block):
    """Nearest partners join what a template makes; few rows are left to meet by shingles, and no link is lost."""
    from chronoloom.llm import near_dedup

    dealt, real = [], near_dedup._in_blocks
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda members, percent: (dealt.append(members.count()), real(members, percent))[1])
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SMALL", 8 if block < 512 else 64)
    rows = template(n, exchanged)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup_digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_components(rows)
    if block == 512:
        assert sum(dealt) <= 20 * n
