"""The text operators beside brute force, on small made-up documents and on the smallest tables."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import bpe, bytewise, decontaminate, language_id, line_dedup, lm_score, near_dedup, quality_classifier, quality_rules, queries, sentence_dedup, warc_revisits

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def made_up(seed=0):
    """Documents with copies, near copies, shared lines and passages, odd texts, nulls and repeated ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + rng.choice(".!?")
    text = lambda n: "\n".join(" ".join(sentence(rng.randint(4, 12)) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage, line = " ".join(sentence(9) for _ in range(6)), "This Line Is In Many Documents, word for word."
    texts = [text(rng.randint(2, 6)) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[4].upper()]
    for _ in range(6):
        w = texts[7].split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [t + "\n" + line + "\n" + "  " + line.lower() + "\t" for t in texts[10:15]]
    texts += [f"{texts[i]} {passage} {sentence(5)}" for i in range(16, 20)]
    texts += ["", None, " \n\t ", "one two three", "one two three", "Solo", "日本語 テスト 😀 " * 30, "a " * 3000, "word " * 60, "\n" * 50, "x" * 5000]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None), (None, None, None, None, None), (5, texts[5], "en", "s", 1), (5, "another text under a taken id, long enough", "en", "s", 1)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_up(), SCHEMA).repartition(3).cache()


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


# -- bytes ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_and_lines_of_any_text(texts):
    import pyarrow as pa

    data, offsets = bytewise.text_bytes(pa.array(texts, pa.string()))
    start, end, first = bytewise.word_ranges(data, offsets, bytewise.NOT_SPACE)
    raw = data.tobytes()
    got = [[raw[start[j] : end[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    start, end, first = bytewise.line_ranges(data, offsets)
    got = [[raw[start[j] : end[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").split("\n") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_are():
    import pyarrow as pa

    data, offsets = bytewise.text_bytes(pa.array(["Ab cd ab", "xx AB é é", "ba"]))
    start, end, _ = bytewise.word_ranges(data, offsets, bytewise.NOT_SPACE)
    h = bytewise.RangeHash(data, bytewise.byte_table(1, True)).of(start, end).tolist()
    assert h[0] == h[2] == h[4] and h[5] == h[6] and len(set(h)) == 5


def test_long_data_is_hashed_part_by_part(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab \n é"), int(n))) for n in (0, 5, 3000, 1, 700)] + ["x" * 2500, "y  z"]
    data, offsets = bytewise.text_bytes(pa.array(texts))
    start, end, first = bytewise.word_ranges(data, offsets, bytewise.NOT_SPACE)
    lines = bytewise.line_ranges(data, offsets)
    whole = bytewise.RangeHash(data, bytewise.byte_table(3, True)).of(start, end)
    stripped = bytewise.strip_ranges(data, offsets, *lines[:2])
    raw = data.tobytes()
    assert [raw[a:b].strip(b" \t\n\v\f\r") for a, b in zip(*lines[:2], strict=True)] == [raw[a:b] for a, b in zip(*stripped, strict=True)]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(bytewise, "SLICE_BYTES", size)
        assert (bytewise.RangeHash(data, bytewise.byte_table(3, True)).of(start, end) == whole).all()


_SOME = random.Random(11)
LONG = "\n".join(f"Line {i} {' '.join('w' + format(_SOME.randrange(4000), 'x') for _ in range(9))} ends." for i in range(28_000))


def test_very_long_texts(spark, tmp_path):
    """A text of 2 MB, which is several slices, goes whole through operators and stages, beside its near copy."""
    import corpus_pipeline as cp

    near = LONG.replace("Line 77 ", "Row 77 ")
    rows = [(1, LONG, "en", "s", len(LONG)), (2, near, "en", "s", len(near)), (3, "Short text. " * 12, "en", "s", 144)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup_digest(docs).collect()}
    assert lines == {1: (28_000, 0), 2: (28_000, 0), 3: (1, 0)}
    assert sorted(map(tuple, near_dedup.near_dedup_digest(docs).collect())) == [(r[0], len(shingle_set(r[1], 4)), 1 if r[0] < 3 else 3, r[0] != 2) for r in rows]
    cut = {r["doc_id"]: r for r in sentence_dedup.dedup_sentences(docs, go_on=True).collect()}
    assert cut[1]["text"] == LONG and cut[2]["n_sentences"] == 28_000 and cut[2]["n_removed"] == 27_999
    counts = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.quality_rules_digest(docs, labels_of(docs)).collect()}
    assert counts[1] == brute_counts(LONG)
    scores = {r["doc_id"]: r["n_tokens"] for r in lm_score.lm_score_digest(docs, labels_of(docs)).collect()}
    assert scores == {i: len(words(t)) for i, t, *_ in rows}
    items = spark.createDataFrame([("a", LONG[1_000_000:1_000_300])], "item_id string, text string")
    dirty = {r["doc_id"]: (r["n_words"], r["n_items"]) for r in decontaminate.contamination_digest(docs, items).collect()}
    assert dirty[1][1] == dirty[2][1] == 1 and dirty[3][1] == 0 and dirty[1][0] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LONG.lower()))
    assert language_id.language_digest(docs, queries.pieces()).filter("lang_pred = 'en'").count() == 3
    sizes = {r["doc_id"]: r["decoded_sha256"] for r in bpe.bpe_digest(docs, queries.byte_bpe()).collect()}
    assert sizes == {i: sha(t) for i, t, *_ in rows}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(docs).withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()] == [1]


# -- 7: lines ------------------------------------------------------------------------


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key_of(line)) >= 20:
                    holders[key_of(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key_of(x)]) < 3 or max(holders[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_line_dedup(spark, docs):
    got = sorted(map(tuple, line_dedup.line_dedup_digest(docs).collect()), key=str)
    assert got == brute_lines(made_up())
    assert line_dedup.line_dedup_digest(empty(spark)).count() == 0


def test_line_filters_act_at_every_size(spark, docs, monkeypatch):
    """Filters too large to be sent out are probed where their shard is, hot shards in several tasks."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    for rows in (1, 1 << 22):
        monkeypatch.setattr(line_dedup, "PROBE_ROWS", rows)
        assert sorted(map(tuple, line_dedup.line_dedup_digest(docs).collect()), key=str) == brute_lines(made_up())
        inner = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
        index = line_dedup.LineIndex.build(inner)
        every, maybe = line_dedup.line_keys(inner), index._probe_in_shards(line_dedup.line_keys(inner))
        shared = {(r["k1"], r["k2"]) for r in index.shared.collect()}
        hit, all_ = sorted(map(tuple, maybe.collect())), sorted(map(tuple, every.collect()))
        assert len(hit) < len(all_) and [k for k in all_ if k[1:] in shared] == [k for k in hit if k[1:] in shared]
    assert line_dedup.line_dedup_digest(empty(spark)).count() == 0


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "t", 7, "a" * 30, "x")], "doc_id bigint, __drop string, k1 int, text string, id string").withColumn("n_lines", F.lit(99))
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "__drop", "k1", "text", "id", "n_lines", "n_dropped"]
    assert tuple(got.first()) == (1, "t", 7, "a" * 30, "x", 1, 0)


def test_line_index_is_reversible(spark, docs):
    inner = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    new = spark.createDataFrame([(900 + i, "A line that three new documents share, indeed.\nThis Line Is In Many Documents, word for word.") for i in range(3)], "id bigint, text string")
    one = line_dedup.LineIndex.build(inner)
    two = one.insert(new)
    three = two.delete(new)
    of = lambda index: sorted(map(tuple, index.shared.collect()))
    assert of(one) == of(three) and len(of(two)) == len(of(one)) + 1
    rebuilt = line_dedup.LineIndex.build(inner.union(new))
    assert of(two) == of(rebuilt)
    for index in (two, three):
        held = {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()}
        keys = np.array([r["k1"] for r in index.shared.collect()], np.int64).view(np.uint64)
        assert line_dedup.probe_filters((index.n_shards, held), keys).all()
    assert sum((f.table != 0).sum() for f in held.values()) == len(keys)  # nothing is left behind


def test_cuckoo_filter_grows_and_forgets():
    keys = bytewise.mix(np.arange(1, 5001, dtype=np.uint64))
    f = line_dedup.CuckooFilter.build(keys)
    assert f.contains(keys).all()
    others = bytewise.mix(np.arange(10_000, 40_000, dtype=np.uint64))
    assert f.contains(others).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    twice = line_dedup.CuckooFilter.build(np.repeat(keys[:1], 40))  # more equal keys than two buckets hold
    assert twice.contains(keys[:1]).all()


# -- 2: near-duplicates ----------------------------------------------------------------


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t, *_ in rows]
    comp = {i: i for i, _ in sets if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (a, s), (b, t) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    got = near_dedup.near_duplicates(docs, size=k).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(made_up(), k)
    gone = near_dedup.keep_one(docs, size=k)
    assert gone.columns == docs.columns
    assert gone.count() == sum(kept for *_, kept in brute_near(made_up(), k))


def test_near_duplicates_in_a_family(spark):
    """A base and many edits of it: some reach the base only through others."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, near_dedup.near_duplicates(df, size=4).collect()), key=str) == brute_near(rows, 4)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1, 64])
def test_near_duplicates_of_a_template(spark, monkeypatch, most):
    """Texts of one template, similar to all others but linked with few, by pairs and in blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", most)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(90):
        own = [f"o{rng.randrange(40)}" for _ in range(rng.randint(8, 30))]
        at = rng.randrange(120)
        w = base[:at] + own + base[at:]
        rows.append((2 * i, " ".join(w), None, None, None))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
            rows.append((2 * i + 1, " ".join(w), None, None, None))
    rows += [(500, rows[4][1], None, None, None), (4, rows[9][1], None, None, None)]
    want = brute_near(rows, 4)
    assert 20 < len({c for _, _, c, _ in want}) < len(want)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("comp", F.lit("x")).withColumn("bucket", F.lit(1))
    assert sorted(map(tuple, near_dedup.near_duplicates(df, size=4).collect()), key=str) == want


def test_rare_shingles_meet_all_that_are_similar(spark, docs):
    inner = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), "text")
    met = defaultdict(set)
    for r in near_dedup.rare_shingles(inner, 5, 80).collect():
        met[r["id"]].add(r["bucket"])
    rows = [(i, shingle_set(t, 5)) for i, t, *_ in made_up() if i is not None]
    level = {r["id"]: r["level"] for r in near_dedup.rare_shingles(inner, 5, 80).dropDuplicates(["id"]).collect()}
    similar = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    assert similar and all(met[a] & met[b] and abs(level[a] - level[b]) <= 1 for a, b in similar)
    assert sum(map(len, met.values())) < 0.5 * sum(len(x) for _, x in rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        n = 2000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2)]
        true = len(common) / (2 * n - len(common))
        mins = near_dedup.minima(np.concatenate(sets), np.array([0, n, 2 * n]), near_dedup.FINE, 5000)
        a, b = near_dedup.pack(mins, near_dedup.FINE_BITS).view(np.uint64)
        assert abs(near_dedup.estimate(a, b, near_dedup.FINE_BITS) - true) < 0.05


# -- 3: benchmark passages ---------------------------------------------------------------


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_contamination(rows, items, window=10):
    phrases = defaultdict(set)
    for item, t in items:
        w = alnum(t)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases[tuple(w[i : i + window])].add(str(item))
    out = []
    for i, t, *_ in rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def items_of(rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(t.split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(texts, (14, 25, 10, 9, 3, 1, 30, 12), strict=False))]
    return items + [(50, None), (51, "..."), (None, "one two three"), (52, "one two three"), (52, "Solo"), (53, items[0][1]), (60, "no such words anywhere at all")]


def test_contamination(spark, docs):
    items = items_of(made_up())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination(made_up(), items)
    got = decontaminate.contamination_digest(docs, bench)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[-1] for r in want) > 5
    for a, b in ((docs, empty(spark, "item_id bigint, text string")), (empty(spark), bench)):
        assert decontaminate.contamination_digest(a, b).filter("contaminated").count() == 0


def test_contamination_in_blocks(spark, docs, monkeypatch):
    items = items_of(made_up())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    real = decontaminate.benchmark_blocks
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda b: real(b, 60))
    got = decontaminate.contamination_digest(docs, bench)
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(made_up(), items)


def test_removed_spans_are_gone(spark, docs):
    items = items_of(made_up())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cut = decontaminate.decontaminate(docs.withColumn("hit", F.lit("mine")), bench)
    assert cut.columns == [*docs.columns, "hit"] and cut.count() == docs.count()
    clean = {r[0] for r in brute_contamination(made_up(), items) if not r[-1]}
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in clean)
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect() if r["doc_id"] in clean) == before
    assert decontaminate.remove_spans("Aa bb, cc dd.", [(1, 3)]) == "Aa  dd."


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_fm_index_finds_all(text, phrase):
    text = np.array([*text, 0])
    index = decontaminate.FmIndex(text, 4)
    low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
    rows, _ = decontaminate._expand(low, high)
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]
    assert sorted(index.locate(rows).tolist()) == want


# -- 4: sentences ----------------------------------------------------------------------


def brute_sentences(rows, size, least):
    def split(t):
        out = []
        for line in (t or "").split("\n"):
            now = []
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                now.append(w.translate(ASCII_LOWER))
                if w[-1] in ".!?":
                    out.append(now)
                    now = []
            if now:
                out.append(now)
        return out

    texts = [(i, split(t)) for i, t, *_ in rows]
    run = lambda s, k: tuple(itertools.chain(*s[k : k + size]))
    first = {}
    for i, s in texts:
        if i is not None:
            for k in range(len(s) - size + 1):
                first[run(s, k)] = min(first.get(run(s, k), math.inf), i)
    out = []
    for i, s in texts:
        gone, seen = set(), set()
        for k in range(len(s) - size + 1):
            r = run(s, k)
            if i is not None and len(r) >= least and (r in seen or first[r] < i):
                gone.update(range(k, k + size))
            seen.add(r)
        out.append((i, len(s), len(gone), sum(len(s[k]) for k in gone)))
    return sorted(out, key=str)


def test_sentence_spans(spark, docs):
    got = sentence_dedup.sentence_dedup_digest(docs).select("doc_id", "n_sentences", "n_removed", "words_removed")
    want = brute_sentences(made_up(), sentence_dedup.SIZE, sentence_dedup.MIN_WORDS)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(n > 0 for _, _, n, _ in want) > 8
    three = sentence_dedup.dedup_sentences(docs, size=3).select("doc_id", "n_sentences", "n_removed", "words_removed")
    assert sorted(map(tuple, three.collect()), key=str) == brute_sentences(made_up(), 3, sentence_dedup.MIN_WORDS)
    assert sentence_dedup.sentence_dedup_digest(empty(spark)).count() == 0


def test_short_sentences_are_repeats_too(spark, tmp_path):
    """A passage of 60 words in sentences of four, whole in its first document only; short phrases stay."""
    rng = random.Random(5)
    passage = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(4)) + "." for _ in range(15)]
    rows = [(i, "\n".join([f"Opening line of number {i} goes here for once.", *passage, f"Closing line of number {i} goes here for once."])) for i in (1, 2)]
    rows += [(3, "Yes. No. All other words of this are here for the first time."), (4, "Something else is said with words of its own here. Yes. No.")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r["doc_id"]: (r["n_removed"], r["words_removed"]) for r in queries.op4_sentence_dedup(spark, str(tmp_path)).collect()}
    got = {r["doc_id"]: r for r in sentence_dedup.dedup_sentences(table, go_on=True).collect()}
    assert query == {i: (r["n_removed"], r["words_removed"]) for i, r in got.items()} == {1: (0, 0), 2: (15, 60), 3: (0, 0), 4: (0, 0)}
    assert got[2]["text"] == "Opening line of number 2 goes here for once.\nClosing line of number 2 goes here for once."


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), max_size=12), max_size=4), st.integers(1, 3), st.integers(0, 14))
def test_runs_go_on_until_they_have_the_words(lengths, size, least):
    texts = [" ".join(" ".join(["a"] * (n - 1) + ["b."]) for n in t) for t in lengths]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    text, place, span, *_ = sentence_dedup._runs(data, np.cumsum([0, *map(len, texts)]), size, least, True)
    want = set()
    for i, t in enumerate(lengths):
        ok = {(a, b) for a in range(len(t)) for b in range(a + size, len(t) + 1) if sum(t[a:b]) >= least}
        want |= {(i, a, b - a) for a, b in ok if (a, b - 1) not in ok or (a + 1, b) not in ok}
    assert sorted(zip(text.tolist(), place.tolist(), span.tolist(), strict=True)) == sorted(want)


def test_sentences_leave_the_rest_of_a_text(spark):
    text = "First one here is long enough. " + "Shared words are here now again. And some more of them follow. " + "Last of b."
    rows = [(1, "Shared words are here now again. And some more of them follow.", "x"), (2, text, "y")]
    got = sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id bigint, text string, places string"))
    assert {r["doc_id"]: (r["text"], r["places"]) for r in got.collect()} == {1: (rows[0][1], "x"), 2: ("First one here is long enough. Last of b.", "y")}


# -- 6: quality rules --------------------------------------------------------------------


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, hit = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            hit.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def labels_of(docs):
    return docs.filter("doc_id is not null").select("doc_id").distinct().withColumn("quality", (F.col("doc_id") % 5 != 0).cast("int")).withColumn("toxic", F.lit(0))


def test_quality_rules(spark, docs):
    got = quality_rules.quality_rules_digest(docs, labels_of(docs)).collect()
    want = []
    for i, t, *_ in made_up():
        n, chars, symbols, dup, repeat = brute_counts(t)
        want.append((i, n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(not r["kept"] for r in got if r["base_failed"])
    none = quality_rules.quality_rules_digest(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.filter("kept = base_failed").count() == 0  # nothing is learned, so only the base rule speaks
    assert quality_rules.quality_rules_digest(empty(spark), labels_of(docs)).count() == 0
    kept = quality_rules.keep_good(docs.withColumn("score", F.lit(1)), labels_of(docs))
    assert kept.columns == [*docs.columns, "score"] and kept.count() == sum(r["kept"] for r in got)


def test_quality_verdicts_by_brute_force(spark):
    """Every path walked by a plain loop, every threshold tried, labels repeated and in any order."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    twice = labels.unionByName(labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("quality")).cast(labels.schema["quality"].dataType)))
    forest = quality_rules.fit_forest(docs.select(F.col("doc_id").alias("id"), "text"))
    batch = pa.RecordBatch.from_pandas(docs.toPandas())
    counts, x = quality_rules.statistics(batch)
    failed, x = quality_rules.base_failed(counts), x[:, quality_rules.RULE_FEATURES]

    def path(row, at):
        while forest.feature[at] >= 0:
            at = forest.child[at][int(row[forest.feature[at]] > forest.split[at])]
        return forest.length[at]

    score = [2 ** (-sum(path(row, r) for r in forest.roots) / len(forest.roots) / float(forest.expected_path(forest.rows))) for row in x]
    quality = dict(labels.filter("quality is not null").select("doc_id", "quality").collect())
    live = [(int(s * quality_rules.BINS), quality[i] > 0) for i, f, s in zip(batch["doc_id"].to_pylist(), failed, score, strict=True) if not f and i in quality]
    best = None
    for t in range(quality_rules.BINS + 1):
        good, bad = sum(g and b >= t for b, g in live), sum(not g and b >= t for b, g in live)
        if bad and 2 * good <= bad and good <= quality_rules.FALSE_REJECTS * sum(g for _, g in live):
            loss = sum(not g for _, g in live) - bad + quality_rules.GOOD_WEIGHT * good
            best = min(best or (math.inf, 0), (loss, -t))
    limit = -best[1] / quality_rules.BINS if best else math.inf
    want = {i: not f and s < limit for i, f, s in zip(batch["doc_id"].to_pylist(), failed, score, strict=True)}
    for given_labels in (labels, twice, twice.orderBy(F.desc("quality"))):
        got = quality_rules.quality_rules_digest(docs, given_labels).select("doc_id", "kept").collect()
        assert {r["doc_id"]: r["kept"] for r in got} == want
    assert 0 < sum(want.values()) < len(want)
    kept = quality_rules.keep_good(docs, twice).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(i for i, k in want.items() if k)


def test_isolation_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    forest = quality_rules.IsolationForest.fit(x)
    odd = forest.score(np.array([[8.0, -8, 8, -8]] * 3))
    assert odd.min() > np.quantile(forest.score(x), 0.995)
    assert np.allclose(forest.expected_path(np.array([1, 2, 256])), [0, 1, 10.24477], atol=0.01)


def test_threshold_takes_all_labels(spark, docs, monkeypatch):
    many = spark.range(250_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_rules.named_labels(many).count() == 250_000
    few = sorted(r[0] or -1 for r in quality_rules.keep_good(docs, labels_of(docs)).select("doc_id").collect())
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert sorted(r[0] or -1 for r in quality_rules.keep_good(docs, labels_of(docs)).select("doc_id").collect()) == few


def test_rules_keep_good_documents(spark, sf_dir):
    got = queries.op6_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = got.filter("quality = 1 and not base_failed")
    assert good.filter("not kept").count() <= 0.02 * good.count()


# -- 5: quality classifier ----------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97


def test_classifier_edges(spark, docs):
    labels = labels_of(docs).withColumn("quality", F.when(F.col("doc_id") % 7 != 0, F.col("quality")))
    got = quality_classifier.quality_classifier_digest(docs, labels.unionByName(labels))
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    none = quality_classifier.quality_classifier_digest(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.filter("score <> 1").count() == 0
    assert quality_classifier.quality_classifier_digest(empty(spark), labels).count() == 0


def test_classifier_query_by_brute_force(spark):
    """One solve over all fitted rows, means by trying every block, no partitions and no bins of rows."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier_digest(docs.withColumn("x", F.lit("mine")), labels).collect()}
    batch = pa.RecordBatch.from_pandas(docs.toPandas())
    ids, x = batch["doc_id"].to_pylist(), quality_classifier.statistics(batch)[1].astype(np.float32).astype(float)
    place = {i: k for k, i in enumerate(ids)}
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i in ids}
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in place}
    fit = [i for i in known if rest[i] in (1, 2, 3)]
    calibrate = [i for i in known if rest[i] == 4]
    rows = x[[place[i] for i in fit]]
    features = quality_classifier.RandomFeatures(rows.mean(0), np.maximum(rows.std(0), 1e-6))
    z, y = features(rows), np.array([known[i] for i in fit])
    weights = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    level = {i: math.floor(min(max(float(v), 0), 1) * quality_classifier.BINS + 1e-9) for i, v in zip(ids, features(x) @ weights, strict=True)}
    steps = sorted({level[i] for i in calibrate})
    sums = np.cumsum([0.0] + [sum(known[i] for i in calibrate if level[i] == s) for s in steps])
    counts = np.cumsum([0] + [sum(level[i] == s for i in calibrate) for s in steps])
    mean = lambda a, b: (sums[b] - sums[a]) / (counts[b] - counts[a])
    share = [max(min(mean(a, b) for b in range(k + 1, len(steps) + 1)) for a in range(k + 1)) for k in range(len(steps))]  # max-min formula of isotonic means
    far = 0
    for i in ids:
        k = np.searchsorted(steps, level[i], side="right") - 1
        want = share[max(k, 0)]
        far += abs(got[i]["score"] - want) > 1e-6
        assert got[i]["held_out"] == (rest[i] == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert far <= 0.005 * len(ids)  # values on the border of two of the 2,000 levels


def test_isotonic_is_monotone():
    steps, means = quality_classifier.isotonic(np.arange(6.0), np.array([0.0, 3, 1, 2, 0, 5]), np.full(6, 5.0))
    assert (np.diff(means) > 0).all() and means[0] == 0 and means[-1] == 1 and len(steps) == len(means)


def test_random_features_approximate_the_kernel():
    f = quality_classifier.RandomFeatures(np.zeros(3), np.ones(3), width=20_000, gamma=0.15)
    x = np.random.default_rng(0).normal(size=(6, 3))
    z = f(x)[:, :-1]
    want = np.exp(-0.15 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.03


# -- 1: language models --------------------------------------------------------------------


def test_lm_scores_equal_a_loop(spark, docs):
    """Cells are many enough to keep nearly all words apart, so hashed counts are near exact ones."""
    good = {i for i, *_ in made_up() if i is not None and i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in good], "id bigint")
    got = {r["id"]: r for r in lm_score.cross_entropy_difference(docs, ids).filter("id is not null and id <> 5").collect()}
    counts = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, t, *_ in made_up():
        w = words(t)
        for models in (0, 1) if i in good else (0,):
            for a, b in zip(["<s>", *w], w, strict=False):
                counts[models][0][b] += 1
                counts[models][1][a] += 1
                counts[models][2][a, b] += 1
    l1, l2, v = lm_score.L1, lm_score.L2, 1 << lm_score.UNIGRAM_BITS
    texts = {i: t for i, t, *_ in made_up() if i not in (None, 5)}
    for i, t in texts.items():
        w = words(t)
        loss = []
        for one, ahead, two in counts:
            total = max(sum(one.values()), 1)
            loss.append(np.mean([-math.log(l2 * two[a, b] / max(ahead[a], 1) + (1 - l2) * (l1 * one[b] / total + (1 - l1) / v)) for a, b in zip(["<s>", *w], w, strict=False)]) if w else None)
        assert got[i]["n_tokens"] == len(w)
        if w:
            assert got[i]["score"] == pytest.approx(loss[1] - loss[0], abs=1e-8) and got[i]["background_loss"] == pytest.approx(loss[0], abs=1e-8)
        else:
            assert got[i]["score"] == 0 and got[i]["target_loss"] is None
    assert lm_score.cross_entropy_difference(empty(spark), ids).count() == 0


def test_lm_counts_are_exact_and_grow(spark, monkeypatch):
    """More distinct words and bigrams than any fixed number of cells, in many blocks; V is what the documents hold."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50_000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(600_000)}" for _ in range(400)) + " The end the END", i % 3 == 0) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_score.lm_score_digest(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3), labels).collect()}
    counts = [[Counter(), Counter(), Counter()] for _ in range(2)]
    pairs = {i: list(zip(["<s>", *words(t)], words(t), strict=False)) for i, t, _ in rows}
    for i, _, good in rows:
        for one, ahead, two in counts[: 1 + good]:
            one.update(b for _, b in pairs[i])
            ahead.update(a for a, _ in pairs[i])
            two.update(pairs[i])
    l1, l2, v, totals = lm_score.L1, lm_score.L2, len(counts[0][0]), [c[0].total() for c in counts]
    assert v > 1 << 18
    for i, p in pairs.items():
        back, target = (np.mean([-math.log(l2 * two[x] / max(ahead[x[0]], 1) + (1 - l2) * (l1 * one[x[1]] / sum_ + (1 - l1) / v)) for x in p]) for (one, ahead, two), sum_ in zip(counts, totals, strict=True))
        assert got[i]["n_tokens"] == len(p)
        assert got[i]["background_loss"] == pytest.approx(back, abs=6e-7) and got[i]["target_loss"] == pytest.approx(target, abs=6e-7) and got[i]["score"] == pytest.approx(target - back, abs=6e-7)


def test_target_text_scores_lower(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_lm_score(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg("score").alias("s"))
    score = {r["quality"]: r["s"] for r in got.collect()}
    assert score[1] < score[0]


# -- 9: BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_bpe())


def test_bpe_query(spark, docs, tokenizer):
    want = []
    for i, t, *_ in made_up():
        e = tokenizer.encode(t or "", add_special_tokens=False)
        want.append((i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), sha(tokenizer.decode(e.ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.bpe_digest(docs, queries.byte_bpe()).collect()), key=str) == sorted(want, key=str)
    assert bpe.bpe_digest(empty(spark), queries.byte_bpe()).count() == 0
    full = bpe.encode_decode(docs.withColumn("ids", F.lit(0)), queries.byte_bpe())
    assert full.columns == [*docs.columns, "ids", "decoded"] and full.filter("decoded <> coalesce(text, '')").count() == 0


_TEXTS = st.lists(st.sampled_from(["<|endoftext|>", "the", " The", "  ", "\n", "don't", "I'LL", "é", "日本", "😀", "123", "!!!", "​", "ǅ", "aaaa", " a", "\t"]) | st.text(max_size=12), max_size=12).map("".join)
_own = {}


@settings(max_examples=300, deadline=None)
@given(_TEXTS)
def test_bpe_equals_the_library(tokenizer, text):
    own = _own.setdefault("bpe", bpe.ByteBpe(queries.byte_bpe()))
    e = tokenizer.encode(text, add_special_tokens=False)
    assert own.encode(text) == e.ids
    assert own.decode(e.ids) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_bpe_of_whole_tables(spark, tokenizer):
    """Every text of a table, with few pieces kept, and texts that are cut into chunks."""
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    long = [" ".join(texts)[:1_300_000], "ab" * 30_000, "word\n" * 300_000, "<|endoftext|> x" * 9, "é" * 70 + " " + "é" * 31]
    own = bpe.ByteBpe(queries.byte_bpe())
    for some in (texts, long, texts[:50]):
        packed = [b""] * len(some)
        for parts in own.encode_stream(some):
            for r, ids in parts:
                packed[r] += ids
        want = [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in packed] == want
        assert [x.decode("utf-8", "replace") for x in own.bytes_of(packed)] == some
        own.forget()
        assert len(own.cache) <= bpe.HOT_PIECES
    assert all("".join(bpe.chunks(t, 7)) == t for t in ["", "a b", "a  \n b" * 9, "x" * 50, " " * 50 + "x"])


def test_bpe_of_bytes_that_are_no_text(tokenizer):
    own = _own.setdefault("bpe", bpe.ByteBpe(queries.byte_bpe()))
    rng = random.Random(0)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_pair_tree_root_is_the_leftmost_lowest():
    keys = [5 << 32 | 0, 3 << 32 | 1, 3 << 32 | 2, 9 << 32 | 3, 4 << 32 | 4]
    tree = bpe.PairTree(keys)
    assert tree.root() == keys[1]
    tree.set(1, bpe.NONE)
    assert tree.root() == keys[2]
    tree.set(4, 1 << 32 | 4)
    assert tree.root() & 0xFFFFFFFF == 4


# -- 10: languages -------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["held_out"]]) > 0.97


def test_language_edges(spark, docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.language_digest(docs, queries.pieces()).collect()}
    odd = {i for i, t, *_ in made_up() if t is None or not any(c.isalpha() for c in t)}
    assert {i for i, p in got if p == "und"} == odd
    nothing = language_id.language_digest(docs.withColumn("lang", F.lit(None).cast("string")), queries.pieces())
    assert nothing.filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.language_digest(empty(spark), queries.pieces()).count() == 0


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    pieces = language_id.Pieces(names)
    p = np.random.default_rng(0).random((len(names) + 1, 2)) / 8
    number = {n: i + 1 for i, n in enumerate(names)}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            piece = word[:n]
            if piece in number or n == 1:
                out += p[number.get(piece, 0), lang] * total(word[n:], lang)
        return out

    for word in ("ab", "abba", "xab", "b", "aaaa"):
        got = language_id.word_scores([word], pieces, p)[0]
        assert np.allclose(np.exp(got), [total("▁" + word, k) for k in (0, 1)])
    # separators outside ASCII end words, and words of any length are one piece of work
    got = language_id.word_scores(["ab—ba", "ab", "ba", "ab" * 40, "ab" * 9], pieces, p)
    assert np.allclose(got[0], got[1] + got[2])
    table = functools.lru_cache(None)(lambda i, k: 1.0 if i == 81 else sum(p[number.get(w[i:j], 0), k] * table(j, k) for j in range(i + 1, min(i + 3, 81) + 1) if w[i:j] in number or j == i + 1))
    w = "▁" + "ab" * 40
    assert np.allclose(got[3], np.log([table(0, 0), table(0, 1)]))
    ((n, (_, chars)),) = language_id.word_parts(["ab" * 9]).items()
    one, counts, want = language_id.LongWord(pieces, chars[0]), np.zeros(p.shape), np.zeros(p.shape)
    assert np.allclose(one.sums(np.log(p))[n], got[4]) and np.allclose(one.sums(np.log(p), True)[0], got[4])
    one.add_counts(np.log(p), np.array([1.0, 2.0]), counts)
    lattice = pieces.lattice(chars)
    language_id.expected_counts(lattice, language_id.forward(lattice, 1, n, p), p, np.array([[1.0, 2.0]]), want)
    assert np.allclose(counts, want)


def test_all_letter_pieces_take_part():
    names = language_id.load_pieces(queries.pieces())
    pieces = language_id.Pieces(names)
    assert pieces.longest == max(map(len, names)) > 8
    long = max(names, key=len)
    _, rows, numbers = [x for x in pieces.from_start(np.array([[ord(c) for c in long]])) if x[0] == len(long)][0]
    assert names[numbers[0] - 1] == long


def test_languages_tie_and_are_bounded(spark, monkeypatch):
    rows = [(i, "abc abd", lang, 1) for i in range(60) for lang in ("b", "a")] + [(None, "abc", None, 1), (None, "abc", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = language_id.language_digest(docs, queries.pieces()).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"a"}
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="distinct values of lang"):
        language_id.language_digest(docs, queries.pieces())


def test_language_query_by_brute_force(spark):
    """Predictions from the learned probabilities by a plain recursion over each word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    inner = docs.withColumnRenamed("doc_id", "id")
    model = language_id.fit(inner.filter("lang is not null and text is not null").filter(language_id.fold("id", 3) != 1), queries.pieces())
    number = {p: i + 1 for i, p in enumerate(language_id.load_pieces(queries.pieces()))}
    log_p = np.log(model.p)

    @functools.lru_cache(None)
    def score(word):
        sums = [np.zeros(log_p.shape[1])]
        for end in range(1, len(word) + 1):
            ways = [sums[i] + log_p[number.get(word[i:end], 0)] for i in range(end) if word[i:end] in number or i == end - 1]
            sums.append(np.logaddexp.reduce(ways))
        return sums[-1]

    for r, text in zip(language_id.language_digest(docs, queries.pieces()).orderBy("doc_id").collect(), [x["text"] for x in docs.orderBy("doc_id").collect()], strict=True):
        found = regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())
        if not regex.search(r"\p{L}", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        total = sum(score("▁" + w) for w in found)
        share = np.exp(total - np.logaddexp.reduce(total))
        assert r["score"] == pytest.approx(share.max(), abs=1e-3) and share[model.languages.index(r["lang_pred"])] == pytest.approx(share.max(), abs=1e-3)


# -- 8: revisits ---------------------------------------------------------------------------


def brute_revisits(rows):
    out = []
    for i, url, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        earlier = [(t, j, low(h)) for j, u, t, k, h in rows if k == "response" and u is not None and url is not None and t is not None and ts is not None and u == url and (t, j) < (ts, i)]
        if not earlier:
            out.append((i, None, "missing", None))
            continue
        _, j, stored = max(earlier, key=lambda x: x[:2])
        mine = low(headers)
        tags = [h["etag"].removeprefix("W/") if "etag" in h else None for h in (mine, stored)]
        dates = [h.get("last-modified") for h in (mine, stored)]
        ok = tags[0] == tags[1] if None not in tags else dates[0] == dates[1] if None not in dates else False
        merged = stored | {k: v for k, v in mine.items() if k not in warc_revisits.PAYLOAD_HEADERS}
        out.append((i, j if ok else None, "resolved" if ok else "mismatch", tuple(sorted(merged.items())) if ok else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("spans", [1, 4, 64])
def test_revisits(spark, spans):
    from datetime import datetime, timedelta

    rng = random.Random(2)
    rows = []
    for i in range(400):
        url = "h.org/a" if rng.random() < 0.5 else rng.choice(["h.org/b", "x.net/?q=1", None])
        ts = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(150)) if rng.random() > 0.05 else None
        headers = {}
        if rng.random() < 0.7:
            headers["ETag"] = rng.choice(["", "W/"]) + rng.choice("12")
        if rng.random() < 0.6:
            headers["Last-Modified"] = rng.choice("xy")
        headers[rng.choice(["Content-Length", "Date", "CACHE-CONTROL"])] = str(i)
        rows.append((i, url, ts, rng.choice(["revisit", "response"]), headers if rng.random() > 0.05 else None))
    rows += [r for r in rows if r[3] == "revisit"][:60] + rows[:1]  # repeated records
    rows.append((7, "h.org/a", datetime(2024, 1, 1, 1), "response", {"ETag": "1"}))  # an id that others have
    df = spark.createDataFrame(rows, "record_id bigint, url string, ts timestamp, kind string, headers map<string,string>").withColumn("status", F.lit("mine"))
    got = warc_revisits.resolve_revisits(df, spans).select("record_id", "refers_to", "status", "merged").collect()
    assert sorted(((a, b, c, None if d is None else tuple(sorted(d.items()))) for a, b, c, d in got), key=str) == brute_revisits(rows)
    payload = warc_revisits.with_payload(warc_revisits.resolve_revisits(df, spans), df.withColumn("payload", F.concat(F.lit("p"), "record_id")))
    assert payload.filter("refers_to is not null and payload <> concat('p', refers_to)").count() == 0
    assert payload.count() == len(got)
    odd = warc_revisits.resolve_revisits(spark.createDataFrame([(None, "h.org/a", datetime(2024, 1, 2), "revisit", None, "x")], df.drop("status").schema.add("span", "string")), spans)
    assert [tuple(r) for r in odd.select("span", "canonical", "status").collect()] == [("x", None, "missing")]
    assert warc_revisits.resolve_revisits(df.limit(0), spans).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#top", "example.com/a?a=1&b=2"), ("https://m.example.com/index.html", "example.com"), ("https://u:p@example.com/A/b/", "example.com/A/b"), ("example.com?ref=x", "example.com"), (None, None)],
)
def test_canonical_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc_revisits.canonical_url(F.col("u"))).first()[0] == want


# -- queries beside SQL, and the pipeline ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_llm_query_equals_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = db.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = [tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want))


def test_pipeline_stages(spark, sf_dir):
    """Each stage beside brute force over what the stage before kept."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "bpe"]
    frames = [docs]
    for _, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    for f in frames[:-1]:
        assert f.columns == docs.columns
    rows = [[(r["doc_id"], r["text"], r["n_chars"]) for r in f.collect()] for f in frames[:-1]]
    verdict = {r["doc_id"]: r["kept"] for r in queries.op6_quality_rules(spark, sf_dir).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if verdict[r[0]])
    assert sorted((i, sha(t)) for i, t, _ in rows[2]) == sorted((i, s) for i, _, _, s in brute_lines(rows[1]))
    kept = {i for i, _, _, k in brute_near(rows[2], 5) if k}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] in kept)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_contamination(rows[3], items) if r[-1]}
    assert dirty
    before, after = {r[0]: r for r in rows[3]}, {r[0]: r for r in rows[4]}
    assert set(before) == set(after) and all((before[i] != after[i]) == (i in dirty) for i in before)
    assert all(n == len(t) for _, t, n in rows[4])
    assert frames[-1].count() == len(rows[4])
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, frames[-1].collect()))


def test_pipeline_stages_take_odd_documents(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and an empty table go through every stage."""
    import corpus_pipeline as cp

    sf = str(tmp_path)
    labels_of(docs).coalesce(1).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items_of(made_up()), "item_id bigint, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    clashing = docs.withColumns({c: F.lit(i) for i, c in enumerate(("id", "comp", "bucket", "score", "row", "drop", "hit", "items", "k1", "n_lines", "n_dropped", "n_words", "__kept", "ids_sha256"))})
    for table in (docs, empty(spark), clashing):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            if name != "bpe":
                assert out.columns == table.columns and out.schema["n_chars"].dataType.simpleString() == "bigint"
            assert out.count() <= table.count()


def test_clashing_columns_do_not_matter(spark, docs):
    """Operators that take two columns give the same rows, whatever else a table holds."""
    more = docs.withColumns({c: F.lit(c) for c in ("id", "good", "x", "score", "bands", "block", "quality", "held_out")})
    labels = labels_of(docs)
    for run in (
        lambda d: lm_score.lm_score_digest(d, labels),
        lambda d: quality_classifier.quality_classifier_digest(d, labels),
        lambda d: quality_rules.quality_rules_digest(d, labels),
        lambda d: language_id.language_digest(d, queries.pieces()),
        near_dedup.near_dedup_digest,
    ):
        assert sorted(map(tuple, run(more).collect()), key=str) == sorted(map(tuple, run(docs).collect()), key=str)
