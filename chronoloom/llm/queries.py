"""The registered queries of this subpackage and, where SQL can say the same, that SQL."""

from __future__ import annotations

from chronoloom.llm.bpe import bpe_digest
from chronoloom.llm.common import documents
from chronoloom.llm.decontaminate import contamination_digest
from chronoloom.llm.importance import resample_digest
from chronoloom.llm.language_id import language_digest
from chronoloom.llm.line_dedup import line_dedup_digest
from chronoloom.llm.lm_score import lm_score_digest
from chronoloom.llm.near_dedup import near_dedup_digest
from chronoloom.llm.prefix_trie import prefix_trie_digest
from chronoloom.llm.quality_classifier import quality_classifier_digest
from chronoloom.llm.quality_rules import quality_rules_digest
from chronoloom.llm.sentence_dedup import sentence_dedup_digest
from chronoloom.llm.vector_search import vector_search_digest
from chronoloom.llm.warc_revisits import ORACLE_SQL as _WARC_SQL
from chronoloom.llm.warc_revisits import op8_warc_revisits


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, looked up when a query runs; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> str:
    return vocabulary("byte_bpe_50k.json")


def pieces() -> str:
    return vocabulary("piece_bpe_32k.model")


def op1_lm_score(spark, sf_dir):
    return lm_score_digest(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_near_dedup(spark, sf_dir):
    return near_dedup_digest(documents(spark, sf_dir))


def op3_decontaminate(spark, sf_dir):
    return contamination_digest(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_sentence_dedup(spark, sf_dir):
    return sentence_dedup_digest(documents(spark, sf_dir), go_on=True)


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier_digest(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules_digest(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup_digest(documents(spark, sf_dir))


def op9_bpe(spark, sf_dir):
    return bpe_digest(documents(spark, sf_dir), byte_bpe())


def op10_language_id(spark, sf_dir):
    return language_digest(documents(spark, sf_dir), pieces())


def op11_importance_resampling(spark, sf_dir):
    return resample_digest(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie_digest(documents(spark, sf_dir, "conversations"))


def op13_vector_search(spark, sf_dir):
    return vector_search_digest(documents(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_near_dedup, op3_decontaminate, op4_sentence_dedup, op5_quality_classifier, op6_quality_rules, op7_line_dedup, op8_warc_revisits, op9_bpe, op10_language_id, op11_importance_resampling, op12_prefix_trie, op13_vector_search)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_TOKENS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: CRC-32 of the text {0} byte by byte; ``crc`` is a relation of one row with the table ``tab``.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen({0}) * 2, 2), lambda p: CAST('0x' || substr(hex(encode({0})), p, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_SQL = {
    "op1_lm_score": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TOKENS}') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0) AS good FROM documents
), t AS (
  SELECT rid, good, word, coalesce(lag(word) OVER (PARTITION BY rid ORDER BY i), '') AS prev
  FROM (SELECT rid, good, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)
), one AS (SELECT word, count(*) AS b, count(*) FILTER (WHERE good) AS g FROM t GROUP BY 1
), ahead AS (SELECT prev, count(*) AS b, count(*) FILTER (WHERE good) AS g FROM t GROUP BY 1
), two AS (SELECT prev, word, count(*) AS b, count(*) FILTER (WHERE good) AS g FROM t GROUP BY 1, 2
), n AS (SELECT count(*) AS v, sum(b) AS b, sum(g) AS g FROM one
), l AS (
  SELECT prev, word, -ln(0.6 * two.b / greatest(ahead.b, 1) + 0.4 * (0.9 * one.b / greatest(n.b, 1) + 0.1 / v)) AS lb,
    -ln(0.6 * two.g / greatest(ahead.g, 1) + 0.4 * (0.9 * one.g / greatest(n.g, 1) + 0.1 / v)) AS lg
  FROM two JOIN one USING (word) JOIN ahead USING (prev), n
), s AS (SELECT rid, count(*) AS n, avg(lg) AS lg, avg(lb) AS lb FROM t JOIN l USING (prev, word) GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(lg, 6) + 0.0 AS target_loss, round(lb, 6) + 0.0 AS background_loss, round(coalesce(lg - lb, 0), 6) + 0.0 AS score
FROM d LEFT JOIN s USING (rid)
""",
    "op2_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[p:p + 3], ' ') FOR p IN range(1, len(w) - 2)] END) AS s FROM d WHERE len(w) > 0
), e AS (
  SELECT rep, n, hash(unnest(s)) AS h FROM (SELECT min(doc_id) AS rep, len(k) AS n, k AS s FROM (SELECT doc_id, list_sort(s) AS k FROM s) GROUP BY k)
), j AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), m AS (
  SELECT s.doc_id, min(s.doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM s
), l AS (SELECT a, b FROM j UNION SELECT b, a FROM j
), r(x, y) AS (
  SELECT DISTINCT rep, rep FROM m UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y
), g AS (
  SELECT doc_id, min(y) AS comp FROM m JOIN r ON r.x = m.rep GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(comp, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp, d.doc_id) AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)
""",
    "op3_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), x AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS phrase
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)
), f AS (
  SELECT rid, x.m, p, item FROM x JOIN g ON x.m = g.m AND x.phrase = g.phrase
), h AS (
  SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS i FROM f) GROUP BY rid
), i AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM f) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
""",
    "op4_sentence_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), p AS (
  SELECT rid, doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k
  FROM (SELECT rid, doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]+|{_TOKENS}') AS l FROM d)
), q AS (
  SELECT *, regexp_matches(tok, '^{_TOKENS}') AS word, lag(tok) OVER w AS gap, lag(tok, 2) OVER w AS before FROM p WINDOW w AS (PARTITION BY rid ORDER BY k)
), o AS (
  SELECT *, sum(CASE WHEN word AND (before IS NULL OR right(before, 1) IN ('.', '!', '?') OR contains(gap, chr(10))) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS sid FROM q
), u AS (
  SELECT rid, doc_id, sid, string_agg(tok, '' ORDER BY k) AS body, count(*) FILTER (WHERE word) AS n, string_agg({_LOWER.format("tok")}, ' ' ORDER BY k) FILTER (WHERE word) AS key FROM o GROUP BY 1, 2, 3
), v AS (
  SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY sid) AS c FROM u WHERE sid > 0
), r AS (
  SELECT a.rid, a.sid AS i, min(b.sid) AS j FROM v a JOIN v b ON a.rid = b.rid AND b.sid BETWEEN a.sid + 1 AND a.sid + 11 AND b.c - a.c + a.n >= 12 GROUP BY 1, 2
  UNION SELECT b.rid, max(a.sid), b.sid FROM v a JOIN v b ON a.rid = b.rid AND a.sid BETWEEN b.sid - 11 AND b.sid - 1 AND b.c - a.c + a.n >= 12 GROUP BY b.rid, b.sid
), x AS (
  SELECT r.rid, r.i, r.j, any_value(v.doc_id) AS doc_id, string_agg(v.key, ' ' ORDER BY v.sid) AS key FROM r JOIN v ON v.rid = r.rid AND v.sid BETWEEN r.i AND r.j GROUP BY 1, 2, 3
), y AS (
  SELECT *, row_number() OVER (PARTITION BY rid, key ORDER BY i) > 1 AS again, min(doc_id) OVER (PARTITION BY key) AS first FROM x
), z AS (
  SELECT DISTINCT rid, unnest(range(CAST(i AS BIGINT), CAST(j AS BIGINT) + 1)) AS sid FROM y WHERE again OR doc_id > first
), m AS (
  SELECT u.rid, count(*) FILTER (WHERE u.sid > 0) AS n, count(z.sid) AS gone, coalesce(sum(u.n) FILTER (WHERE z.sid IS NOT NULL), 0) AS words, string_agg(body, '' ORDER BY u.sid) FILTER (WHERE z.sid IS NULL) AS kept
  FROM u LEFT JOIN z ON z.rid = u.rid AND z.sid = u.sid GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(words, 0) AS BIGINT) AS words_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (rid)
""",
    "op7_line_dedup": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(doc_id <> top, false) AS gone FROM k LEFT JOIN s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
""",
    "op8_warc_revisits": _WARC_SQL,
    "op11_importance_resampling": rf"""
WITH {_CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
), b AS (
  SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
), f AS (
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d
  UNION ALL SELECT NULL, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM b
), k AS (
  SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc
), n AS (
  SELECT bucket, count(rid) AS s, count(*) - count(rid) AS t FROM f JOIN k USING (f) GROUP BY 1
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n
), v AS (
  SELECT rid, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN k USING (f) JOIN g USING (bucket) WHERE rid IS NOT NULL GROUP BY 1
), s AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN v USING (rid)
), r AS (
  SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM s
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM r
""",
    "op12_prefix_trie": rf"""
WITH {_CRC_TABLE}, c AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{_TOKENS}')) AS n FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h, t FROM (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS t FROM c GROUP BY 1), crc
), p AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) AS t FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20
), x AS (
  SELECT conv_id, len(t) AS n, t, unnest(range(0, len(t) + 1)) AS d FROM p
), y AS (
  SELECT conv_id, d, n = d AS ends, CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS words, list_transform(t[1:d], lambda e: e.k) AS path FROM x
), n AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM y GROUP BY path
), k AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)
), a AS (
  SELECT path[1:lvl] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS lvl FROM m) GROUP BY 1
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN a USING (path) LEFT JOIN m u ON u.path = m.path[1:m.depth - 1] AND m.depth > 0
""",
    "op13_vector_search": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
""",
}
