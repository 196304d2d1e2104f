"""Resolution of not-modified revisit records in web archives.

A revisit record says that a server answered 304 Not Modified: the page is as in an earlier
full response. It is resolved by an as-of join: by canonical URL, to the latest earlier
full response. The validators must agree (the entity tags by weak comparison if both have
one, else the Last-Modified dates if both have one); then headers of the 304 that may
update a stored response replace those of the response, except the ones that describe
the payload itself.

A URL may hold a third of all records. Therefore time is cut into spans by quantiles over all
records, one for about ``SPAN_ROWS`` records, ``SPANS`` at least and ``MOST_SPANS`` at most (longer
spans only take longer); within (URL, span) a window carries the last full response along, and
what a span starts with is the last full response of the spans before it, found by a window over
one summary row per span. No window sees all records of a hot URL. Every revisit goes through as
one row with all its columns; nothing is joined back by record_id.

Records: (record_id long, url string, ts timestamp, kind string: 'response' or 'revisit',
headers map<string,string>). Other columns are carried through; columns named like the results
are replaced.

Defined cases: revisits with a null URL, time or record_id are ``missing`` with a null canonical
URL, and such responses answer no one; null headers are none; of full responses at one time the
largest record_id is the latest, and of equal record_ids the one whose sorted headers have the
largest hash; a response at the time of the revisit itself counts as earlier only if its record_id
is smaller; repeated revisits have a row each; a revisit without an earlier full response is
``missing``, one whose validators disagree or are absent ``mismatch``; header names compare
without case, and repeated names keep the last value; an empty table gives an empty one; header
values and URLs of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, stash

SPANS, MOST_SPANS, SPAN_ROWS = 64, 1024, 1_000_000
#: Headers that a 304 must not change, as they describe the stored payload (fixed values).
PAYLOAD_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "trailer", "connection", "keep-alive", "te", "upgrade")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., m. and default ports; no scheme, fragment, user or trailing slash;
    query parameters sorted, without tracking ones."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www[0-9]*|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "(/index\\.html?)?/*$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)="))
    joined = F.array_join(F.array_sort(parts), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of repeated ones the last."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def _agrees(mine: Column, stored: Column) -> Column:
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.try_element_at(h, F.lit("last-modified"))
    return F.when(tag(mine).isNotNull() & tag(stored).isNotNull(), tag(mine) == tag(stored)).when(date(mine).isNotNull() & date(stored).isNotNull(), date(mine) == date(stored)).otherwise(F.lit(False))


def merged_headers(stored: Column, update: Column) -> Column:
    permitted = F.map_filter(update, lambda k, _: ~k.isin(*PAYLOAD_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def span_bounds(records: DataFrame, spans: int | None = None) -> list:
    """Cutting times, fewer than spans (by the count of records where that is None), from a sketch over all records."""
    q = [i / MOST_SPANS for i in range(1, MOST_SPANS)]
    n, cuts = records.agg(F.count("*"), F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), q, 10000)).first()
    spans = spans or min(MOST_SPANS, max(SPANS, -(-n // SPAN_ROWS)))
    return sorted({cuts[i * MOST_SPANS // spans - 1] for i in range(1, spans)}) if cuts else []


RESULTS = ("canonical", "refers_to", "status", "merged")


def resolve_revisits(records: DataFrame, spans: int | None = None) -> DataFrame:
    """The revisit records with columns: canonical, refers_to, status ('resolved', 'mismatch',
    'missing') and merged (headers; null unless resolved)."""
    cuts = span_bounds(records, spans)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col("__t")))
    names = [c for c in records.columns if c not in RESULTS]
    full, revisit = F.col("kind") == "response", F.col("kind") == "revisit"
    row = F.when(revisit, F.struct(*names))  # what is carried through, of revisits alone
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    lean = records.filter(usable & (full | revisit)).select(
        canonical_url(F.col("url")).alias("__url"), micros.alias("__t"), F.col("record_id").alias("__id"), full.alias("__full"), _lower_keys(F.col("headers")).alias("__h"), row.alias("__row")
    )
    lean = lean.withColumn("__span", span).withColumn("__tie", F.when(F.col("__full"), F.xxhash64(F.array_sort(F.map_entries("__h")))))
    own = F.struct(F.col("__t").alias("t"), F.col("__id").alias("r"), F.col("__h").alias("h"))
    last = F.last(F.when(F.col("__full"), own), ignorenulls=True)
    # within a span: the last full response before each record; after it: the span's last
    inside = Window.partitionBy("__url", "__span").orderBy("__t", "__id", "__full", "__tie")
    found = lean.withColumn("__near", last.over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    summary = lean.groupBy("__url", "__span").agg(F.max_by(F.when(F.col("__full"), own), F.when(F.col("__full"), F.struct("__t", "__id", "__tie"))).alias("__end"))
    carried = summary.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy("__url").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))).select("__url", "__span", "__carry")
    joined = found.filter("not __full").join(carried, ["__url", "__span"]).withColumn("__base", F.coalesce("__near", "__carry"))
    status = F.when(F.col("__base").isNull(), "missing").when(_agrees(F.col("__h"), F.col("__base.h")), "resolved").otherwise("mismatch")
    resolved = F.col("status") == "resolved"
    result = joined.withColumn("status", status).select(
        *(F.col("__row").getField(c).alias(c) for c in names), F.col("__url").alias("canonical"), F.when(resolved, F.col("__base.r")).alias("refers_to"), "status",
        F.when(resolved, merged_headers(F.col("__base.h"), F.col("__h"))).alias("merged"),
    )
    kinds = {c: result.schema[c].dataType for c in RESULTS}
    rest = records.filter(revisit & ~usable).select(*names, *(F.lit("missing" if c == "status" else None).cast(t).alias(c) for c, t in kinds.items()))
    return result.unionByName(rest)


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """Resolved revisits with the payload of the response they refer to; of repeated record_ids the latest
    response, and of those at one time the largest payload."""
    stored = records.filter("kind = 'response' and record_id is not null").groupBy(F.col("record_id").alias("__ref")).agg(F.max_by(payload, F.struct("ts", payload)).alias("__payload"))
    return resolved.drop(payload).join(stored, resolved["refers_to"] == stored["__ref"], "left").drop("__ref").withColumnRenamed("__payload", payload)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records derived from pages (page_id, url, html).

    A page is crawled at page_id minutes: every third one (page_id mod 3 = 1) with a 304, the
    others in full. Hosts serve paths numbered in tens, so that URLs are crawled again. Entity
    tags change with the decade of the page; every seventh record has a date instead of a tag.
    """
    day = F.floor(F.col("page_id") / 10)
    url = F.concat(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", "^[a-zA-Z]+://[^/]*/([a-z]*)", 1), F.regexp_extract("url", "([?#].*)$", 1))
    version = F.floor(F.col("page_id") / 500).cast("string")
    date = F.date_format(F.timestamp_seconds(F.floor(F.col("page_id") / 500) * 86400), "yyyy-MM-dd")
    seventh = F.col("page_id") % 7 == 3
    kind = F.when(F.col("page_id") % 3 == 1, "revisit").otherwise("response")
    headers = F.map_concat(
        F.when(seventh, F.create_map(F.lit("Last-Modified"), date)).otherwise(F.create_map(F.lit("ETag"), F.concat(F.when(F.col("page_id") % 2 == 0, "W/").otherwise(""), version))),
        F.when(kind == "response", F.create_map(F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Date"), day.cast("string"))).otherwise(
            F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), day.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
        ),
    )
    return pages.select(F.col("page_id").cast("bigint").alias("record_id"), url.alias("url"), F.timestamp_seconds(F.col("page_id") * 60).alias("ts"), kind.alias("kind"), headers.alias("headers"))


def warc_revisits_digest(pages: DataFrame) -> DataFrame:
    """The registered query: page_id, canonical, refers_to, status, merged (headers as sorted text)."""
    records = stash(records_of_pages(pages), "records")
    resolved = resolve_revisits(records)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return resolved.select(F.col("record_id").alias("page_id"), "canonical", "refers_to", "status", text.alias("merged"))


def op8_warc_revisits(spark, sf_dir):
    return warc_revisits_digest(documents(spark, sf_dir, "pages"))


_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^(www[0-9]*|m)\.', '')"

ORACLE_SQL = rf"""
WITH r AS (
  SELECT page_id, page_id % 3 = 1 AS revisit,
    concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/', regexp_extract(url, '^[a-zA-Z]+://[^/]*/([a-z]*)', 1), regexp_extract(url, '([?#].*)$', 1)) AS u,
    CASE WHEN page_id % 7 <> 3 THEN CAST(page_id // 500 AS VARCHAR) END AS tag,
    CASE WHEN page_id % 7 <> 3 AND page_id % 2 = 0 THEN 'W/' ELSE '' END AS weak,
    CASE WHEN page_id % 7 = 3 THEN strftime(DATE '1970-01-01' + CAST(page_id // 500 AS INTEGER), '%Y-%m-%d') END AS modified,
    CAST(page_id // 10 AS VARCHAR) AS day, CAST(length(html) AS VARCHAR) AS len
  FROM pages
), c AS (
  SELECT r.*, regexp_replace(regexp_replace(u, '#.*$', ''), '^[a-zA-Z]+://[^/?]*', '') AS tail, {_KEY} AS host FROM r
), k AS (
  SELECT c.*, list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)='))) AS q,
    regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '(/index\.html?)?/*$', '') AS path FROM c
), z AS (
  SELECT *, concat(host, path, CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS canonical FROM k
), j AS (
  SELECT v.page_id, v.canonical, v.tag AS vt, v.weak AS vw, v.modified AS vm, v.day AS vd, f.page_id AS ref, f.tag AS ft, f.modified AS fm, f.len AS flen
  FROM (SELECT * FROM z WHERE revisit) v ASOF LEFT JOIN (SELECT * FROM z WHERE NOT revisit) f ON v.canonical = f.canonical AND v.page_id > f.page_id
), s AS (
  SELECT *, CASE WHEN ref IS NULL THEN 'missing' WHEN coalesce(CASE WHEN vt IS NOT NULL AND ft IS NOT NULL THEN vt = ft WHEN vm IS NOT NULL AND fm IS NOT NULL THEN vm = fm END, false) THEN 'resolved' ELSE 'mismatch' END AS status FROM j
)
SELECT page_id, canonical, CASE WHEN status = 'resolved' THEN ref END AS refers_to, status,
  CASE WHEN status = 'resolved' THEN concat('cache-control=max-age=60;content-length=', flen, ';date=', vd, CASE WHEN vt IS NOT NULL THEN concat(';etag=', vw, vt) ELSE concat(';last-modified=', vm) END) END AS merged
FROM s
"""
