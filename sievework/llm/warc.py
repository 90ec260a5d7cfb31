"""Not-modified revisits of a crawl, resolved to the responses they stand for.

A revisit is joined as of its time to the latest earlier full response of the same
canonical URL; validators are compared, and the headers that a 304 may update replace
the stored ones. The join runs in slices of time, so that captures of one URL, however
many, spread over tasks: within a slice by a window, across slices by one carried
response a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields of a 304 that never replace stored ones (fixed values: they describe the message or the hop, RFC 9111 section 3.2).
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Most slices of time.
SLICES = 200


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, sorted query without tracking; no scheme or fragment.

    Null for what has no scheme and host: such URLs are no page's.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _headers(headers: Column) -> Column:
    """Entries with lower-case names, sorted: maps can't be compared, arrays can."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.array_sort(F.coalesce(entries, F.expr("cast(array() as array<struct<name: string, value: string>>)")))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored entries, those that the update names replaced by its permitted ones; sorted."""
    new = F.filter(update, lambda e: ~e["name"].isin(*NOT_UPDATED) & e["value"].isNotNull())
    names = F.transform(new, lambda e: e["name"])
    kept = F.filter(stored, lambda e: ~F.array_contains(names, e["name"]))
    return F.array_sort(F.concat(kept, new))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit of captures (record_id long, url, ts long, kind, etag, last_modified, digest, length, headers map).

    kind is 'response' for a full response and 'revisit' for a not-modified record; other kinds, and rows without
    ts or a URL with scheme and host, are neither, but such a revisit is 'missing'. Very long URLs and headers are
    compared whole. The response is the latest with a smaller ts,
    of equal ones the largest record_id. status: 'missing' without such a response; else 'resolved' or 'mismatch' as
    the etags agree (weak comparison), or without two etags the modification times, or without two of those the
    digests; 'unverified' where nothing can be compared. Only a resolved revisit has merged headers. Repeated rows
    are resolved each. Other columns are ignored; an empty table gives an empty one.
    """
    rows = captures.select(
        "record_id", "kind", F.col("ts").cast("long").alias("ts"), canonical_url(F.col("url")).alias("page"),
        F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", "digest", F.col("length").cast("long").alias("length"), _headers(F.col("headers")).alias("entries"),
    ).where("kind in ('response', 'revisit')")
    placed = F.col("page").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(~placed & (F.col("kind") == "revisit"))  # no page to look for: they meet nobody, however many
    rows = rows.where(placed)
    quantiles = [k / SLICES for k in range(1, SLICES)]
    bounds = captures.select(F.percentile_approx(F.col("ts").cast("long"), quantiles, 10_000).alias("b")).first()["b"]  # SLICES numbers
    edges = F.array(*map(F.lit, sorted(set(bounds or [0]))))
    sliced = rows.withColumn("slice", F.size(F.filter(edges, lambda b: b < F.col("ts"))))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "length", "entries"))
    per_slice = sliced.groupBy("page", "slice").agg(F.max(full).alias("latest"))
    earlier = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select("page", "slice", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("page", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("within", F.max(full).over(before)).where("kind = 'revisit'")
    found = within.join(carried, ["page", "slice"], "left").withColumn("r", F.coalesce("within", "carried")).drop("slice", "within", "carried")
    found = found.unionByName(lost.withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))
    both = lambda c: F.col(c).isNotNull() & F.col("r")[c].isNotNull()
    agree = F.coalesce(*(F.when(both(c), F.col(c) == F.col("r")[c]) for c in ("etag", "last_modified", "digest")))
    status = F.when(F.col("r").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    joined = found.withColumn("status", status)
    good = F.col("status") == "resolved"
    return joined.select(
        "record_id", F.col("page").alias("canonical_url"), "status", F.col("r.record_id").alias("response_id"),
        F.when(good, F.col("r.digest")).alias("digest"), F.when(good, F.col("r.length")).alias("length"), F.when(good, merged_headers(F.col("r.entries"), F.col("entries"))).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl of a table of pages (page_id, url, html), by rule: what a second visit some time later would have recorded.

    Every page is a full response at time page_id; every third is fetched anew 10^7 later with a changed body. Every
    page is revisited at 2 * 10^7 by a variant of its URL: with the current etag, but every fifth with another one,
    and every seventh with a modification time only. Every eleventh is also revisited before it was ever fetched.
    """
    p = pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("tag"), F.octet_length("html").alias("size"))
    third, day = F.col("page_id") % 3 == 0, F.concat(F.lit("day "), F.col("page_id") % 28)
    newer = F.concat(F.col("tag"), F.lit("-2"))

    def rows(which: DataFrame, visit: int, kind: str, ts: Column, url: Column, etag: Column, modified: Column, digest: Column, length: Column, **headers: Column) -> DataFrame:
        pairs = [x for name, v in headers.items() for x in (F.lit(name.replace("_", "-")), v.cast("string"))]
        return which.select(
            (F.col("page_id") * 4 + visit).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), etag.cast("string").alias("etag"),
            modified.cast("string").alias("last_modified"), digest.cast("string").alias("digest"), length.cast("long").alias("length"), F.create_map(*pairs).alias("headers"),
        )

    none, page, url = F.lit(None), F.col("page_id"), F.col("url")
    current = F.when(third, newer).otherwise(F.col("tag"))
    sent = F.when(page % 5 == 0, "other").when(page % 7 == 0, none).otherwise(current)
    first = rows(p, 0, "response", page, url, F.col("tag"), day, F.col("tag"), F.col("size"), Content_Type=F.lit("text/html"), Content_Length=F.col("size"), ETag=F.col("tag"), Date=page, Cache_Control=F.lit("max-age=60"))
    again = rows(p.where(third), 1, "response", page + 10_000_000, url, newer, day, newer, F.col("size") + 2, Content_Type=F.lit("text/html"), Content_Length=F.col("size") + 2, ETag=newer, Date=page + 10_000_000, Cache_Control=F.lit("max-age=60"))
    later = rows(p, 2, "revisit", page + 20_000_000, F.concat(url, F.lit("#again")), F.concat(F.lit("W/"), sent), day, none, none, Content_Length=F.lit(0), Date=page + 20_000_000, Cache_Control=F.lit("max-age=90"), X_Cache=F.lit("hit"))
    early = rows(p.where(page % 11 == 0), 3, "revisit", page - 100_000_000, url, F.col("tag"), day, none, none, Date=page - 100_000_000)
    return first.unionByName(again).unionByName(later).unionByName(early)


#: DuckDB's version of resolve_revisits(captures_of(pages)), headers joined by line feeds.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, strlen(html) AS size, 'day ' || (page_id % 28) AS day, page_id % 3 = 0 AS third,
         regexp_replace(url, '#.*$', '') AS bare
  FROM pages),
u AS (
  SELECT *,
    regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), '^www[.]|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))), '&') AS query
  FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS page FROM u),
responses AS (
  SELECT page, page_id AS ts, page_id * 4 AS record_id, tag AS etag, day, tag AS digest, size AS length FROM c
  UNION ALL
  SELECT page, page_id + 10000000, page_id * 4 + 1, tag || '-2', day, tag || '-2', size + 2 FROM c WHERE third),
revisits AS (
  SELECT page, page_id + 20000000 AS ts, page_id * 4 + 2 AS record_id, day,
         CASE WHEN page_id % 5 = 0 THEN 'other' WHEN page_id % 7 = 0 THEN NULL WHEN third THEN tag || '-2' ELSE tag END AS etag,
         'cache-control: max-age=90' AS cache, 'x-cache: hit' AS extra
  FROM c
  UNION ALL
  SELECT page, page_id - 100000000, page_id * 4 + 3, day, tag, NULL, NULL FROM c WHERE page_id % 11 = 0),
ranked AS (
  SELECT v.*, r.record_id AS response_id, r.etag AS r_etag, r.day AS r_day, r.digest AS r_digest, r.length AS r_length,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS n
  FROM revisits v LEFT JOIN responses r ON r.page = v.page AND r.ts < v.ts),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN CASE WHEN etag IS NOT NULL THEN etag = r_etag ELSE day = r_day END THEN 'resolved' ELSE 'mismatch' END AS status
  FROM ranked WHERE n = 1)
SELECT record_id, page AS canonical_url, status, response_id,
       CASE WHEN status = 'resolved' THEN r_digest END AS digest, CASE WHEN status = 'resolved' THEN r_length END AS length,
       CASE WHEN status = 'resolved' THEN array_to_string(list_filter(
         [coalesce(cache, 'cache-control: max-age=60'), 'content-length: ' || r_length, 'content-type: text/html', 'date: ' || ts, 'etag: ' || r_etag, extra],
         lambda x: x IS NOT NULL), chr(10)) END AS headers
FROM judged
"""
