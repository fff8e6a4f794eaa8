"""Operator 5: not-modified captures of a web archive, resolved to the full response that they confirm. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a bucket of captures: a page that is captured very often is dealt out by these.
BUCKET = 3600
#: Headers that a not-modified response doesn't replace in the stored one: they describe its payload or one connection.
KEPT = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """The url without fragment, its scheme's default port and utm_ parameters, its scheme and host in lower case, its parameters sorted."""
    m = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    origin = F.regexp_replace(F.concat(F.lower(m(1)), F.lit("://"), F.lower(m(2))), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    path = F.when(m(3) == "", F.lit("/")).otherwise(m(3))
    params = F.array_sort(F.filter(F.split(m(4), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.array_join(params, "&")
    whole = F.concat(origin, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(m(1) == "", url).otherwise(whole)


def resolve(captures: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every not-modified capture (status 304) with the latest earlier full response (status 200) of its canonical url.

    captures: record_id long, url string, ts long (seconds), status int, headers map<string,string> (names in lower case), digest string.
    Result: record_id, canonical_url, ts, source_id, source_ts, digest, outcome and headers. outcome is etag or last-modified where that
    validator is in both and equal (an entity tag counts first, W/ aside), unchecked where the capture has neither, changed where they
    differ or the response has none, missing where there is no earlier response. Only the first three take source, digest and the
    response's headers, with the capture's own instead wherever KEPT permits; the others keep their own headers.

    Earlier means a smaller ts; of responses at one time the largest record_id counts. Rows with a null url or ts find nothing. Repeated
    captures are each resolved. Two steps: within buckets of time of each url, and then between each url's buckets, one row each.
    """
    rows = captures.withColumns({"canonical_url": canonical(F.col("url")), "_bucket": F.floor(F.col("ts") / bucket)})
    full = (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("_full", F.when(full, F.struct("ts", F.col("record_id").alias("id"), "digest", "headers")))
    in_bucket = Window.partitionBy("canonical_url", "_bucket").orderBy("ts", F.col("_full").isNotNull(), "record_id")
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = rows.where("_full IS NOT NULL").groupBy("canonical_url", "_bucket").agg(F.max_by("_full", F.struct("_full.ts", "_full.id")).alias("_last"))
    # what stands before each bucket that has a capture to resolve: one row for each url and bucket
    asked = rows.where("status = 304").select("canonical_url", "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    by_url = Window.partitionBy("canonical_url").orderBy("_bucket", F.col("_last").isNotNull())
    before = last.union(asked).withColumn("_before", F.last("_last", ignorenulls=True).over(by_url.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_last IS NULL")
    out = rows.where("status = 304").join(before.select("canonical_url", "_bucket", "_before"), ["canonical_url", "_bucket"], "left")
    out = out.withColumn("_source", F.coalesce("_near", "_before"))
    head = lambda m, k: F.get(F.filter(F.array(F.element_at(m, F.lit(k))), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    tag = lambda m: F.regexp_replace(head(m, "etag"), "^W/", "")
    mine, theirs = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("_source.headers", F.create_map().cast("map<string,string>"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    outcome = (
        F.when(F.col("_source").isNull(), "missing")
        .when(tag(mine).isNotNull(), F.when(same(tag(mine), tag(theirs)), "etag").otherwise("changed"))
        .when(head(mine, "last-modified").isNotNull(), F.when(same(head(mine, "last-modified"), head(theirs, "last-modified")), "last-modified").otherwise("changed"))
        .otherwise("unchecked")
    )
    found = F.col("outcome").isin("etag", "last-modified", "unchecked")
    news = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(news, k)), news)
    return out.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", F.when(found, F.col("_source.id")).alias("source_id"), F.when(found, F.col("_source.ts")).alias("source_ts"),
        F.when(found, F.col("_source.digest")).alias("digest"), "outcome", F.when(found, merged).otherwise(mine).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Captures that pages stand for: each page's own response and, for two pages in three, a later not-modified capture.

    A page's place in time follows from its id. The later captures ask by another spelling of the url; some have the entity tag, some only
    the date, some neither, and some a tag of another state.
    """
    id = F.col("page_id")
    ts = F.lit(1_700_000_000) + F.pmod(id * 7919, F.lit(1_000_003))
    tag, changed = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"')), F.concat(F.lit("d"), (ts - F.pmod(id, F.lit(86_400))).cast("string"))
    first = pages.select(
        (2 * id).alias("record_id"), "url", ts.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"),
                     F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), ts.cast("string")).alias("headers"),
        F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    later = ts + 60 + F.pmod(id * 104_729, F.lit(200_000))
    kind = F.pmod(id, F.lit(8))
    etag = F.when(kind < 3, tag).when(kind == 3, F.concat(F.lit("W/"), tag)).when(kind == 4, F.lit('"other"')).otherwise(F.lit(""))
    date = F.when(kind < 6, changed).otherwise(F.lit(""))
    again = pages.where("pmod(page_id, 3) > 0").select(
        (2 * id + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("last-modified"), date, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), later.cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return first.union(again)


HEADERS = ("etag", "last-modified", "content-type", "content-length", "cache-control", "date")


def query(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "canonical_url", "ts", "source_id", "source_ts", "digest", "outcome", *(F.element_at("headers", h).alias(h.replace("-", "_")) for h in HEADERS))


_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
SQL = rf"""
WITH p AS (SELECT page_id AS id, url, coalesce(html, '') AS html, 1700000000 + (page_id * 7919) % 1000003 AS ts FROM pages),
t AS (SELECT *, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'd' || CAST(ts - id % 86400 AS VARCHAR) AS changed, ts + 60 + (id * 104729) % 200000 AS later, id % 8 AS kind FROM p),
c AS (
  SELECT 2 * id AS record_id, url, ts, 200 AS status, tag AS etag, changed AS last_modified, 'text/html' AS content_type,
         CAST(strlen(html) AS VARCHAR) AS content_length, 'max-age=60' AS cache_control, CAST(ts AS VARCHAR) AS date, md5(html) AS digest FROM t
  UNION ALL
  SELECT 2 * id + 1, url || '#again', later, 304, CASE WHEN kind < 3 THEN tag WHEN kind = 3 THEN 'W/' || tag WHEN kind = 4 THEN '"other"' ELSE '' END,
         CASE WHEN kind < 6 THEN changed ELSE '' END, NULL, '0', 'max-age=600', CAST(later AS VARCHAR), NULL FROM t WHERE id % 3 > 0),
m AS (SELECT *, regexp_extract(url, '{_PATTERN}', ['scheme', 'host', 'path', 'query']) AS u FROM c),
n AS (SELECT *, CASE WHEN u.scheme = '' THEN url ELSE
        regexp_replace(lower(u.scheme) || '://' || lower(u.host), '^(http://.*):80$|^(https://.*):443$', '\1\2') || CASE WHEN u.path = '' THEN '/' ELSE u.path END
        || CASE WHEN len(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) > 0
                THEN '?' || array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') ELSE '' END END AS canonical_url FROM m),
r AS (SELECT * FROM n WHERE status = 304),
s AS (SELECT r.record_id AS rid, n.*, row_number() OVER (PARTITION BY r.record_id ORDER BY n.ts DESC, n.record_id DESC) AS k
      FROM r JOIN n ON n.canonical_url = r.canonical_url AND n.status = 200 AND n.ts < r.ts),
o AS (SELECT r.*, s.record_id AS sid, s.ts AS sts, s.digest AS sdigest, s.etag AS setag, s.last_modified AS slm, s.content_type AS sct, s.content_length AS scl,
             CASE WHEN s.rid IS NULL THEN 'missing'
                  WHEN r.etag <> '' THEN CASE WHEN regexp_replace(r.etag, '^W/', '') = s.etag THEN 'etag' ELSE 'changed' END
                  WHEN r.last_modified <> '' THEN CASE WHEN r.last_modified = s.last_modified THEN 'last-modified' ELSE 'changed' END
                  ELSE 'unchecked' END AS outcome
      FROM r LEFT JOIN s ON s.rid = r.record_id AND s.k = 1)
SELECT record_id, canonical_url, ts, CASE WHEN ok THEN sid END AS source_id, CASE WHEN ok THEN sts END AS source_ts, CASE WHEN ok THEN sdigest END AS digest, outcome,
       etag, last_modified, CASE WHEN ok THEN sct END AS content_type, CASE WHEN ok THEN scl ELSE content_length END AS content_length, cache_control, date
FROM (SELECT *, outcome IN ('etag', 'last-modified', 'unchecked') AS ok FROM o)
"""
