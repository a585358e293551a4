"""Resolution of not-modified revisits in web captures.

A revisit record says that a page was asked for again and had not changed; its
body is that of an earlier full response.  It is found by an as-of join on the
canonical url: the latest full response before the revisit.  Where the revisit's
validators agree with it, the revisit is resolved, and takes the response's
headers, updated by those of its own headers that a not-modified answer may
change.

The join is a window in buckets of time.  Within (url, bucket) a running last
value finds the response; what a bucket leaves over is carried to later ones by a
second window over one row per (url, bucket).  So a url with a third of all
captures is spread over its buckets, and only its buckets meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that describe the stored body or the connection; a not-modified answer doesn't change them. Fixed values.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range",
    "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that don't change the page. Fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Seconds of a bucket.
BUCKET = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case, no fragment, default port, tracking parameter or closing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.regexp_replace(F.concat(F.lit("&"), query), f"&(?:{TRACKING})=[^&]*", "")
    kept = F.regexp_replace(kept, "^&+", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(captures: DataFrame, bucket_seconds: int = BUCKET) -> DataFrame:
    """A row for every revisit of ``captures``, with the response that it refers to.

    ``captures``: capture_id, url, ts (seconds), kind (``response`` or
    ``revisit``), etag, last_modified, digest, headers (map by lower-case name).
    Returned: capture_id, canonical_url, ts, refers_to, state, headers.  ``state``
    is ``resolved``; ``mismatch`` where a validator of the revisit differs from
    the response's (the first that both have of etag, compared weakly,
    last_modified and digest); ``unverified`` where they share none; ``orphan``
    without an earlier response.  Only resolved revisits have merged headers,
    others keep their own.

    Earlier means a lesser (ts, capture_id).  A null url or ts finds nothing and
    is found by nothing; a null map of headers reads as empty; other columns are
    ignored; no revisit gives no row.
    """
    # All columns are named here, so that others of the table can't clash.
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "capture_id", canonical_url(F.col("url")).alias("key"), "ts", "kind", "etag", "last_modified", "digest",
        F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"),
        F.floor(F.col("ts") / bucket_seconds).alias("bucket"),
    )
    findable = (F.col("kind") == "response") & F.col("key").isNotNull() & F.col("ts").isNotNull()
    full = F.when(findable, F.struct("ts", "capture_id", "etag", "last_modified", "digest", "headers"))
    rows = rows.withColumn("full", full)
    before = Window.partitionBy("key", "bucket").orderBy("ts", "capture_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(before)).where(F.col("kind") == "revisit").drop("full")
    # One row per url and bucket; a url's buckets are as many as the days that it was seen on.
    ends = rows.groupBy("key", "bucket").agg(F.max_by("full", F.when(findable, F.struct("ts", "capture_id"))).alias("full"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "bucket", F.last("full", ignorenulls=True).over(earlier).alias("far")).where(F.col("far").isNotNull())
    both = near.join(carried, ["key", "bucket"], "left").withColumn(
        "found", F.when(F.col("key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "far"))
    )
    agrees = F.coalesce(
        _weak(F.col("etag")) == _weak(F.col("found.etag")),
        F.col("last_modified") == F.col("found.last_modified"),
        F.col("digest") == F.col("found.digest"),
    )
    state = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    changed = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_HEADERS))
    kept = F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(changed, k))
    return both.select(
        "capture_id", F.col("key").alias("canonical_url"), "ts", F.col("found.capture_id").alias("refers_to"),
        state.alias("state"), F.when(state == "resolved", F.map_concat(kept, changed)).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of ``pages(page_id, url, html)``: a full response of each page, and three revisits of it.

    The response lies at a time that follows from page_id; one revisit lies
    before it, one after it with its etag, one later, by its digest (of another
    body for every third page).
    """
    page, html = F.col("page_id").cast("long"), F.coalesce("html", F.lit(""))
    at = page * 7919 % 1_000_000
    body = F.md5(html)
    header = lambda *x: F.create_map(*[F.lit(y) if isinstance(y, str) else y for y in x])
    record = lambda k, ts, kind, etag, digest, headers: F.struct(
        (page * 4 + k).alias("capture_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"),
        etag.cast("string").alias("etag"), digest.cast("string").alias("digest"), headers.alias("headers"),
    )
    quoted = F.concat(F.lit('"'), body, F.lit('"'))
    none = F.lit(None).cast("string")
    first = header("content-type", "text/html", "content-length", F.octet_length(html).cast("string"), "cache-control", "max-age=60", "date", at.cast("string"))
    later = lambda ts: header("content-length", "0", "cache-control", "max-age=600", "date", ts.cast("string"))
    t1, t2, t3 = at - 50_000, at + 3_600 * (1 + page % 5), at + 400_000
    records = F.array(
        record(0, at, "response", quoted, body, first),
        record(1, t1, "revisit", quoted, none, later(t1)),
        record(2, t2, "revisit", F.concat(F.lit("W/"), quoted), none, later(t2)),
        record(3, t3, "revisit", none, F.when(page % 3 == 0, F.md5(F.concat(html, F.lit("+")))).otherwise(body), later(t3)),
    )
    return pages.select("url", F.explode(records).alias("r")).select("url", "r.*", F.lit(None).cast("string").alias("last_modified"))


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
