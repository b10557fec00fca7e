"""WARC revisit resolution: an as-of join of revisit records with earlier full responses.

A revisit record says that a URL had not changed since an earlier capture. ``resolve_revisits`` sorts
responses and revisits of each canonical URL by capture time in one table and carries the last full
response forward (range partitions, so a URL with a third of all captures is spread over many tasks);
this is an as-of join to the latest response captured strictly before the revisit. Its validators must
agree: the entity tag by weak comparison where both records have one, else Last-Modified where both have
one, else the payload digest. A resolved revisit has the response's payload and its headers, replaced
by those that a not-modified answer may update.

Captures: (record_id, warc_type 'response' | 'revisit', target_uri, captured_at, status, headers
map<string,string> with lower-case names, payload_digest). Only a response of status 200 to 299 is a full
one; other records are neither resolved nor used.

Defined cases: a NULL or relative target_uri has no canonical form, and its revisits end as
``no_response``; a NULL time sorts before all others; of responses at one time the largest record_id
counts; NULL headers are empty; without a validator common to both records a revisit ends as
``no_validator``; repeated records are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import ascii_lower
from ledgerlens.operators.ranges import carried_forward

# Headers that a 304 answer carries to update the stored response
# (RFC 9110, section 15.4.5, and the age and date fields of RFC 9111).
UPDATED_BY_REVISIT = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that do not choose the content.
IGNORED_PARAMETERS = "ref|utm_[a-z]+|gclid|fbclid|sessionid|sid"


def canonical_url(url: Column) -> Column:
    """``host/path?query``: no scheme, user, ``www.``, default port, fragment or tracking parameters; host in
    lower case; index pages and the final slash dropped; parameters sorted. NULL without ``://`` or host."""
    rest = F.regexp_extract(url, "://([^#]*)", 1)
    host = ascii_lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/(index[.]html?)?$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"),
                    lambda p: (p != "") & ~p.rlike(f"^({IGNORED_PARAMETERS})(=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` with canonical_url, outcome, refers_to, payload_of, resolved_digest, merged_headers.

    ``outcome``: 'response' for a full response, 'resolved', 'changed' (validators differ), 'no_validator',
    'no_response', or 'other'. ``payload_of`` is the record whose payload the record has."""
    names = captures.columns
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    row = F.col("_row")
    headers = F.coalesce(row["headers"], F.create_map().cast("map<string,string>"))
    full = (row["warc_type"] == "response") & row["status"].between(200, 299)
    rows = rows.select(
        "_row", canonical_url(row["target_uri"]).alias("_url"), headers.alias("_headers"),
        row["captured_at"].alias("_at"), row["record_id"].alias("_id"), F.coalesce(full, F.lit(False)).alias("_full"))
    # a revisit sorts before the responses of its own time, so it sees only earlier ones
    response = F.struct(F.col("_id").alias("id"), F.col("_headers").alias("headers"),
                        row["payload_digest"].alias("digest"))
    rows = rows.withColumn("_response", F.when(F.col("_full") & F.col("_url").isNotNull(), response))
    seen = carried_forward(rows, ["_at", "_full", "_id"], {"_last": "_response"}, ["_url"])
    mine, theirs = F.col("_headers"), F.col("_last.headers")
    both = lambda name: mine[name].isNotNull() & theirs[name].isNotNull()
    agrees = (F.when(both("etag"), _weak(mine["etag"]) == _weak(theirs["etag"]))
              .when(both("last-modified"), mine["last-modified"] == theirs["last-modified"])
              .otherwise(row["payload_digest"] == F.col("_last.digest")))
    revisit = row["warc_type"] == "revisit"
    outcome = (F.when(F.col("_full"), "response").when(~F.coalesce(revisit, F.lit(False)), "other")
               .when(F.col("_url").isNull() | F.col("_last").isNull(), "no_response")
               .when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("changed"))
    updates = F.map_filter(mine, lambda k, v: k.isin(*UPDATED_BY_REVISIT))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(updates, k))
    resolved = F.col("outcome") == "resolved"
    out = seen.withColumn("outcome", outcome).select(
        "_row", F.col("_url").alias("canonical_url"), "outcome",
        F.when(F.col("outcome").isin("resolved", "changed", "no_validator"), F.col("_last.id")).alias("refers_to"),
        F.when(resolved, F.col("_last.id")).when(F.col("outcome") == "response", F.col("_id")).alias("payload_of"),
        F.when(resolved, F.col("_last.digest")).when(F.col("outcome") == "response", row["payload_digest"])
        .alias("resolved_digest"),
        F.when(resolved, F.map_concat(kept, updates)).otherwise(mine).alias("merged_headers"))
    made = [c for c in out.columns if c != "_row"]
    return out.select(*[row[c].alias(c) for c in names if c not in made], *made)


def headers_text(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a response with its html, and a later revisit of the same URL.

    The crawl meets pages in ``page_id`` order, one a minute; the revisit follows after 1 to 7 hours and carries
    the validators of the html that the crawler saw first. A page whose URL was taken over by another page in
    between is a changed one."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    at = F.timestamp_seconds(F.lit(1700000000) + 60 * F.col("page_id"))
    hours = F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 4), 16, 10).cast("long") % 7 + 1
    later = F.timestamp_seconds(F.lit(1700000030) + 60 * F.col("page_id") + 3600 * hours)
    http_date = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("warc_type"),
        F.col("url").alias("target_uri"), at.alias("captured_at"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), length,
                     F.lit("date"), http_date(at), F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"'))).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"))
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"), later.alias("captured_at"), F.lit(304).alias("status"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), http_date(later), F.lit("cache-control"),
                     F.lit("max-age=3600"), F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"'))).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"))
    return first.unionByName(again)
