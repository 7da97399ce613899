"""Not-modified revisits, resolved against the latest earlier full response.

The as-of join goes by canonical URL and time. Time is cut into spans; the last
response of each URL and span is aggregated first, a window over these few rows
carries it on to later spans, and a record looks up the rest within its own
span. So no task gathers the history of a URL, however often it was captured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time units of one span of the as-of join.
SPAN = 1 << 16
#: Fields of a 304 response that do not replace those stored.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and port, path without its last slash, query sorted without utm_ fields.

    Scheme and fragment go. Null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":[0-9]+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&", -1), lambda f: (f != "") & ~f.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit: record_id, url_key, response_id, outcome and headers.

    records has record_id (long), url, ts (long), kind ("response" or "revisit"),
    etag, last_modified and headers (map of lower-case names). The latest
    response at an earlier time counts; of equal times the largest record_id.
    outcome is "resolved" if the entity tags agree or, where either is lacking,
    the dates of modification do not disagree; "mismatch" if they do; "missing"
    without an earlier response, or without a URL or time. headers are those of
    the response, replaced by the revisit's where a 304 response may. Repeated
    revisits are resolved one by one; null maps count as empty. Other columns are
    not looked at, and a table without revisits gives an empty result.
    """
    r = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    r = r.withColumns({"url_key": canonical_url(F.col("url")), "slot": F.floor(F.col("ts") / span)})
    body = F.struct("ts", "record_id", "etag", "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    responses = r.where("kind = 'response' and url_key is not null and ts is not null").select("url_key", "slot", "ts", "record_id", body.alias("found"))
    asked = r.where("kind = 'revisit'")
    # Without URL or time there is nothing to look up; such rows stay out of the windows, where they would meet in one task.
    lost = asked.where("url_key is null or ts is null").select("record_id", "url_key", F.lit(None).cast("long").alias("response_id"), F.lit("missing").alias("outcome"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    revisits = asked.where("url_key is not null and ts is not null")
    # Last response of a span: the map in the struct has no order, so time and id choose it.
    last = responses.groupBy("url_key", "slot").agg(F.max_by("found", F.struct("ts", "record_id")).alias("last"))
    slots = last.select("url_key", "slot", "last").unionByName(revisits.select("url_key", "slot").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    slots = slots.groupBy("url_key", "slot").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("url_key", "slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # Responses come after revisits of equal time, as they are not earlier.
    rows = responses.select("url_key", "slot", "ts", F.lit(1).alias("late"), "record_id", "found", F.lit(None).cast("struct<etag:string,last_modified:string,headers:map<string,string>>").alias("own")).unionByName(
        revisits.select("url_key", "slot", "ts", F.lit(0).alias("late"), "record_id", F.lit(None).cast(last.schema["last"].dataType).alias("found"), F.struct("etag", "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")).alias("own"))
    )
    within = Window.partitionBy("url_key", "slot").orderBy("ts", "late", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("found", ignorenulls=True).over(within)).where("late = 0").select("url_key", "slot", "ts", "record_id", "own", "near")
    joined = near.join(carried, ["url_key", "slot"], "left").withColumn("hit", F.coalesce("near", "carried"))
    tags = F.col("own.etag").isNotNull() & F.col("hit.etag").isNotNull()
    agree = F.when(tags, F.col("own.etag") == F.col("hit.etag")).otherwise(F.coalesce(F.col("own.last_modified") == F.col("hit.last_modified"), F.lit(True)))
    outcome = F.when(F.col("hit").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    may = F.map_filter("own.headers", lambda k, v: ~F.lower(k).isin(*KEPT_HEADERS))
    stays = F.map_filter("hit.headers", lambda k, v: ~F.map_contains_key(may, k))
    resolved = joined.withColumn("outcome", outcome)
    found = resolved.select("record_id", "url_key", F.when(F.col("outcome") == "resolved", F.col("hit.record_id")).alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(stays, may)).otherwise(F.col("own.headers")).alias("headers"))
    return found.unionByName(lost)


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made of the pages table: each page as a full response and, some time later, a revisit of it.

    Page p answers at 10 p; it is asked again at 10 p + 5 + 10,000 (p mod 7), so other captures of its canonical
    URL may lie between. Both carry a digest of the page as entity tag; the revisit also tells its date and length.
    """
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 8)
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), size, F.lit("etag"), tag, F.lit("date"), (F.col("page_id") * 10).cast("string")).alias("headers"),
    )
    at = F.col("page_id") * 10 + 5 + F.pmod("page_id", F.lit(7)) * 10_000
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", at.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), at.cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)


def resolved_pages(pages: DataFrame) -> DataFrame:
    """record_id, url_key, response_id, outcome and headers (as text, by name) of the revisits of all pages."""
    done = resolve_revisits(page_records(pages))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.select("record_id", "url_key", "response_id", "outcome", listed.alias("headers"))


RESOLVED_SQL = r"""
WITH a AS (SELECT page_id, substr(md5(coalesce(html, '')), 1, 8) AS tag, length(coalesce(html, '')) AS size,
             regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
b AS (SELECT page_id, tag, size, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':[0-9]+$', ''), '^www\.', '')
             || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT starts_with(f, 'utm_'))) AS fields, rest FROM a),
u AS (SELECT page_id, tag, size, CASE WHEN rest IS NULL THEN NULL ELSE stem || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS url_key FROM b),
v AS (SELECT page_id, tag, url_key, page_id * 10 + 5 + (page_id % 7) * 10000 AS ts FROM u),
h AS (SELECT v.page_id, v.url_key, v.tag, v.ts, arg_max(u.page_id, (u.page_id * 10, u.page_id)) AS resp FROM v LEFT JOIN u ON u.url_key = v.url_key AND u.page_id * 10 < v.ts GROUP BY ALL)
SELECT h.page_id * 2 + 1 AS record_id, h.url_key, CASE WHEN u.tag = h.tag THEN h.resp * 2 END AS response_id,
       CASE WHEN h.resp IS NULL THEN 'missing' WHEN u.tag = h.tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN u.tag = h.tag THEN 'content-length=' || u.size || ';date=' || h.ts || ';etag=' || u.tag ELSE 'content-length=0;date=' || h.ts END AS headers
FROM h LEFT JOIN u ON u.page_id = h.resp
"""
