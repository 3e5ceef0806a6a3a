"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response.

Records are rows; the payload stays where it is and is never sorted or moved: the join carries record ids,
validators and headers only. Time is cut into spans; a canonical URL, however often it was captured, is split
over its spans, and the state at each span's start is a running last over spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushgraph.session import table

# Headers that a 304 may update (RFC 9110, 15.4.5, and RFC 9111, 3.2); tracking parameters.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
FULL, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, the scheme's default port (80 without a scheme), fragment,
    tracking parameters and a trailing slash removed, the other parameters in order. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^((?i:http://)?[^/?]*):80(?=[/?]|$)", "$1"), r"^((?i:https)://[^/?]*):443(?=[/?]|$)", "$1")
    bare = F.regexp_replace(bare, r"^(?i:https?)://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """The map with its names in lower case; values of names that differ in case alone are joined in order by commas."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))

    def value(name: Column) -> Column:
        values = F.transform(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), lambda e: e["value"])
        return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.array_join(F.array_sort(values), ", "))

    return F.map_from_arrays(names, F.transform(names, value))


def resolve_revisits(records: DataFrame, *, span_seconds: int = 86_400) -> DataFrame:
    """One row for each revisit: (record_id, url_key, ts, verdict, response_id, response_ts, headers).

    records: record_id, url, ts (timestamp), type ('response' or 'revisit'), etag, last_modified (strings) and
    headers (a map; names in any case, as lower_names() has them). The answer to a revisit is the latest response of its canonical URL
    with an earlier time; of equal times, the one with the larger record_id. verdict: ``resolved``; ``mismatch`` where a
    validator that both carry differs (a weak ETag equals its strong form); ``unchecked`` where they share
    none; ``missing`` where there is no earlier response. headers: those of the response, updated by the
    permitted ones of the revisit, for resolved revisits, else null. Null url or ts: missing. Null maps count as
    empty. Repeated revisits give repeated rows; no revisits, no rows. Further columns are ignored.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    base = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("type") == FULL).alias("full"), "type", "etag", "last_modified", lower_names(F.coalesce("headers", empty)).alias("headers")
    ).filter(F.col("type").isin(FULL, REVISIT))
    base = base.withColumn("span", F.floor(F.unix_timestamp("ts") / span_seconds))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    answer = F.struct("record_id", "ts", "etag", "last_modified", "headers")
    some = base.filter(known).withColumn("answer", F.when(F.col("full"), answer))
    # A revisit at a response's own time is not later than it: revisits come first among equal times.
    order = Window.partitionBy("url_key", "span").orderBy("ts", "full", "record_id")
    within = some.withColumn("near", F.last("answer", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = some.filter("full").groupBy("url_key", "span").agg(F.max_by("answer", F.struct("ts", "record_id")).alias("end"))
    spans = some.select("url_key", "span").distinct().join(ends, ["url_key", "span"], "left")
    earlier = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("end", ignorenulls=True).over(earlier)).select("url_key", "span", "far")
    revisits = within.filter(~F.col("full")).join(carried, ["url_key", "span"]).withColumn("hit", F.coalesce("near", "far")).drop("near", "far", "answer")
    lost = base.filter(~known & ~F.col("full")).withColumn("hit", F.lit(None).cast(revisits.schema["hit"].dataType))
    revisits = revisits.select("record_id", "url_key", "ts", "etag", "last_modified", "headers", "hit").unionByName(lost.select("record_id", "url_key", "ts", "etag", "last_modified", "headers", "hit"))
    strong = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    same_tag = strong(F.col("etag")) == strong(F.col("hit.etag"))
    same_time = F.col("last_modified") == F.col("hit.last_modified")
    verdict = (
        F.when(F.col("hit").isNull(), "missing")
        .when((~same_tag) | (same_tag.isNull() & ~same_time), "mismatch")
        .when(same_tag.isNull() & same_time.isNull(), "unchecked")
        .otherwise("resolved")
    )
    out = revisits.withColumn("verdict", verdict)
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("hit.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, update))))
    return out.select("record_id", "url_key", "ts", "verdict", F.col("hit.record_id").alias("response_id"), F.col("hit.ts").alias("response_ts"), F.when(F.col("verdict") == "resolved", merged).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl over pages, three for each page, made from its id and content alone.

    Page p is captured in full p minutes after the start. 30 seconds earlier and one day later its URL is
    asked again and answered with 304: with the content's ETag; for every fifth page with another ETag; for
    every seventh without validator.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("tag"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    at = lambda s: (start + F.make_dt_interval(mins=F.col("page_id").cast("int"), secs=F.lit(s))).alias("ts")
    sent = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    none = F.lit(None).cast("string")

    def some(k: int, kind: str, seconds: int, etag: Column, *headers: Column) -> Column:
        values = [F.lit(k).cast("long").alias("k"), at(seconds), F.lit(kind).alias("type"), etag.cast("string").alias("etag"), none.alias("last_modified"), F.create_map(*headers).alias("headers")]
        return F.struct(*values)

    full = some(1, FULL, 0, F.col("tag"), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string"), F.lit("etag"), F.col("tag"))
    asked = [some(k, REVISIT, s, sent, F.lit("date"), F.lit(f"day {d}"), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit(f"max-age={60 * (d + 1)}")) for k, s, d in ((0, -30, 0), (2, 86_400, 1))]
    rows = base.select("page_id", "url", F.explode(F.array(asked[0], full, asked[1])).alias("r"))
    return rows.select((F.col("page_id") * 3 + F.col("r.k")).alias("record_id"), "url", F.col("r.ts").alias("ts"), F.col("r.type").alias("type"), F.col("r.etag").alias("etag"), F.col("r.last_modified").alias("last_modified"), F.col("r.headers").alias("headers"))


def op5_resolved_revisits(spark, sf_dir):
    """All pages as a crawl with revisits; every revisit resolved, its merged headers as text."""
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    told = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select("record_id", "url_key", "verdict", "response_id", told.alias("headers"))


OP5_SQL = r"""
WITH base AS (
  SELECT page_id, url, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag, length(coalesce(html, '')) AS size,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^((?i:http://)?[^/?]*):80([/?]|$)', '\1\2'), '^((?i:https)://[^/?]*):443([/?]|$)', '\1\2'), '^(?i:https?)://', '') AS bare FROM pages),
cut AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', '') AS host, regexp_replace(bare, '^[^/?]*', '') AS rest FROM base),
parts AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS path,
                 list_sort([p FOR p IN string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*\?', '') ELSE '' END, '&')
                   IF p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref')]) AS kept FROM cut),
keyed AS (SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key,
                 CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE tag END AS sent FROM parts),
asked AS (SELECT page_id * 3 AS record_id, url_key, page_id * 60 - 30 AS t, sent, 0 AS d FROM keyed UNION ALL SELECT page_id * 3 + 2, url_key, page_id * 60 + 86400, sent, 1 FROM keyed),
ranked AS (
  SELECT a.record_id, a.url_key, a.sent, a.d, f.page_id, f.tag, f.size,
         row_number() OVER (PARTITION BY a.record_id, a.url_key ORDER BY f.page_id DESC) AS nth
  FROM asked a LEFT JOIN keyed f ON f.url_key = a.url_key AND f.page_id * 60 < a.t)
SELECT record_id, url_key, CASE WHEN page_id IS NULL THEN 'missing' WHEN sent IS NULL THEN 'unchecked' WHEN sent = tag THEN 'resolved' ELSE 'mismatch' END AS verdict,
       page_id * 3 + 1 AS response_id,
       CASE WHEN page_id IS NOT NULL AND sent = tag THEN 'cache-control: max-age=' || (60 * (d + 1)) || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || d || chr(10) || 'etag: ' || tag END AS headers
FROM ranked WHERE nth = 1
"""
