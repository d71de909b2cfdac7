"""Not-modified revisits of web records resolved by an as-of join.

A revisit (status 304) takes its body from the latest full response (status 200)
of the same canonical URL that is strictly earlier; of equal times the greater
record id counts as later. It counts only if the revisit's validators agree with
that response: the entity tag if the revisit has one (weak comparison, without
`W/`), else Last-Modified. Headers are then merged: the response's, replaced by the
revisit's where PERMITTED. Bodies don't move: the result names the record.

The join deals records to (URL, range of time). The last response in each range is
carried over the ranges by a table with a row for each URL and range, so that a URL
with very many captures is spread over all ranges.

Outcomes: etag, last-modified (resolved); mismatch (validators disagree);
no-validator (the revisit has none, or the response lacks it); missing (no earlier
response). Null URLs have the canonical URL '' and form one URL; a null time sorts
first and has nothing earlier; a null header is absent; rows that repeat are
resolved each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.url_rules import LOWER, UPPER
from loomtally.operators.ordered import default_ranges, range_bounds, range_of

#: Headers that a not-modified response may update, and parameters that don't name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, leading `www.`, tracking parameters and
    closing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"(?s)^([^/?]*)", 1)
    rest = F.substring(bare, F.length(host) + 1, 2147483647)
    host = F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, LOWER), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """records: record_id, url, ts (long), status, headers (map, lower-case names). One row
    for each revisit: record_id, canonical_url, ts, resolved_id, outcome, headers."""
    rows = records.where(F.col("status").isin(200, 304)).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", (F.col("status") == 200).alias("full"), "headers")
    dealt = rows.withColumn("_range", range_of(F.col("ts"), range_bounds(rows, "ts", ranges or default_ranges(records))))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "headers"))
    last = dealt.where("full").groupBy("canonical_url", "_range").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct(F.col("ts").isNotNull().alias("k"), "ts", "record_id")).alias("_last"))
    carried = dealt.select("canonical_url", "_range").distinct().join(last, ["canonical_url", "_range"], "left")
    before = Window.partitionBy("canonical_url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(F.col("canonical_url").alias("_url"), F.col("_range").alias("_at"), "_carried")
    # revisits stand before the responses of their time, which are not earlier
    within = Window.partitionBy("canonical_url", "_range").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        dealt.withColumn("_inside", F.last(response, ignorenulls=True).over(within))
        .where(~F.col("full"))
        .join(carried, (F.col("canonical_url") == F.col("_url")) & (F.col("_range") == F.col("_at")), "left")
        .withColumn("_from", F.coalesce("_inside", "_carried"))
    )
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    etag, seen_etag = F.col("headers")["etag"], F.col("_from.headers")["etag"]
    time, seen_time = F.col("headers")["last-modified"], F.col("_from.headers")["last-modified"]
    outcome = (
        F.when(F.col("_from").isNull(), "missing")
        .when(etag.isNotNull() & seen_etag.isNotNull(), F.when(bare(etag) == bare(seen_etag), "etag").otherwise("mismatch"))
        .when(etag.isNull() & time.isNotNull() & seen_time.isNotNull(), F.when(time == seen_time, "last-modified").otherwise("mismatch"))
        .otherwise("no-validator")
    )
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.col("_from.headers"), lambda k, v: ~F.map_contains_key(F.col("_update"), k) & v.isNotNull())
    return (
        found.withColumn("outcome", outcome)
        .withColumn("_update", F.coalesce(update, F.create_map().cast("map<string,string>")))
        .withColumn("_ok", F.col("outcome").isin("etag", "last-modified"))
        .select(
            "record_id", "canonical_url", "ts",
            F.when(F.col("_ok"), F.col("_from.record_id")).alias("resolved_id"),
            "outcome",
            F.when(F.col("_ok"), F.map_concat("_update", F.coalesce(kept, F.create_map().cast("map<string,string>")))).otherwise(F.col("headers")).alias("headers"),
        )
    )


def page_records(pages: DataFrame, later: int = 1000) -> DataFrame:
    """Two records for every page: its full response at time page_id (record 2 page_id),
    and a revisit `later` than it (record 2 page_id + 1) that carries the entity tag,
    or for every third page Last-Modified alone."""
    tag, id_ = F.md5(F.coalesce("html", F.lit(""))), F.col("page_id")
    base = pages.select("page_id", "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    full = F.struct(
        (2 * id_).alias("record_id"), id_.alias("ts"), F.lit(200).alias("status"),
        F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("etag", "last-modified", "date", "content-length", "cache-control")]),
            F.array(F.col("tag"), id_.cast("string"), id_.cast("string"), F.col("bytes").cast("string"), F.lit("max-age=60")),
        ).alias("headers"),
    )
    again = F.struct(
        (2 * id_ + 1).alias("record_id"), (id_ + later).alias("ts"), F.lit(304).alias("status"),
        F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("etag", "last-modified", "date", "content-length")]),
            F.array(F.when(id_ % 3 != 2, F.concat(F.lit("W/"), F.col("tag"))), id_.cast("string"), (id_ + later).cast("string"), F.lit("0")),
        ).alias("headers"),
    )
    return base.select("url", F.explode(F.array(full, again)).alias("r")).select("url", "r.*")
