"""Not-modified revisits of web archives, resolved to the responses that they confirm.

Each revisit is joined as of its time to the latest strictly earlier full response of the same
canonical URL. Its validators are checked against the response's: entity tags first, compared
weakly, else modification dates. Of a revisit that agrees, the headers that a not-modified answer
may update replace those of the response; all others stay the response's.

The as-of join takes no URL into one task: records are split into range partitions by URL and
time, each looks back in its own rows, and what a URL had last in earlier partitions, one row for
each, is carried forward.

Outcomes: resolved; unverified (the revisit has no validator, so nothing is merged but the
response is named); mismatch (validators differ; nothing is merged); missing (no earlier
response). Cases: records with a null url or time match nothing and revisits among them are
missing; of responses at one time the one with the larger record_id is the later; repeated
revisits are each resolved; a null header map is empty; very long urls and headers are only read
and copied; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import blocks

# Header fields that a 304 answer may carry to update a stored response (HTTP semantics).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that only track visits.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "sessionid", "phpsessid", "jsessionid")
LAG = 5000


def canonical(url: Column) -> Column:
    """Host and path in one spelling: no scheme, fragment, default port, leading www., closing slash or tracking; parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i:https?)://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{'|'.join(TRACKING)})(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """(record_id, url, ts, kind, headers) with kind response or revisit and headers by lower-case name ->
    for each revisit: record_id, url_key, outcome, response_id and the merged headers."""
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    kept = records.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").alias("full"), headers.alias("headers"))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    order = [F.col("ts"), F.col("full"), F.col("record_id")]  # a revisit comes before a response of its own time
    cut = blocks(kept, [F.col("url_key"), *order])
    answer = F.when(F.col("full") & usable, F.struct("record_id", "headers"))
    carried = cut.where(F.col("full") & usable).groupBy("url_key", "__blk").agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("__last"))
    places = cut.where(usable).select("url_key", "__blk").distinct().join(carried, ["url_key", "__blk"], "left")
    before = Window.partitionBy("url_key").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select(F.col("url_key").alias("__u"), F.col("__blk").alias("__b"), F.last("__last", ignorenulls=True).over(before).alias("__earlier"))
    inside = Window.partitionBy("__blk", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("__own", F.last(answer, ignorenulls=True).over(inside)).where(~F.col("full") | F.col("full").isNull())
    joined = seen.join(places, (F.col("__blk") == F.col("__b")) & (F.col("url_key") == F.col("__u")), "left")
    found = F.when(usable, F.coalesce("__own", "__earlier"))
    out = joined.select("record_id", "url_key", F.col("headers").alias("__h"), found.alias("__r"))
    h, r = F.col("__h"), F.col("__r.headers")
    tagged, dated = h["etag"].isNotNull(), h["last-modified"].isNotNull()
    agree = F.when(tagged, F.coalesce(_tag(h["etag"]) == _tag(r["etag"]), F.lit(False))).otherwise(F.coalesce(h["last-modified"] == r["last-modified"], F.lit(False)))
    outcome = F.when(F.col("__r").isNull(), "missing").when(~tagged & ~dated, "unverified").when(agree, "resolved").otherwise("mismatch")
    allowed = F.map_filter(h, lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(r, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)
    out = out.withColumn("outcome", outcome)
    return out.select("record_id", "url_key", "outcome", F.col("__r.record_id").alias("response_id"), F.when(F.col("outcome") == "resolved", merged).when(F.col("__r").isNotNull(), r).alias("headers"))


def records_of(pages: DataFrame, lag: int = LAG) -> DataFrame:
    """Archive records of a table of pages, which has no times and headers of its own.

    A page is a response at the time 2 * page_id, with an entity tag and a date of modification that its content gives. It
    is asked for again after, and sometimes before, a number of pages that the first eight hexadecimal digits of the MD5 of
    its id give: x mod 4 of 0 asks 32 * lag + 1 later, with 1 it is 33 later, with 2 it is 1 later, and with 3 it is 1
    before. x // 4 mod 5 gives the validators: 0 its own tag and date, 1 its date alone, 2 a tag that changed, 3 a date that
    changed, 4 none.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    dated = F.concat(F.lit("day "), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 2))
    x = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    base = pages.select("page_id", "url", tag.alias("tag"), dated.alias("dated"), (x % 4).alias("when"), (F.floor(x / 4) % 5).alias("how"))
    ts, text = 2 * F.col("page_id"), F.lit
    later = ts + F.when(F.col("when") == 0, 32 * lag + 1).when(F.col("when") == 1, 33).when(F.col("when") == 2, 1).otherwise(-1)
    none = text(None).cast("string")
    etag = F.when(F.col("how") == 0, F.concat(text("W/"), F.col("tag"))).when(F.col("how") == 2, text('"changed"')).otherwise(none)
    modified = F.when(F.col("how") <= 1, F.col("dated")).when(F.col("how") == 3, text("day changed")).otherwise(none)
    given = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(text(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda e: e["v"].isNotNull()))
    response = F.struct(ts.alias("ts"), text("response").alias("kind"), given(("cache-control", text("max-age=60")), ("content-type", text("text/html")), ("date", ts.cast("string")), ("etag", F.col("tag")), ("last-modified", F.col("dated"))).alias("headers"))
    revisit = F.struct(later.alias("ts"), text("revisit").alias("kind"), given(("cache-control", text("max-age=120")), ("content-type", text("text/plain")), ("date", later.cast("string")), ("etag", etag), ("last-modified", modified)).alias("headers"))
    both = base.select("page_id", "url", F.explode(F.array(response, revisit)).alias("r"))
    return both.select(F.col("page_id").alias("record_id"), "url", "r.ts", "r.kind", "r.headers")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """resolve() over the records of pages, headers as one string in order of name."""
    out = resolve(records_of(pages))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return out.select("record_id", "url_key", "outcome", "response_id", shown.alias("headers"))


SQL = r"""
WITH b AS (SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || substr(md5(coalesce(html, '')), 1, 2) AS dated, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS x,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') AS bare FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS kept FROM b),
c AS (SELECT page_id, tag, dated, x % 4 AS asked_when, x // 4 % 5 AS how, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM q),
r AS (SELECT url_key, 2 * page_id AS ts, page_id, tag, dated FROM c),
v AS (SELECT url_key, 2 * page_id + CASE asked_when WHEN 0 THEN 160001 WHEN 1 THEN 33 WHEN 2 THEN 1 ELSE -1 END AS ts, page_id, CASE how WHEN 0 THEN tag WHEN 2 THEN '"changed"' END AS asked_tag, CASE WHEN how <= 1 THEN dated WHEN how = 3 THEN 'day changed' END AS asked_date, how FROM c),
j AS (SELECT v.page_id AS record_id, v.url_key, v.ts AS asked_ts, how, asked_tag, asked_date, r.ts AS was, r.page_id AS response_id, r.tag, r.dated FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.ts > r.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN how = 4 THEN 'unverified' WHEN CASE WHEN asked_tag IS NOT NULL THEN asked_tag = tag ELSE asked_date = dated END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT record_id, url_key, outcome, response_id,
       CASE WHEN response_id IS NULL THEN NULL
            WHEN outcome = 'resolved' THEN 'cache-control=max-age=120; content-type=text/html; date=' || asked_ts || '; etag=' || CASE WHEN asked_tag IS NULL THEN tag ELSE 'W/' || asked_tag END || '; last-modified=' || asked_date
            ELSE 'cache-control=max-age=60; content-type=text/html; date=' || was || '; etag=' || tag || '; last-modified=' || dated END AS headers FROM o
"""
