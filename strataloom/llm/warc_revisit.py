"""WARC revisits: each not-modified record gets the latest earlier full response of its canonical url.

The as-of join runs in time slots, so that a url that holds a third of all records is spread over its slots: the
last full response of each (url, slot) is a partially aggregated maximum; a window over a url's slots, a row a
slot, carries it on; and the records of one slot find theirs by a window over (url, slot). A slot is `slot_s`
seconds long.

A revisit is resolved when an earlier response exists and its validators agree: equal etag (weak comparison)
where both have one, else equal last-modified, else equal payload digest. Its headers are the response's,
replaced by those that a not-modified answer may carry. Of responses at one time the largest record_id counts, of
several rows of one id and time the one with the largest etag, then date, digest and headers (nulls first);
a response at the revisit's own time is not earlier. Null urls and times resolve to nothing; repeated rows are
resolved each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_S = 86_400
#: Fixed: header fields that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
FIELDS = ["record_id", "url", "kind", "at_s", "etag", "last_modified", "digest", "headers"]


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased, http as https, no www., default port, fragment, tracking query or closing slash."""
    url = F.regexp_replace(url, "#.*$", "")
    head, tail = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(head, "^http://", "https://"), "^https://www[.]", "https://")
    tail = F.regexp_replace(tail, r"([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "&{2,}", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(F.regexp_replace(head, ":(?:80|443)$", ""), F.regexp_replace(tail, "/+$", ""))


def resolve(records: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """One row a revisit: record_id, key, at_s, status, response_id, response_at_s, headers.

    records: record_id long, url string, kind (response or revisit), at_s long, etag, last_modified, digest
    strings, headers map<string,string> with lower-case names.
    """
    rows = records.select(*FIELDS).withColumns({"key": canonical(F.col("url")), "slot": F.floor(F.col("at_s") / slot_s)})
    full = F.when(F.col("kind") == "response", F.struct("at_s", "record_id", "etag", "last_modified", "digest", "headers"))
    rank = F.when((F.col("kind") == "response") & F.col("at_s").isNotNull() & F.col("key").isNotNull(), F.struct("at_s", "record_id"))
    # what is left to tell responses of one id and time apart; the header map itself has no order
    content = F.struct("etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("h"))
    slots = rows.groupBy("key", "slot").agg(F.max_by(full, F.when(rank.isNotNull(), F.struct(rank.alias("rank"), content.alias("content")))).alias("last"))
    carried = slots.select("key", "slot", F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    # inside a slot, strictly earlier in time
    w = Window.partitionBy("key", "slot").orderBy("at_s").rangeBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.max(rank).over(w)).filter("kind = 'revisit'").drop("headers_of")
    found = inner.join(carried, (inner.key == carried.key) & (inner.slot == carried.slot), "left").select(inner["*"], "before")
    # fetch the response of the same slot by its id; one of an earlier slot came along
    responses = rows.filter("kind = 'response'").select(F.col("key").alias("k"), F.col("at_s").alias("t"), F.col("record_id").alias("r"), full.alias("own"), content.alias("c")).groupBy("k", "t", "r").agg(F.max_by("own", "c").alias("own"))
    found = found.join(responses, (F.col("inner.at_s") == F.col("t")) & (F.col("inner.record_id") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    base = F.coalesce("own", "before")
    return found.withColumn("base", base).select(
        "record_id", "key", "at_s", status(F.col("base")).alias("status"), F.col("base.record_id").alias("response_id"), F.col("base.at_s").alias("response_at_s"),
        F.when(status(F.col("base")) == "resolved", merged(F.col("base.headers"), F.col("headers"))).alias("headers"),
    )


def status(base: Column) -> Column:
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    etags = F.col("etag").isNotNull() & base["etag"].isNotNull()
    dates = F.col("last_modified").isNotNull() & base["last_modified"].isNotNull()
    agree = F.when(etags, bare(F.col("etag")) == bare(base["etag"])).when(dates, F.col("last_modified") == base["last_modified"]).otherwise(F.coalesce(F.col("digest") == base["digest"], F.lit(False)))
    return F.when(base.isNull(), "no earlier response").when(agree, "resolved").otherwise("validators differ")


def merged(old: Column, new: Column) -> Column:
    """The response's headers, with the permitted ones of the revisit in their place."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    update = F.map_filter(new, lambda k, v: k.isin(list(PERMITTED)))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(update, k)), update)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures as a crawl over several days would hold them, from a table of pages.

    Every page is a response at page_id minutes; a day later (two for every fifth page) it is asked again, and
    two of three times the answer is not-modified. Every seventh such answer names another etag; pages
    that divide by 4 send no etag but a last-modified date, those that divide by 8 only a digest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("digest"))
    i, t = F.col("page_id"), F.col("page_id") * 60
    etag = F.when(i % 4 != 0, F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    dated = F.when((i % 4 == 0) & (i % 8 != 0), F.concat(F.lit("day "), F.floor(t / SLOT_S).cast("string")))
    first = p.select(
        (2 * i).alias("record_id"), "url", F.lit("response").alias("kind"), t.alias("at_s"), etag.alias("etag"), dated.alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), t.cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    again = t + F.when(i % 5 == 0, 2 * SLOT_S).otherwise(SLOT_S)
    second = p.filter(i % 3 != 0).select(
        (2 * i + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"), again.alias("at_s"), F.when(i % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag)).alias("etag"), dated.alias("last_modified"), "digest",
        F.create_map(F.lit("date"), again.cast("string"), F.lit("content-type"), F.lit("text/plain")).alias("headers"),
    )
    return first.unionByName(second)


def digest(found: DataFrame) -> DataFrame:
    """Headers as one sorted string, for comparing."""
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", F.col("key").alias("canonical_url"), "at_s", "status", "response_id", "response_at_s", joined.alias("merged_headers"))


CANONICAL_SQL = """regexp_replace({head}, ':(80|443)$', '') || regexp_replace({tail}, '/+$', '')""".format(
    head="regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '^http://', 'https://'), '^https://www[.]', 'https://')",
    tail="regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '([?&])(?:utm_[a-z]+|ref)=[^&]*', '\\1', 'g'), '&{2,}', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', '')",
)
#: The query over records_of_pages in DuckDB SQL.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id AS i, page_id * 60 AS t, regexp_replace(url, '#.*$', '') AS u, md5(coalesce(html, '')) AS digest FROM pages),
c AS (SELECT i, t, {CANONICAL_SQL} AS key, digest, CASE WHEN i % 4 <> 0 THEN '"' || substr(digest, 1, 16) || '"' END AS etag,
 CASE WHEN i % 4 = 0 AND i % 8 <> 0 THEN 'day ' || CAST(t // {SLOT_S} AS VARCHAR) END AS dated FROM p),
v AS (SELECT 2 * i + 1 AS record_id, key, t + CASE WHEN i % 5 = 0 THEN {2 * SLOT_S} ELSE {SLOT_S} END AS at_s, CASE WHEN i % 7 = 0 THEN '"other"' ELSE etag END AS etag, dated, digest FROM c WHERE i % 3 <> 0),
j AS (SELECT v.*, c.i AS ri, c.t AS rt, c.etag AS retag, c.dated AS rdated, c.digest AS rdigest,
 row_number() OVER (PARTITION BY v.record_id ORDER BY c.t DESC NULLS LAST, c.i DESC) AS n FROM v LEFT JOIN c ON c.key = v.key AND c.t < v.at_s),
s AS (SELECT *, CASE WHEN ri IS NULL THEN 'no earlier response' WHEN CASE WHEN etag IS NOT NULL AND retag IS NOT NULL THEN etag = retag
 WHEN dated IS NOT NULL AND rdated IS NOT NULL THEN dated = rdated ELSE digest = rdigest END THEN 'resolved' ELSE 'validators differ' END AS status FROM j WHERE n = 1)
SELECT record_id, key AS canonical_url, at_s, status, 2 * ri AS response_id, rt AS response_at_s,
 CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=' || CAST(at_s AS VARCHAR) END AS merged_headers FROM s"""
