"""Resolution of WARC revisit records ("not modified") by an as-of join.

Records are keyed by canonical URL. A revisit takes the latest earlier full response of its key; it is resolved if the
validators that both carry agree: entity tags by the weak comparison, or without them the dates of last modification.
A resolved revisit has the response's payload, and the response's headers updated by its own as RFC 9111 (3.2) permits:
those that describe the body or the connection stay as stored.

The order of records is (date, record_id). A key's records are dealt out by ranges of date that hold about as many records
each, whatever the dates are, so that no task sees all of a hot key: the last response of each range is found first and
handed on to the later ranges, which are at most RANGES.

Null urls or dates resolve to nothing ("unknown"); null headers are empty. Revisits that repeat a record_id are resolved
each by its own url and date; of responses that repeat a record_id the one with the greatest checksum of url, date, headers
and carried columns counts. Without responses all are "unknown". Carried columns may have any name but those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

RANGES = 256
#: Header fields that a revisit does not replace.
STORED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical(url: Column) -> Column:
    """Host in lower case without www and default ports, path without slashes at the end, parameters in order without
    those that track; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r":(80|443)\z", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), r"/+\z", "")
    own = F.filter(F.split(F.regexp_extract(rest, r"[?](.*)\z", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)="))
    return F.concat(host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(own), "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """With names in lower case; of names that become one, the value of the greatest entry."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(kept)


def merged(stored: Column, fresh: Column) -> Column:
    own = F.map_filter(fresh, lambda k, _: ~k.isin(*STORED))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def agrees(stored: Column, fresh: Column) -> Column:
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    return F.coalesce(tag(stored) == tag(fresh), date(stored) == date(fresh), F.lit(False))


def resolve(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """record_id, key, target_id, state (resolved, changed, unknown), headers (map) and the target's columns in carry of
    every revisit. records: record_id, url, date (long), kind (response, revisit), headers, and the columns in carry."""
    order = F.struct("date", "record_id")
    inner = dict(zip(carry, fresh(*carry), strict=True))
    rows = records.select("record_id", canonical(F.col("url")).alias("key"), "date", "kind", lowered(F.col("headers")).alias("headers"), *[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    bounds = sorted({b for b in rows.approxQuantile("date", [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES)) if b is not None})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("date"))) if bounds else F.lit(0)
    narrow = rows.filter("key IS NOT NULL AND date IS NOT NULL").select("row", "record_id", "key", "date", "kind", part.alias("part"))
    response = F.when(F.col("kind") == "response", order)
    lasts = narrow.groupBy("key", "part").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("key", "part", F.max("last").over(earlier).alias("handed"))
    inside = Window.partitionBy("key", "part").orderBy("date", "record_id", F.col("kind") == "response", "row").rowsBetween(Window.unboundedPreceding, -1)
    found = narrow.select("*", F.max(response).over(inside).alias("own")).filter("kind = 'revisit'").join(lasts, ["key", "part"])
    found = found.select("row", F.coalesce("own.record_id", "handed.record_id").alias("target_id"))
    (digest,) = fresh("digest")
    checked = F.xxhash64("key", "date", F.to_json("headers"), *inner.values())
    needed = found.select("target_id").distinct()
    targets = rows.filter("kind = 'response'").join(needed, F.col("record_id") == F.col("target_id"), "left_semi").select(F.col("record_id").alias("target_id"), F.col("headers").alias("stored"), checked.alias(digest), *inner.values())
    best = targets.groupBy("target_id").agg(F.max(digest).alias(digest))  # of rows that repeat a record_id one
    targets = targets.join(best, ["target_id", digest]).dropDuplicates(["target_id"]).drop(digest)
    revisits = rows.filter("kind = 'revisit'").select("row", "record_id", "key", "headers")
    both = revisits.join(found, "row", "left").join(targets, "target_id", "left")
    state = F.when(F.col("target_id").isNull(), "unknown").when(agrees(F.col("stored"), F.col("headers")), "resolved").otherwise("changed")
    good = F.col("state") == "resolved"
    both = both.withColumn("state", state)
    return both.select("record_id", "key", "target_id", "state", F.when(good, merged(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), *[F.when(good, F.col(i)).alias(c) for c, i in inner.items()])


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response and, half a thousand seconds later, a revisit of its url: by page_id modulo 4 with
    the tag in its weak form, with the date alone, with another tag, or with both."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    page = F.coalesce("page_id", F.lit(0)).cast("long")
    modified = (page % 97).cast("string")
    base = pages.select(page.alias("page"), "page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_sha256"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_chars"), tag.alias("tag"), modified.alias("modified"))
    full = F.create_map(F.lit("ETag"), F.col("tag"), F.lit("Last-Modified"), F.col("modified"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Age"), F.lit("0"))
    dated = F.create_map(F.lit("Last-Modified"), F.col("modified"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("Age"), F.lit("500"))
    tagged = lambda t: F.create_map(F.lit("ETag"), t, F.lit("Age"), F.lit("500"))
    kind = F.col("page") % 4
    again = F.when(kind == 0, tagged(F.concat(F.lit("W/"), F.col("tag")))).when(kind == 1, dated).when(kind == 2, tagged(F.lit('"other"'))).otherwise(F.map_concat(tagged(F.col("tag")), F.create_map(F.lit("Last-Modified"), F.lit("0"))))
    first = base.select((F.col("page") * 2).alias("record_id"), "url", F.col("page").alias("date"), F.lit("response").alias("kind"), full.alias("headers"), "payload_sha256", "payload_chars")
    second = base.select((F.col("page") * 2 + 1).alias("record_id"), "url", (F.col("page") + 500).alias("date"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("payload_sha256"), F.lit(None).cast("long").alias("payload_chars"))
    return first.unionByName(second)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages")), ("payload_sha256", "payload_chars"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return found.select("record_id", "key", "target_id", "state", joined.alias("headers"), "payload_sha256", F.coalesce("payload_chars", F.lit(0)).alias("payload_chars"))


SQL = r"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(url, '#.*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), parts AS (
  SELECT *, regexp_extract(bare, '^[^/?]*') AS host, substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1) AS rest FROM bare
), pieces AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda p: p != '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS own,
         regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS stem FROM parts
), keyed AS (
  SELECT page_id, stem || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END AS key, html, '"' || md5(html) || '"' AS tag, CAST(page_id % 97 AS VARCHAR) AS modified FROM pieces
), met AS (
  SELECT v.*, r.page_id AS target, r.tag AS stored_tag, r.modified AS stored_modified, r.html AS stored_html
  FROM (SELECT *, page_id + 500 AS at FROM keyed) v ASOF LEFT JOIN keyed r ON v.key = r.key AND v.at >= r.page_id
), judged AS (
  SELECT *, CASE WHEN target IS NULL THEN 'unknown'
                 WHEN page_id % 4 IN (0, 3) AND stored_tag = tag OR page_id % 4 = 1 AND stored_modified = modified THEN 'resolved'
                 ELSE 'changed' END AS state FROM met
)
SELECT page_id * 2 + 1 AS record_id, key, target * 2 AS target_id, state,
  CASE WHEN state = 'resolved' THEN 'age: 500; content-type: text/html; etag: ' ||
            CASE page_id % 4 WHEN 0 THEN 'W/' || tag WHEN 1 THEN stored_tag ELSE tag END || '; last-modified: ' || CASE page_id % 4 WHEN 3 THEN '0' ELSE stored_modified END
       ELSE CASE page_id % 4 WHEN 0 THEN 'age: 500; etag: W/' || tag WHEN 1 THEN 'age: 500; content-type: text/plain; last-modified: ' || modified
            WHEN 2 THEN 'age: 500; etag: "other"' ELSE 'age: 500; etag: ' || tag || '; last-modified: 0' END END AS headers,
  CASE WHEN state = 'resolved' THEN sha256(stored_html) END AS payload_sha256,
  CASE WHEN state = 'resolved' THEN length(stored_html) ELSE 0 END AS payload_chars
FROM judged
"""
