"""Not-modified revisits of WARC captures.

records: record_id, url, ts (long), kind ("response" or "revisit"), etag, last_modified,
headers (map), payload. Each revisit is joined as of its time, by canonical URL, to the
latest full response that is strictly earlier (equal times: the larger record_id). The
validators of both are then compared: entity tags if both have one (weak comparison),
else the dates of last modification. A revisit that agrees is resolved: it gets the
payload of the response and its headers, updated by those headers of the revisit that a
304 answer may update.

The as-of join moves keys and times only. It is a window over each URL and time bucket of
BUCKET units, and one over the last responses of a URL's buckets, so that a URL with a
large share of all captures is divided by time. Headers and payloads are joined by
record_id at the end.

Defined cases: records with a null url, ts, record_id or unknown kind are left out; a
revisit without an earlier response is "no_response", with validators that differ
"mismatch", without two comparable ones "no_validator", and these three get no payload and
their own headers; null headers are empty; header names are compared in lower case, of
repeated names the last counts; of the rows of a record_id one counts, whole: the earliest,
then by kind, URL, validators and a hash of headers and payload; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import stored, table

BUCKET = 4096
#: Headers that describe the body or the connection; a 304 answer does not update them.
KEPT = "connection content-encoding content-length content-md5 content-range content-type keep-alive proxy-authenticate proxy-connection te trailer transfer-encoding upgrade".split()
#: Fixed value: query parameters that do not tell pages apart.
TRACKING = "^(utm_[^=]*|gclid|fbclid|phpsessid|jsessionid|sid)(=|$)"


def canonical(url: Column) -> Column:
    """Host without www and default port in lower case, path without a final slash, sorted query without tracking."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.sort_array(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def _named(headers: Column) -> Column:
    """Headers as an array of name and value, names in lower case, the last of each name."""
    entries = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e.key).alias("name"), e.value.alias("value")))
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]))


def merged(old: Column, new: Column) -> Column:
    """old with what new may update, sorted by name; both arrays of name and value."""
    updates = F.filter(new, lambda e: ~e["name"].isin(KEPT))
    stay = F.filter(old, lambda e: ~F.exists(updates, lambda u: u["name"] == e["name"]))
    return F.sort_array(F.concat(stay, updates))


def latest_earlier(slim: DataFrame) -> DataFrame:
    """slim: key, ts, record_id, kind -> record_id of each revisit, response_id (null if none)."""
    rows = slim.withColumn("bucket", F.floor(F.col("ts") / BUCKET)).withColumn("full", F.when(F.col("kind") == "response", F.struct("ts", "record_id")))
    lasts = rows.groupBy("key", "bucket").agg(F.max("full").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("key", "bucket", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max("full").over(within)).filter(F.col("kind") == "revisit")
    return rows.join(lasts, ["key", "bucket"]).select("record_id", F.coalesce("near", "carried").getField("record_id").alias("response_id"))


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, key, response_id, status, headers (array of name and value), payload."""
    known = records.filter(F.col("record_id").isNotNull() & F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("response", "revisit"))
    entries = F.sort_array(F.coalesce(F.map_entries("headers"), F.array().cast("array<struct<key:string,value:string>>")))
    known = known.withColumn("mark", F.xxhash64(entries, "payload", "url"))
    # One whole row of each record_id; what is left of it later is found by record_id and mark.
    fields = F.struct("ts", "kind", canonical(F.col("url")).alias("key"), "etag", "last_modified", "mark")
    slim = stored(known.groupBy("record_id").agg(F.min(fields).alias("row")).select("record_id", "row.*"))
    found = latest_earlier(slim.select("key", "ts", "record_id", "kind"))
    tag = lambda side: F.regexp_replace(F.col(f"{side}.etag"), "^W/", "")
    revisits = slim.filter(F.col("kind") == "revisit").join(found, "record_id").alias("v")
    both = revisits.join(slim.filter(F.col("kind") == "response").alias("r"), F.col("v.response_id") == F.col("r.record_id"), "left")
    same = F.coalesce(tag("v") == tag("r"), F.col("v.last_modified") == F.col("r.last_modified"))
    status = F.when(F.col("r.record_id").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    judged = stored(both.select("v.record_id", "v.mark", "v.key", F.col("v.response_id").alias("response_id"), F.col("r.mark").alias("response_mark"), status.alias("status")))
    own = known.filter(F.col("kind") == "revisit").select("record_id", "mark", _named(F.col("headers")).alias("own")).dropDuplicates(["record_id", "mark"])
    full = known.filter(F.col("kind") == "response").select(F.col("record_id").alias("source"), F.col("mark").alias("source_mark"), _named(F.col("headers")).alias("old"), "payload").dropDuplicates(["source", "source_mark"])
    rows = judged.join(own, ["record_id", "mark"])
    # Only what is resolved is joined to its response: the others have no source, and nulls would meet in one task.
    good = rows.filter(F.col("status") == "resolved").join(full, (F.col("response_id") == F.col("source")) & (F.col("response_mark") == F.col("source_mark")))
    good = good.select("record_id", "key", "response_id", "status", merged(F.col("old"), F.col("own")).alias("headers"), "payload")
    rest = rows.filter(F.col("status") != "resolved").select("record_id", "key", "response_id", "status", F.sort_array("own").alias("headers"), F.lit(None).cast(dict(records.dtypes)["payload"]).alias("payload"))
    return good.union(rest)


def captures(pages: DataFrame) -> DataFrame:
    """Two records a page: its response, and a later revisit of the same URL.

    The tables hold no revisits, so the validators vary by page_id: most agree, some revisits
    carry another tag, some only a date, some nothing.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.col("page_id") * 10
    date = at.cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), date, F.lit("Server"), F.lit("origin")).alias("headers"), F.col("html").alias("payload"),
    )
    later = at + 1_000_005
    case = F.pmod("page_id", F.lit(11))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(case < 7, F.concat(F.lit("W/"), tag)).when(case == 7, F.lit('"other"')).alias("etag"), F.when(case < 10, date).alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("DATE"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat_ws(":", h["name"], h["value"])), ";")
    return found.select("record_id", F.col("key").alias("canonical_url"), "response_id", "status", lines.alias("headers"), F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


ORACLE_SQL = r"""
WITH p AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|phpsessid|jsessionid|sid)(=|$)'))) AS parts FROM p),
k AS (SELECT page_id, html, md5(html) AS tag, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[0-9]*\.', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS key FROM q),
v AS (SELECT *, page_id * 10 + 1000005 AS ts FROM k),
j AS (SELECT v.*, r.page_id AS rid, r.tag AS rtag, r.html AS rhtml,
  row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS rn
  FROM v LEFT JOIN k r ON r.key = v.key AND r.page_id * 10 < v.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN page_id % 11 < 7 THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END
  WHEN page_id % 11 = 7 THEN 'mismatch' WHEN page_id % 11 < 10 THEN CASE WHEN page_id = rid THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS status FROM j WHERE rn = 1)
SELECT page_id * 2 + 1 AS record_id, key AS canonical_url, rid * 2 AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control:max-age=60;content-type:text/html;date:' || ts || ';etag:"' || rtag || '";server:origin'
  ELSE 'cache-control:max-age=60;content-type:text/plain;date:' || ts END AS headers,
  CASE WHEN status = 'resolved' THEN length(rhtml) END AS payload_chars, CASE WHEN status = 'resolved' THEN rtag END AS payload_md5
FROM s
"""
