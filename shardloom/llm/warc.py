"""WARC records, and the resolution of not-modified revisits.

A revisit record stands for a capture whose server said that nothing had changed. It is resolved by the latest earlier
full response with the same canonical URL: if the validators that it carries agree with that response's, it takes the
response's payload and header fields, updated by those of its own fields that a 304 may change.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table, utf8

#: Fields that a 304 response may change in the stored one (fixed values, after RFC 9110 and RFC 9111).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that say where a visitor came from (fixed values).
TRACKING = "^(utm_[a-z]+|fbclid|gclid)(=|$)"
RECORDS = "record_id string, kind string, url string, at bigint, status int, fields array<struct<name:string,value:string>>, n_bytes bigint, digest string"
_RECORD_FIELDS = ("record_id", "kind", "url", "at", "status", "fields", "n_bytes", "digest")
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def canonical_url(url: str | Column) -> Column:
    """Host in lower case without www. and default port, path without closing slashes, other parameters sorted.

    Scheme, fragment and tracking parameters don't count. Null for null, and for what has no scheme and host.
    """
    u = F.regexp_replace(F.col(url) if isinstance(url, str) else url, "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    named = F.filter(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(named), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _fields(lines: list[bytes]) -> list[dict]:
    """Header fields in order; continued lines are joined, lines without a colon skipped."""
    out: list[dict] = []
    for line in lines:
        if line[:1] in b" \t" and line and out:
            out[-1]["value"] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append({"name": name.strip().decode("utf-8", "replace"), "value": value.strip().decode("utf-8", "replace")})
    return out


def parse_record(data: bytes) -> dict:
    """The RECORDS columns of one WARC record; what is missing or broken is null."""
    head, _, rest = (lambda m: (data[: m.start()], 0, data[m.end() :]) if m else (data, 0, b""))(_HEAD_END.search(data))
    own = {f["name"].lower(): f["value"] for f in _fields(head.splitlines()[1:])}
    length = own.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    m = _HEAD_END.search(block)
    http, payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = http.splitlines()
    status = lines[0].split()[1:2] if lines and lines[0].startswith(b"HTTP/") else []
    date = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.\d+)?Z", own.get("warc-date", ""))
    at = None
    if date:
        import datetime

        try:
            at = int(datetime.datetime(*map(int, date.groups()), tzinfo=datetime.timezone.utc).timestamp())
        except ValueError:
            at = None
    return {
        "record_id": own.get("warc-record-id"), "kind": own.get("warc-type"), "url": own.get("warc-target-uri"), "at": at,
        "status": int(status[0]) if status and status[0].isdigit() and len(status[0]) == 3 else None,
        "fields": _fields(lines[1:]), "n_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest(),
    }


def read_records(raw: DataFrame, data_col: str = "data") -> DataFrame:
    """RECORDS of a binary column that holds one WARC record a row; null data gives a row of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_RECORD_FIELDS)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), _FIELDS, pa.int64(), pa.string()]
        for b in slices(batches, "data"):
            rows = [parse_record(x) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return raw.select(F.coalesce(F.col(data_col), F.lit(b"")).alias("data")).mapInArrow(run, RECORDS)


def field(fields: str | Column, name: str) -> Column:
    """The first value of a header field, names compared without case; null if there is none."""
    c = F.col(fields) if isinstance(fields, str) else fields
    return F.get(F.filter(c, lambda f: F.lower(f["name"]) == name), 0)["value"]


def merged_fields(stored_fields: Column, new: Column) -> Column:
    """Stored fields less those that permitted new ones replace, then these; names in lower case, sorted."""
    lower = lambda fs: F.transform(fs, lambda f: F.struct(F.lower(f["name"]).alias("name"), f["value"].alias("value")))
    permitted = F.filter(lower(F.coalesce(new, F.array().cast("array<struct<name:string,value:string>>"))), lambda f: f["name"].isin(*PERMITTED))
    names = F.transform(permitted, lambda f: f["name"])
    return F.array_sort(F.concat(F.filter(lower(stored_fields), lambda f: ~F.array_contains(names, f["name"])), permitted))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with canonical, outcome, refers_to, and status, fields, n_bytes, digest after resolution.

    outcome: full for a response with a status other than 304; for revisits (and 304 responses) resolved; mismatch, if a
    validator differs; unvalidated, if it carries none; missing, if there is no strictly earlier full response of the
    same canonical URL; other for other kinds. An ETag, compared weakly, decides if the revisit carries one, else
    Last-Modified does. Only the latest earlier response is checked (of several at one time, that with the greatest id,
    then digest). Unresolved records keep what they have. Records without URL or time match nothing. Each row of records
    is a record of its own, whether its id is null, repeated or neither; rows come out as often as they go in. Columns
    beside those of RECORDS are left out. An empty table gives an empty result.

    Records are first brought down to one row for each URL and second. These are cut into ranges by (URL, second), as
    Spark samples them, so a URL with many seconds lies in many ranges, evenly however they lie in time. The as-of join
    is then two running maxima: over the ranges of each URL, and within a range.
    """
    given = records.select(*_RECORD_FIELDS).withColumns({"canonical": canonical_url("url"), "row": F.monotonically_increasing_id()})
    given = stored(given, "warc-records")
    asks = (F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.coalesce("status", F.lit(0)) == 304))
    full = (F.col("kind") == "response") & ~asks
    given = given.withColumn("is_full", F.coalesce(full, F.lit(False))).withColumn("asks", F.coalesce(asks, F.lit(False)))
    keyed = given.where("canonical is not null and at is not null and (is_full or asks)")
    latest = F.max(F.when(F.col("is_full"), F.struct("at", "record_id", "digest", "row")))
    seconds = keyed.groupBy("canonical", "at").agg(latest.alias("own"), F.max("asks").alias("asked"))
    ranged = stored(seconds.repartitionByRange("canonical", "at").withColumn("range", F.spark_partition_id()), "warc-seconds")
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("canonical", "range").agg(F.max("own").alias("own")).select("canonical", "range", F.max("own").over(before).alias("carried"))
    within = Window.partitionBy("canonical", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("earlier", F.max("own").over(within)).where("asked").join(carried, ["canonical", "range"])
    found = found.select("canonical", "at", F.coalesce("earlier", "carried").alias("of")).where("of is not null").select("canonical", "at", F.col("of.record_id").alias("refers_to"), F.col("of.row").alias("of_row"))
    responses = given.where("is_full").select(F.col("row").alias("of_row"), *[F.col(c).alias(f"of_{c}") for c in ("status", "fields", "n_bytes", "digest")])
    with_response = given.where("asks").join(found, ["canonical", "at"], "left").join(responses, "of_row", "left")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    etag, since = field("fields", "etag"), field("fields", "last-modified")
    agrees = F.when(etag.isNotNull(), weak(etag) == weak(field("of_fields", "etag"))).when(since.isNotNull(), since == field("of_fields", "last-modified"))
    outcome = F.when(F.col("of_row").isNull(), "missing").when(etag.isNull() & since.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    asked = with_response.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    asked = asked.select(
        "record_id", "kind", "url", "canonical", "at", "outcome", F.when(F.col("outcome") != "missing", F.col("refers_to")).alias("refers_to"),
        F.when(ok, F.col("of_status")).otherwise(F.col("status")).alias("status"),
        F.when(ok, merged_fields(F.col("of_fields"), F.col("fields"))).otherwise(F.col("fields")).alias("fields"),
        F.when(ok, F.col("of_n_bytes")).otherwise(F.col("n_bytes")).alias("n_bytes"), F.when(ok, F.col("of_digest")).otherwise(F.col("digest")).alias("digest"),
    )
    rest = given.where("not asks").select(
        "record_id", "kind", "url", "canonical", "at", F.when(F.col("is_full"), "full").otherwise("other").alias("outcome"), F.lit(None).cast("string").alias("refers_to"), "status", "fields", "n_bytes", "digest"
    )
    return asked.unionByName(rest)


def page_captures(pages: DataFrame) -> DataFrame:
    """data: WARC records of a crawl over pages(page_id, url, html): each page in full, and a later revisit of it.

    The crawl takes a page a minute; revisits follow one to seven days later. Every fifth page has changed by then,
    every eleventh revisit carries no validator, and every third of the others a Last-Modified in place of an ETag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime

        zero = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
        for b in slices(batches, "body"):
            out = []
            for i, url, body in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body")), strict=True):
                n, uri = (i or 0), (url or "").encode()
                tag = hashlib.md5(body).hexdigest().encode()
                for kind in (b"response", b"revisit"):
                    at = 60 * n + (0 if kind == b"response" else 86400 * (n % 7 + 1))
                    date = (zero + datetime.timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ").encode()
                    if kind == b"response":
                        http = b'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\nETag: "%s"\r\nLast-Modified: %d\r\nDate: %d\r\n\r\n' % (len(body), tag, 60 * n, at)
                        block = http + body
                    else:
                        valid = b"" if n % 11 == 0 else b"Last-Modified: %d\r\n" % (60 * n + (n % 5 == 0)) if n % 3 == 0 else b'ETag: W/"%s%s"\r\n' % (tag, b"-new" if n % 5 == 0 else b"")
                        block = b"HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nServer: crawl\r\nCache-Control: max-age=%d\r\n%sDate: %d\r\n\r\n" % (n % 1000, valid, at)
                        uri += b"#again"
                    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d:%s>\r\nWARC-Target-URI: %s\r\nWARC-Date: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
                    out.append(head % (kind, n, kind, uri, date, len(block)) + block + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8("html").alias("body")).mapInArrow(run, "data binary")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of the revisits in a crawl of all pages; the fields' digest is over their sorted lines."""
    resolved = resolve_revisits(read_records(page_captures(table(spark, sf_dir, "pages"))))
    lines = F.array_join(F.array_sort(F.transform("fields", lambda f: F.concat(F.lower(f["name"]), F.lit(": "), f["value"]))), "\n")
    return resolved.select("record_id", "kind", "canonical", (F.col("at") - 1704067200).alias("seconds"), "outcome", "refers_to", "status", "n_bytes", "digest", F.md5(lines.cast("binary")).alias("fields_md5"))


OP8_SQL = """
WITH p AS (
  SELECT page_id AS n, coalesce(html, '') AS body, regexp_replace(coalesce(url, ''), '#.*$', '') AS u FROM pages),
q AS (
  SELECT n, body, md5(body) AS tag,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)(=|$)'))), '&') AS query
  FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM q),
f AS (
  SELECT n, canonical, 60 * n AS seconds, '<urn:page:' || n || ':response>' AS record_id, tag, 60 * n AS modified,
         CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, sha256(body) AS digest FROM c),
v AS (
  SELECT n, canonical, 60 * n + 86400 * (n % 7 + 1) AS seconds, '<urn:page:' || n || ':revisit>' AS record_id,
         CASE WHEN n % 11 <> 0 AND n % 3 <> 0 THEN tag || CASE WHEN n % 5 = 0 THEN '-new' ELSE '' END END AS tag,
         CASE WHEN n % 11 <> 0 AND n % 3 = 0 THEN 60 * n + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END END AS modified FROM c),
m AS (
  SELECT v.*, f.record_id AS refers_to, f.tag AS f_tag, f.modified AS f_modified, f.n_bytes AS f_bytes, f.digest AS f_digest
  FROM v LEFT JOIN f ON f.canonical = v.canonical AND f.seconds < v.seconds
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY f.seconds DESC NULLS LAST, f.record_id DESC) = 1),
o AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN tag IS NULL AND modified IS NULL THEN 'unvalidated'
                 WHEN coalesce(tag = f_tag, modified = f_modified) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM m)
SELECT record_id, 'response' AS kind, canonical, seconds, 'full' AS outcome, CAST(NULL AS VARCHAR) AS refers_to, CAST(200 AS INTEGER) AS status, n_bytes, digest,
       md5('content-length: ' || n_bytes || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || seconds || chr(10)
           || 'etag: "' || tag || '"' || chr(10) || 'last-modified: ' || modified) AS fields_md5
FROM f
UNION ALL
SELECT record_id, 'revisit', canonical, seconds, outcome, refers_to, CAST(CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END AS INTEGER),
       CASE WHEN outcome = 'resolved' THEN f_bytes ELSE 0 END, CASE WHEN outcome = 'resolved' THEN f_digest ELSE sha256('') END,
       md5(CASE WHEN outcome = 'resolved' THEN
             'cache-control: max-age=' || n % 1000 || chr(10) || 'content-length: ' || f_bytes || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10)
             || 'date: ' || seconds || chr(10) || 'etag: ' || CASE WHEN tag IS NOT NULL THEN 'W/"' || tag || '"' ELSE '"' || f_tag || '"' END || chr(10)
             || 'last-modified: ' || f_modified
           ELSE 'cache-control: max-age=' || n % 1000 || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || seconds
             || CASE WHEN tag IS NOT NULL THEN chr(10) || 'etag: W/"' || tag || '"' ELSE '' END
             || CASE WHEN modified IS NOT NULL THEN chr(10) || 'last-modified: ' || modified ELSE '' END || chr(10) || 'server: crawl' END)
FROM o
"""
