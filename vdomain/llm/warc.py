"""Web archive records: reading, writing, and resolving revisits that say "not modified".

A revisit with status 304 has no body. It stands for the latest earlier full response of the same canonical URL,
if the validators agree: the entity tag where both have one, else the date of last modification. The stored response's
headers are then updated with those that a 304 may update. The as-of join is a running last value by time inside
(URL, stretch of time), with the last response of earlier stretches carried in, so that a URL that holds a
large share of all records is dealt out by time.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces

#: Seconds in a stretch of time that one task sorts.
STRETCH = 86_400
# Header fields that describe the body or the connection of the 304 itself, from RFC 9110 and RFC 9111.
KEPT = ("connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that only track visitors.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
RECORD = "record_id string, type string, url string, date string, status int, headers map<string,string>, body binary"


class Stream:
    """Bytes of one gzip member, or of plain data, a MB at a time."""

    def __init__(self, data: memoryview, packed: bool):
        self.data, self.at, self.held, self.inflate = data, 0, b"", zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        if self.at >= len(self.data) or self.inflate and self.inflate.eof:
            return False
        chunk = self.data[self.at : self.at + (1 << 20)]
        self.at += len(chunk)
        if self.inflate:
            chunk = self.inflate.decompress(chunk)
            self.at -= len(self.inflate.unused_data)
        self.held += chunk
        return True

    def line(self) -> bytes:
        seen = 0
        while (k := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                k = len(self.held) - 1
                break
        out, self.held = self.held[: k + 1], self.held[k + 1 :]
        return out

    def read(self, n: int) -> bytes:
        parts, got = [], 0
        while True:
            part = self.held[: n - got]
            parts.append(part)
            got += len(part)
            self.held = self.held[len(part) :]
            if got == n or not self._more():
                return b"".join(parts)

    def skip_to_record(self) -> None:
        """To the next line that begins a record, or the end."""
        while line := self.line():
            if line.startswith(b"WARC/"):
                self.held = line + self.held
                return


class Damaged(ValueError):
    """What stands here isn't a whole record."""


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, compressed by record or as a whole, or not at all, one in memory at a time. HTTP headers are lower-cased; of repeated ones the last stays.

    A stretch that can't be read, or a record that is cut short, gives a row of type "damaged" with nothing else, and reading goes on at the next record.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        packed = view[at : at + 2] == b"\x1f\x8b"
        s = Stream(view[at:], packed)
        try:
            yield from _records(s)
            at += s.at if packed else len(view)
        except (zlib.error, Damaged):
            yield DAMAGED
            if packed:  # the next member
                k = data.find(b"\x1f\x8b\x08", at + 2)
                at = k if k >= 0 else len(view)
            else:
                at = len(view)


DAMAGED = {"record_id": None, "type": "damaged", "url": None, "date": None, "status": None, "headers": {}, "body": None}


def _records(s: Stream) -> Iterator[dict]:
    while line := s.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if s.inflate:
                raise Damaged
            yield DAMAGED
            s.skip_to_record()
            continue
        head = _headers(s)
        size = head.get("content-length", "")
        if not size.isdigit():
            if s.inflate:
                raise Damaged
            yield DAMAGED
            s.skip_to_record()
            continue
        block = s.read(int(size))
        if len(block) < int(size):
            raise Damaged
        status, http, body = None, {}, block
        if "http" in head.get("content-type", "") and head.get("warc-type") in ("response", "revisit"):
            b = Stream(memoryview(block), False)
            words = b.line().split()
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            http, body = _headers(b), b.read(len(block))
        yield {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": (head.get("warc-target-uri") or "").strip("<>") or None, "date": head.get("warc-date"), "status": status, "headers": http, "body": body}
    if s.inflate and not s.inflate.eof:
        raise Damaged


def _headers(s: Stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := s.line()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def serialize(records: list[dict]) -> bytes:
    """The records as a WARC file, compressed by record."""
    out = []
    for r in records:
        http = f"HTTP/1.1 {r['status']} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r["headers"].items()) + "\r\n"
        block = http.encode() + (r["body"] or b"")
        head = f"WARC/1.1\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Type: {r['type']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {r['date']}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a path; Spark opens the files, wherever they are.

    A file as it is stored is one row (about a GB by custom; Spark refuses files over 2 GB with an error), and is unpacked record by record. What can't
    be read gives rows of type "damaged". Records go out in batches of at most 200 and 32 MB.
    """
    kinds = {"record_id": pa.string(), "type": pa.string(), "url": pa.string(), "date": pa.string(), "status": pa.int32(), "headers": pa.map_(pa.string(), pa.string()), "body": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], t) for c, t in kinds.items()], list(kinds))

        for b in pieces(batches, 1):
            held, size = [], 0
            for r in parse(b.column("content")[0].as_py()):
                held.append(r | {"headers": list(r["headers"].items())})
                size += len(r["body"] or b"")
                if len(held) == 200 or size > 32 << 20:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def canonical_url(url: str | Column = "url") -> Column:
    """Host in lower case without www and default port, path without trailing slashes, parameters sorted without those that track; no scheme, no fragment."""
    u = F.regexp_replace(F.col(url) if isinstance(url, str) else url, "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def tag(value: Column) -> Column:
    """An entity tag for comparison: weak ones compare by their value."""
    return F.regexp_replace(value, "^W/", "")


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(record_id long, url, ts long, type, status, headers) to a row per revisit with status 304.

    record_id, url_key, outcome (resolved, changed, unvalidated, missing), response_id and headers (of the response, updated; null unless resolved).
    A response counts from the second after its own; of responses with one time the one with the greater id is later. Records without URL or time
    are missing. Header names are in lower case. Repeated rows each give a row.
    """
    key = canonical_url()
    full = (F.col("type") == "response") & (F.col("status") == 200)
    again = (F.col("type") == "revisit") & (F.col("status") == 304)
    r = records.where(full | again).select("record_id", key.alias("url_key"), "ts", full.alias("full"), "headers").withColumn("at", F.floor(F.col("ts") / stretch))
    timed = r.where("url_key is not null and ts is not null")
    stored = F.struct("ts", "record_id", "headers")
    w = Window.partitionBy("url_key", "at").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = timed.withColumn("own", F.last(F.when(F.col("full"), stored), ignorenulls=True).over(w))
    ends = timed.groupBy("url_key", "at").agg(F.max_by(F.when(F.col("full"), stored), F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "at", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # responses sort after revisits of the same second, so `own` is strictly earlier
    j = inside.where("not full").join(carried, ["url_key", "at"]).withColumn("was", F.coalesce("own", "carried"))
    new, old = F.col("headers"), F.col("was.headers")
    etag = lambda h: tag(F.try_element_at(h, F.lit("etag")))
    since = lambda h: F.try_element_at(h, F.lit("last-modified"))
    agree = F.coalesce(etag(new) == etag(old), since(new) == since(old))
    outcome = F.when(F.col("was").isNull(), "missing").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("changed")
    may = F.map_filter(new, lambda k, v: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(may, k)), may)
    out = j.withColumn("outcome", outcome).select("record_id", "url_key", "outcome", F.col("was.record_id").alias("response_id"), F.when(F.col("outcome") == "resolved", merged).alias("headers"))
    untimed = r.where("not full and (url_key is null or ts is null)").select("record_id", "url_key", F.lit("missing").alias("outcome"), F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.union(untimed)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made from pages: each is fetched once, a minute apart, and visited again up to ten minutes later (every eleventh earlier than that).

    Every fifth response and every seventh revisit have no entity tag. Dates of last modification are there unless the page's number is a multiple of 3 (a revisit's: of 4),
    and every thirteenth revisit's is another one.
    """
    k = F.col("page_id")
    ts = F.lit(1_700_000_000).cast("long") + k * 60
    mark = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    day = (k % 28).cast("string")
    p = pages.select("page_id", "url", ts.alias("t"), mark.alias("etag"), length.alias("length"))
    where = lambda names: F.map_filter(names, lambda _, v: v.isNotNull())
    first = p.select((k * 2).alias("record_id"), "url", F.col("t").alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("status"), where(F.create_map(F.lit("etag"), F.when(k % 5 != 0, F.col("etag")), F.lit("last-modified"), F.when(k % 3 != 0, day), F.lit("content-length"), F.col("length"), F.lit("date"), F.col("t").cast("string"), F.lit("content-type"), F.lit("text/html"))).alias("headers"))
    later = F.when(k % 11 == 0, F.col("t") - 30).otherwise(F.col("t") + 30 + k % 7 * 100)
    again = p.select((k * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), where(F.create_map(F.lit("etag"), F.when(k % 7 != 0, F.concat(F.lit("W/"), F.col("etag"))), F.lit("last-modified"), F.when(k % 4 != 0, F.when(k % 13 == 0, F.lit("x")).otherwise(day)), F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("x-cache"), F.lit("hit"))).alias("headers"))
    return first.union(again)


def query(pages: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")
    return resolve(records_of_pages(pages)).select("record_id", "url_key", "outcome", "response_id", F.md5(lines).alias("headers_md5"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS u, 1700000000 + page_id * 60 AS t, '"' || md5(coalesce(html, '')) || '"' AS etag, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS len FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM p),
c AS (SELECT *, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
r AS (SELECT page_id * 2 AS response_id, url_key, t, len, CASE WHEN page_id % 5 <> 0 THEN etag END AS old_tag, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 28 AS VARCHAR) END AS old_day FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN page_id % 7 <> 0 THEN etag END AS new_tag, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN page_id % 13 = 0 THEN 'x' ELSE CAST(page_id % 28 AS VARCHAR) END END AS new_day,
  CASE WHEN page_id % 11 = 0 THEN t - 30 ELSE t + 30 + page_id % 7 * 100 END AS ts FROM c),
a AS (SELECT v.*, r.* EXCLUDE (url_key), coalesce(new_tag = old_tag, new_day = old_day) AS agree FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.ts > r.t)
SELECT record_id, url_key, CASE WHEN response_id IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unvalidated' WHEN agree THEN 'resolved' ELSE 'changed' END AS outcome, response_id,
  CASE WHEN agree THEN md5('content-length:' || len || chr(10) || 'content-type:text/html' || chr(10) || 'date:' || ts
    || coalesce(chr(10) || 'etag:' || coalesce('W/' || new_tag, old_tag), '') || coalesce(chr(10) || 'last-modified:' || coalesce(new_day, old_day), '') || chr(10) || 'x-cache:hit') END AS headers_md5
FROM a
"""
