"""Not-modified revisits in web archives, resolved by an as-of join.

A 304 capture has no body: it stands for the latest earlier full response of the
same canonical URL, provided that its validators agree. Both kinds of record are
ordered by time within a canonical URL and a time bucket; a bucket's first
revisits take the last response of the nearest earlier bucket that has one, from
a table with one row a URL and bucket. So a URL with a large part of all
captures spreads over the buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 256
# Header fields of a stored response that a 304 may not change (RFC 9110, RFC 9111).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query arguments that name no resource.
IDLE_ARGUMENTS = r"^(utm_[a-z]+|fbclid|gclid|sessionid|jsessionid|phpsessid)(=|$)"


def canonical_url(url: Column) -> Column:
    """A URL without scheme, ``www.``, default port, fragment and idle arguments; host in lower case, arguments in order.

    A null URL stays null; a text that is no URL is only trimmed of these parts.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    arguments = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda a: (a != "") & ~F.lower(a).rlike(IDLE_ARGUMENTS))
    query = F.array_join(F.array_sort(arguments), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _field(headers: Column, name: str) -> Column:
    """A header field by its name in any case; the first in the order of names if several differ in case."""
    hit = F.filter(F.array_sort(F.map_entries(headers)), lambda e: F.lower(e["key"]) == name)
    return F.get(hit, 0)["value"]


def resolve_revisits(records: DataFrame, record_id: str = "record_id", url: str = "url", time: str = "ts", kind: str = "type", headers: str = "headers", digest: str = "digest") -> DataFrame:
    """One row for each revisit: ``record_id``, ``canonical``, ``response_id``, ``verdict`` and merged ``headers``.

    ``type`` is ``response`` or ``revisit``; other records are ignored. The
    response is the latest one strictly earlier in time; at equal times the
    larger record id counts as later. Verdicts: ``resolved`` (a validator
    agrees: ETag, weakly, else Last-Modified, else payload digest), ``changed``
    (it doesn't: no response, own headers), ``unchecked`` (no validator in
    common) and ``orphan`` (no earlier response). Merged headers are the
    response's, updated by the revisit's fields but those a 304 may not change;
    names are lower-cased, and of names that differ in case only the first is
    taken. Null headers are empty; a record with a null URL or time is an
    orphan, or as a response ignored. Repeated revisits come back as often.
    """
    h = F.coalesce(F.col(headers), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    low = F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform(F.map_keys(h), lambda k: F.lower(k))), lambda k: F.struct(k.alias("key"), F.get(F.filter(F.array_sort(F.map_entries(h)), lambda e: F.lower(e["key"]) == k), 0)["value"].alias("value")))))
    rows = records.where(F.col(kind).isin("response", "revisit")).select(
        F.col(record_id).alias("record_id"), canonical_url(F.col(url)).alias("canonical"), F.col(time).cast("double").alias("ts"), (F.col(kind) == "response").alias("full"), low.alias("h"), F.col(digest).alias("digest"))
    # buckets hold about equally many records, so that those of one URL never gather in one of them, whatever its times
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [i / BUCKETS for i in range(1, BUCKETS)], 100 * BUCKETS)).first()[0] or []))
    rows = rows.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("ts"))))
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    stored = F.when(F.col("full") & usable, F.struct("record_id", "h", "digest"))
    last = rows.where(F.col("full") & usable).groupBy("canonical", "bucket").agg(F.max_by(F.struct("record_id", "h", "digest"), F.struct("ts", "record_id")).alias("own"))
    touched = rows.where(usable).groupBy("canonical", "bucket").agg(F.lit(1).alias("one"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.join(last, ["canonical", "bucket"], "left").select("canonical", "bucket", F.last("own", True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    got = rows.where(usable).withColumn("near", F.last(stored, True).over(inside)).where("not full")
    got = got.join(carried, ["canonical", "bucket"], "left").withColumn("from", F.coalesce("near", "carried")).select("record_id", "canonical", "h", "digest", "from")
    lost = rows.where(~usable & ~F.col("full")).select("record_id", "canonical", "h", "digest", F.lit(None).cast(dict(got.dtypes)["from"]).alias("from"))
    got = got.union(lost)

    def tag(m: Column) -> Column:
        return F.regexp_replace(F.element_at(m, "etag"), "^W/", "")

    etag, modified = (tag(F.col("h")), tag(F.col("from.h"))), (F.element_at("h", F.lit("last-modified")), F.element_at("from.h", F.lit("last-modified")))
    same = F.when(etag[0].isNotNull() & etag[1].isNotNull(), etag[0] == etag[1]).when(modified[0].isNotNull() & modified[1].isNotNull(), modified[0] == modified[1]).when(F.col("digest").isNotNull() & F.col("from.digest").isNotNull(), F.col("digest") == F.col("from.digest"))
    verdict = F.when(F.col("from").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    allowed = F.map_filter("h", lambda k, v: ~k.isin(*KEPT_FIELDS))
    merged = F.map_concat(F.map_filter("from.h", lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    ok = F.col("verdict").isin("resolved", "unchecked")
    return got.withColumn("verdict", verdict).select("record_id", "canonical", F.when(ok, F.col("from.record_id")).alias("response_id"), "verdict", F.when(ok, merged).otherwise(F.col("h")).alias("headers"))


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed WARC file: ``headers`` of the record, ``http`` headers (lower-cased) and ``body``.

    Bytes after a truncated record are ignored. A record whose length is no number, or
    a negative one, is left out; the next record is the next header after an empty line.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = dict(x.split(":", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        head = {k.strip().lower(): v.strip() for k, v in head.items()}
        length = head.get("content-length", "0")
        if not (length.isascii() and length.isdigit()):
            at = data.find(b"\r\n\r\nWARC/", end)
            if at < 0:
                return
            at += 4
            continue
        size = int(length)
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        http, body = {}, block
        if block.startswith(b"HTTP/"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in top.decode("latin-1").split("\r\n")[1:] if ":" in x)}
        yield {"headers": head, "http": http, "body": body}
        at = end + 4 + size


def _members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzip file one by one, or the whole of another file; a truncated member is left out."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        one, out = zlib.decompressobj(31), []
        try:
            while not one.eof and at < len(view):
                part = view[at : at + step]
                out.append(one.decompress(part))
                at += len(part) - len(one.unused_data)
        except zlib.error:
            return
        if one.eof:
            yield b"".join(out)


CAPTURE = "path string, record_id string, url string, ts double, type string, headers map<string,string>, digest string"


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "record_id", "url", "ts", "type", "headers", "digest"])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[tuple] = []
            for member in _members(content.as_py()):
                for r in parse_records(member):
                    h = r["headers"]
                    try:
                        ts = datetime.fromisoformat(h.get("warc-date", "")).timestamp()
                    except ValueError:
                        ts = None
                    url = h.get("warc-target-uri", "").strip("<>") or None
                    rows.append((path, h.get("warc-record-id"), url, ts, h.get("warc-type"), list(r["http"].items()), h.get("warc-payload-digest")))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzip members, in the columns that ``resolve_revisits`` takes.

    A file is one row of one task, and a member at a time is unpacked; truncated
    records are left out, a date that can't be read is null.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_captures, CAPTURE)


def write_record(kind: str, url: str, date: str, record_id: str, http: dict[str, str], body: bytes = b"", status: str = "200 OK") -> bytes:
    """One WARC record with an HTTP message as its block; ``parse_records`` reads it back."""
    message = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http.items()) + "\r\n"
    block = message.encode("latin-1") + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nWARC-Record-ID: {record_id}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log over ``pages``: every page fetched once, and asked for again conditionally.

    A page's response comes 10 s after that of the previous id, with its ETag and
    digest. 5 s later it is revisited through another spelling of its URL. Ids
    1 modulo 4 are revisited 7 s later with another ETag, ids 2 modulo 5 also
    5 s before the response, and ids 3 modulo 7 without validators.
    """
    body = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(body, 1, 16), F.lit('"'))
    spelled = F.concat(F.regexp_replace("url", "^[a-z]+://", "HTTP://WWW."), F.lit("#again"))

    def record(k: int, shift: int, kind: str, url: Column, digest: Column, *fields: tuple[str, Column]) -> Column:
        return F.struct((F.col("page_id") * 8 + k).alias("record_id"), url.alias("url"), (F.col("page_id") * 10 + shift).alias("ts"), F.lit(kind).alias("type"), F.create_map(*[x for a, b in fields for x in (F.lit(a), b)]).alias("headers"), digest.alias("digest"))

    none = F.lit(None).cast("string")
    served = ("Date", F.col("page_id").cast("string"))
    all_of = F.array(
        record(0, 0, "response", F.col("url"), body, ("ETag", tag), ("Content-Type", F.lit("text/html")), ("Content-Length", F.length(F.coalesce("html", F.lit(""))).cast("string")), served),
        record(1, 5, "revisit", spelled, none, ("etag", F.concat(F.lit("W/"), tag)), ("Content-Length", F.lit("0")), ("Date", (F.col("page_id") + 1).cast("string"))),
        F.when(F.col("page_id") % 4 == 1, record(2, 7, "revisit", F.col("url"), none, ("ETag", F.lit('"other"')), served)),
        F.when(F.col("page_id") % 5 == 2, record(3, -5, "revisit", F.col("url"), body, ("Date", served[1]))),
        F.when(F.col("page_id") % 7 == 3, record(4, 9, "revisit", F.col("url"), none, ("X-Cache", F.lit("hit")), served)),
    )
    return pages.where("page_id is not null").select(F.explode(F.filter(all_of, lambda r: r.isNotNull())).alias("r")).select("r.*")
