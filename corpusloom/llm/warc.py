"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as three records, each a gzip member of its own: the request, the response (or the
revisit of an equal payload), and metadata, the first and last pointing at the second by
``WARC-Concurrent-To``.  Reading lists records, whatever wrote them; ``assemble`` joins them again through
their concurrent-to identifiers, in either direction and over one record in between, and gives one nested
row per capture.

Null html is an empty payload and null urls have no target; control characters of urls are percent-encoded.
Rows without identifier never stand for others unless no row of their payload has one; repeated identifiers
are separate captures, numbered; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches
from .files import put

NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which an archive is closed; one larger record makes one larger archive.
ARCHIVE_BYTES = 16 << 20
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_bytes long, payload_digest string, fields map<string,string>"


def record_id(page_id: int | None, copy: int, role: str) -> str:
    return f"<{uuid.uuid5(NAMES, f'page:{page_id}:{copy}:{role}').urn}>"


def _record(kind: str, name: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def capture(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, held_by: tuple[int | None, int] | None, date: str) -> bytes:
    """The three records of one capture; ``held_by`` names the capture that an equal payload is stored with."""
    main = record_id(page_id, copy, "response")
    uri = _uri(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    path = re.sub(r"^[a-z][a-z0-9+.-]*://[^/]*", "", uri or "", flags=re.I) or "/"
    request = _record("request", record_id(page_id, copy, "request"), [*shared, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\n\r\n".encode())
    same = [*shared, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if held_by is None:
        answer = _record("response", main, same, http + payload)
    else:
        answer = _record("revisit", main, [*same, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*held_by, "response"))], http)
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    return request + answer + _record("metadata", record_id(page_id, copy, "metadata"), [*shared, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], known.encode())


def _numbered(pages: DataFrame) -> DataFrame:
    """Adds ``copy``: 0, or the number of a row among those of a repeated identifier."""
    again = materialize(pages.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("again")), "again")
    if again.isEmpty():
        return pages.withColumn("copy", F.lit(0))
    same = pages["page_id"].eqNullSafe(again["again"])
    # Numbers follow the place of a row among the partitions of what is written here, and so are kept.
    repeated = materialize(pages.join(again, same, "left_semi").withColumn("copy", F.monotonically_increasing_id()), "repeated")
    return pages.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(repeated)


def plan(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with their payload digest and, for a payload that an earlier capture holds, that capture."""
    rows = _numbered(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    place = F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id").alias("page_id"), F.col("copy").cast("long").alias("copy"))
    holders = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min(place).alias("holder"), F.count("*").alias("times")).where("times > 1").select("digest", "holder")
    holders = materialize(holders, "holders")
    if holders.isEmpty():
        return rows.withColumn("held_by", F.lit(None).cast("struct<page_id:bigint,copy:bigint>"))
    joined = rows.join(holders.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("n") >= least), "left")
    itself = F.col("holder.page_id").eqNullSafe(F.col("page_id")) & (F.col("holder.copy") == F.col("copy"))
    return joined.withColumn("held_by", F.when(F.col("holder").isNotNull() & ~itself, F.struct(F.col("holder.page_id"), F.col("holder.copy")))).drop("of", "holder")


def write(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives into folder; a row per archive."""
    small_batches(planned.sparkSession)
    put(f"{folder}/_STARTED", b"")
    ready = planned.select("page_id", F.col("copy").cast("long"), "url", "html", "digest", F.col("held_by").isNotNull().alias("again"), "held_by.page_id", "held_by.copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.warc.gz"
            put(f"{folder}/{name}", b"".join(held))
            return pa.RecordBatch.from_pydict({"name": [name], "captures": [n], "bytes": [size]})

        for batch in batches:
            for page_id, copy, url, html, digest, again, *holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= archive_bytes:
                    yield close()
                    seq, held, size, n = seq + 1, [], 0, 0
                held.append(capture(page_id, copy, url, html.encode("utf-8", "surrogatepass"), digest, tuple(holder) if again else None, date))
                size, n = size + len(held[-1]), n + 1
        if held:
            yield close()

    names = ["page_id", "copy", "url", "html", "digest", "again", "holder_id", "holder_copy"]
    return materialize(ready.toDF(*names).mapInArrow(run, "name string, captures long, bytes long"), "archives")


def records_in(data: bytes) -> Iterator[dict]:
    """The records of an archive of gzip members, in order; payloads are checked against their digests."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(view[at:]) if len(view) - at < 1 << 16 else b""
        if not raw:
            pieces, step = [], 1 << 16
            unpack, here = zlib.decompressobj(31), at
            while not unpack.eof and here < len(view):
                pieces.append(unpack.decompress(view[here : here + step]))
                here += step
            raw, at = b"".join(pieces), min(here, len(view)) - len(unpack.unused_data)
        else:
            at = len(view) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("an archive is cut short")
        head, _, body = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, list[str]] = {}
        for line in lines:
            k, _, v = line.partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        one = lambda k, headers=headers: headers.get(k, [None])[0]
        block = body[: int(one("content-length"))]
        kind, digest, n, fields = one("warc-type"), one("warc-payload-digest"), None, None
        if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = re.search(rb"\r\nContent-Length:\s*(\d+)", http, re.I)
            n = int(length[1]) if kind == "revisit" and length else len(payload)
            if kind == "response":
                found = hashlib.sha256(payload).hexdigest()
                if digest and digest.startswith("sha256:") and digest != f"sha256:{found}":
                    raise ValueError(f"the payload of {one('warc-record-id')} doesn't have its digest")
                digest = f"sha256:{found}"
        elif (one("content-type") or "").startswith("application/warc-fields"):
            fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8").split("\r\n") if ":" in line]
        yield {"record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "payload_bytes": n, "payload_digest": digest.removeprefix("sha256:") if digest else None, "fields": fields}


def read(spark, folder: str) -> DataFrame:
    """A row per record of all archives in folder."""
    small_batches(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for row in records_in(data.as_py()):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return raw.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its requests and its metadata.

    Records that no concurrent-to identifier ties to a response or revisit have no capture to go to.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata"))
    ids = main.select(F.col("record_id").alias("main_id"))
    back = main.select(F.explode("concurrent_to").alias("other_id"), F.col("record_id").alias("main_id"))
    ahead = others.select(F.col("record_id").alias("other_id"), F.explode("concurrent_to").alias("target"))
    direct = ahead.join(ids, F.col("target") == F.col("main_id")).select("other_id", "main_id").unionByName(back)
    between = ahead.join(direct.select(F.col("other_id").alias("target"), "main_id"), "target").select("other_id", "main_id")
    links = direct.unionByName(between).distinct()
    part = F.struct("record_id", "target_uri", "date", "fields")
    parts = others.join(links, F.col("record_id") == F.col("other_id")).groupBy("main_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date")))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", part)).alias("metadata"),
    )
    return main.join(parts, main["record_id"] == parts["main_id"], "left").select(
        F.col("record_id").alias("capture_id"),
        F.struct("record_id", "type", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest").alias("response"),
        F.coalesce("requests", F.array().cast("array<struct<record_id:string,target_uri:string,date:string>>")).alias("requests"),
        F.coalesce("metadata", F.array().cast("array<struct<record_id:string,target_uri:string,date:string,fields:map<string,string>>>")).alias("metadata"),
    )


def archive(pages: DataFrame, least: int = 100, folder: str | None = None) -> DataFrame:
    """Writes every page, reads the archives back, and lists what each capture says of its page."""
    spark = pages.sparkSession
    folder = folder or f"{scratch(spark)}/warc"
    write(plan(pages, least), folder)
    captures = materialize(assemble(materialize(read(spark, folder), "records")), "captures")
    # A metadata record of ours has at most one page-id.
    page = F.get(F.filter(F.transform("metadata", lambda m: F.try_element_at(m["fields"], F.lit("page-id")).cast("long")), lambda x: x.isNotNull()), 0)
    rows = captures.select(page.alias("page_id"), "response.*")
    plain = rows.where("type = 'response'").withColumn("held", F.lit(None).cast("long"))
    again = rows.where("type = 'revisit'")
    holders = rows.where("type = 'response'").select(F.col("record_id").alias("holder"), F.col("page_id").alias("held"))
    revisits = again.join(holders, again["refers_to"] == holders["holder"], "left").drop("holder")
    return plain.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("held").alias("refers_to"))
