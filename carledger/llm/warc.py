"""WARC archives with an index written first.

Tasks write gzip-per-record WARC files to a shared folder and return one
index row for each record: file, offset, length, URL, digest. That table is
the manifest: a task that is run again writes a file of another name, and
only files named by the index count. Reading selects index rows, sorts them
by place, merges neighbouring byte ranges, and reads each merged range once.

Of records with equal payloads the one with the smallest page_id is a
response, the others are revisit records that refer to it and hold no
payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import forget_at_exit, ship, stage
from carledger.session import shared_path

#: A file takes no further record once it holds so many bytes.
FILE_BYTES = 512 * 1024 * 1024
#: Ranges at most this far apart are read as one, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 * 1024, 8 * 1024 * 1024
LEVEL = 5
#: Payloads of fewer bytes are never made revisits.
LEAST_PAYLOAD = 0
CRAWLED = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """Header values hold no control characters or blanks."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A null page_id or URL has no header."""
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Date: {CRAWLED}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record. A response's payload is checked
    against its digest; a revisit has the length that its HTTP header
    states."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    page = lambda k: int(h[k].strip("<>").rpartition(":")[2]) if k in h else None
    if h["warc-type"] == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"payload of page {page('warc-record-id')} does not match its digest")
    return {"page_id": page("warc-record-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
            "payload": payload if h["warc-type"] == "response" else None, "payload_bytes": stated,
            "payload_digest": digest, "refers_to": page("warc-refers-to")}


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to). Payloads are equal if SHA-1 and
    length are. Rows that repeat the smallest page_id are all responses; a
    payload that only null page_ids have is a response each time. Only
    digests found twice or more are joined back, without a forced
    broadcast; Spark splits a digest that many pages share."""
    rows = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("_sha", F.concat_ws(":", F.sha1("payload"), F.length("payload")))
    many = (rows.filter(F.length("payload") >= LEAST_PAYLOAD).groupBy(F.col("_sha").alias("_key"))
            .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    joined = rows.join(many, rows["_sha"] == many["_key"], "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))


def open_folder(folder: str):
    """File system and path of a folder by URI or plain path."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + "/" + folder.lstrip("/"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html; others are ignored)
    to a shared ``folder`` and returns the index, itself a written table. A
    null html is an empty payload. One record is held in memory at a time.
    An empty table gives an empty index."""
    ship(pages.sparkSession)

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in it:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base32_sha1(r["payload"])
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(make_record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"])) + z.flush()
                    out.write(data)
                    rows.append((name, at, len(data), r["url"], digest, r["page_id"],
                                 "response" if r["refers_to"] is None else "revisit"))
                    at += len(data)
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        finally:
            if out is not None:
                out.close()
    rows = with_revisits(pages).select(F.col("page_id").cast("long"), "url", "payload", F.col("refers_to").cast("long"))
    return stage(rows.mapInArrow(written, INDEX), "warc-index")


RECORD = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long")


def ranges(rows: Iterator[dict]) -> Iterator[tuple[str, int, int, list[dict]]]:
    """(file, start, end, index rows) of rows in order of file and offset."""
    held: list[dict] = []
    for r in rows:
        if held:
            end = held[-1]["offset"] + held[-1]["length"]
            if (r["file"] != held[0]["file"] or r["offset"] - end > GAP_BYTES
                    or r["offset"] + r["length"] - held[0]["offset"] > READ_BYTES):
                yield held[0]["file"], held[0]["offset"], end, held
                held = []
        held.append(r)
    if held:
        yield held[0]["file"], held[0]["offset"], held[-1]["offset"] + held[-1]["length"], held


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows. Rows are range-sorted by place,
    so a task reads runs of neighbouring bytes, one merged range at a time.
    ``payloads``: whether payloads are returned (they are always checked)."""
    ship(index.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def fetched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        source, opened = None, ""
        for file, start, end, rows in ranges(r for b in it for r in b.to_pylist()):
            if file != opened:
                if source is not None:
                    source.close()
                source, opened = system.open_input_file(f"{base}/{file}"), file
            source.seek(start)
            data = source.read(end - start)
            found = [parse_record(zlib.decompress(data[r["offset"] - start:r["offset"] - start + r["length"]], 31))
                     for r in rows]
            for x in found:
                if not payloads:
                    x["payload"] = None
            yield pa.record_batch([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names=names)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset")
    return placed.sortWithinPartitions("file", "offset").mapInArrow(fetched, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, as read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    folder = shared_path(pages.sparkSession, "llm-warc")
    forget_at_exit(pages.sparkSession, folder)
    return read(write(pages, folder), folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
