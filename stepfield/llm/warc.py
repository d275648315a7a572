"""WARC archives: one gzip member for each record, written by tasks to a shared folder and read back in sequence.

A page is a `response` record, or a `revisit` of an equal payload (identical-payload-digest profile): its block
then holds the HTTP head only, whose Content-Length still tells the payload's size. The reader never holds more
than one record: it feeds zlib piece by piece, frames records by Content-Length and verifies every digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, slices
from .tokens import open_store, store_bytes

LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip().removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    """The bytes of one record, before compression."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex("%").upper() for c in url))
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(src) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file, one after the other. Raises ValueError on damage."""
    raw, pending = b"", True
    while pending:
        z, data = zlib.decompressobj(31), bytearray()
        head = size = None
        while not z.eof:
            raw = raw or src.read(PIECE)
            if not raw:
                if data or head:
                    raise ValueError("the file ends inside a record")
                return
            data += z.decompress(raw, PIECE)
            raw = z.unused_data if z.eof else z.unconsumed_tail
            if head is None and (at := data.find(b"\r\n\r\n")) >= 0:
                head = _headers(bytes(data[:at]))
                if not data.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                size = int(head["content-length"])
                del data[: at + 4]
            if size is not None and len(data) > size + 4:
                raise ValueError("a record is longer than its Content-Length")
        if head is None or len(data) != size + 4 or data[size:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        block = bytes(data[:size])
        if head.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"digest of {head.get('warc-record-id')} does not fit")
        yield head, block


def write_warc(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) and return (file string, records long), a row for each file.

    Of rows with equal payloads of at least `least` bytes those with the smallest page_id are responses, the others
    revisits of it; a null page_id is larger than all others, and where all are null all are responses. A null html
    is an empty payload. Other columns are not read. An empty table gives no file.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Only digests that repeat have a row here; a payload that very many pages share is split by Spark's skew join.
    rows = rows.join(firsts, "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def fill(out) -> None:
            nonlocal n, first
            while first is not None:
                for part in slices(first, "html"):
                    for page, url, html, digest, original in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                        z = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = record(page, url, html.encode("utf-8"), digest, original, original is not None and page != original)
                        out.write(z.compress(data) + z.flush())
                        n += 1
                first = next((b for b in batches if b.num_rows), None)

        store_bytes(folder, name, fill)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(lean(write), "file string, records long")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """(page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary), a row for each record.

    payload is null for revisits. Block digests are verified for all records, payload digests for responses.
    """
    ship(files.sparkSession)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for name in (n for b in batches for n in b.column("file").to_pylist()):
            with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as src:
                held, size = [], 0
                for head, block in read_records(src):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    length = int(_headers(http)["content-length"])
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
                    refers = head.get("warc-refers-to")
                    held.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind, length, digest, page_of(refers) if refers else None, payload if kind == "response" else None))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [f for f, _ in fields])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [f for f, _ in fields])

    return files.select("file").mapInArrow(lean(read), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
