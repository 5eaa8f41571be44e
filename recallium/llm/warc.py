"""Operator 5: Zstandard WARC archives with an embedded dictionary.

An archive is a run of bytes: a skippable frame that holds a zstandard dictionary, then one
frame for each record, compressed with that dictionary. The reader takes the dictionary from the
leading frame, walks from frame to frame by their block headers, decodes each by itself and
validates version, header lines, lengths, the record's end and the payload's digest.

Archives are rows (archive, content) of a table, so that they lie wherever Spark's tables do;
``spark.read.format("binaryFile")`` gives rows that :func:`read` takes from files as well, and
:func:`archive` makes the bytes of one file. A task closes an archive after ``ARCHIVE_BYTES`` of
records, which bounds its memory.

Defined cases: a null payload counts as empty; a null url leaves its header out, and characters
that a header line can't carry are percent-encoded; payloads of fewer than ``REVISIT_BYTES`` are
always responses; rows that repeat a page id are records of their own, each response if its id is
the largest of its payload; a null page id is written as empty and read back as null, and its
record is a revisit if another record has its payload; no row makes no archive. Errors on reading: a
frame that doesn't state its size or states more than ``LONGEST_RECORD``, a header that is there
twice, a date that isn't one, lengths or digests that differ from what stands there.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_few, materialize, release

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
REVISIT_BYTES = 1000
#: Bytes of a record that a reader takes; a longer value fits no cell of a table either.
LONGEST_RECORD = (1 << 31) - 1
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP header of its payload but not the payload."""
    revisit = refers_to is not None
    block = _HTTP.format(length).encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on records spread over the archive; the records' own beginnings
    where there are too few to train on."""
    step = max(1, len(records) // 256)
    samples = [r[: 8 << 10] for r in records[::step]]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(r[:2048] for r in samples)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary's frame, then a frame a record."""
    learned = dictionary(records)
    stored = min(learned, zstandard.ZstdCompressor(level=19).compress(learned), key=len)
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(learned), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(stored)), stored, *map(writer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and block headers."""
    if len(data) - at < 9:
        raise ValueError(f"truncated frame at byte {at}")
    head = bytes(data[at : at + 18])
    try:
        params, size = zstandard.get_frame_parameters(head), zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame at byte {at}: {e}") from e
    at += size
    while True:
        if at + 3 > len(data):
            raise ValueError("truncated block header")
        header = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            break
    at += 4 * params.has_checksum
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time."""
    data = memoryview(content)
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != SKIPPABLE:
        raise ValueError("an archive begins with a skippable frame that holds its dictionary")
    size = struct.unpack("<I", data[4:8])[0]
    if 8 + size > len(data):
        raise ValueError("truncated dictionary")
    stored = bytes(data[8 : 8 + size])
    if stored[:4] == b"\x28\xb5\x2f\xfd":
        stored = zstandard.ZstdDecompressor().decompress(stored)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        declared = zstandard.get_frame_parameters(bytes(data[at : at + 18])).content_size
        if declared > LONGEST_RECORD:  # also where it isn't stated
            raise ValueError(f"the frame at byte {at} states no size or too large a one")
        raw = reader.decompress(bytes(data[at:end]), allow_extra_data=False)
        if len(raw) != declared:
            raise ValueError(f"the frame at byte {at} isn't as long as it states")
        yield raw
        at = end


def parse(raw: bytes) -> dict:
    """A validated record: its headers by lower-case name, page id, payload facts."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line!r}")
        if name.lower() in headers:
            raise ValueError(f"{name} is there twice")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d{1,9})?Z", headers["warc-date"]):
        raise ValueError("WARC-Date isn't a date")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()) or int(length) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length isn't the block's length")
    block = rest[:-4]
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not found or not size:
        raise ValueError("the block has no HTTP header with a length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload isn't what length and digest say")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers or "warc-profile" not in headers):
        raise ValueError("a revisit has a profile and a target and no payload")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind}")
    return {"headers": headers, "page_id": _number(headers["warc-record-id"]), "type": kind, "refers_to": _number(headers.get("warc-refers-to", "")), "length": int(size[1]), "digest": digest, "payload": payload}


def _number(uri: str) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?\d+)>", uri)
    return int(m[1]) if m else None


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The archives of all rows as a written table (archive, content).

    Which records revisit which is found by digest: an aggregation that keeps, of payloads that
    several rows have, the largest id, joined back on the digest. These digests are written first: few of
    them go to every task, so that payloads stay where they are; more are joined by a shuffle.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    again = rows.where(F.col("length") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    again = materialize(again, "again")
    marked = rows.join(if_few(again), "digest", "left").withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            content = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.zst"]), pa.array([content], type=pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, link, body, length, digest, refers_to = (batch.column(k)[i].as_py() for k in range(6))
                held.append(record(page_id, link, body, length, digest, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    made = marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.col("length").cast("long"), "digest", "refers_to")
    archives = materialize(made.mapInArrow(run, "archive string, content binary"), "archives")
    release(again)
    return archives


def read(archives: DataFrame) -> DataFrame:
    """The records of archives: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and payload (null in revisits). A record that doesn't hold up is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in records_of(content.as_py()):
                    r = parse(raw)
                    rows.append({"page_id": r["page_id"], "url": r["headers"].get("warc-target-uri"), "record_type": r["type"], "refers_to": r["refers_to"], "payload_bytes": r["length"], "payload_digest": r["digest"], "payload": r["payload"] if r["type"] == "response" else None})
                    if len(rows) == 1000:
                        yield from pa.Table.from_pylist(rows, schema=schema).to_batches()
                        rows = []
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
