"""WARC archives of web records, Zstandard-compressed with a dictionary of their own.

Each archive is written by one task from a bounded run of records: a dictionary is built from the archive's own records and
stands, as a Zstandard frame, inside a leading skippable frame; then every record is compressed alone with it, so that any
record can be read from its offset. Archives are rows of a table in the shared folder (name, first offsets, bytes); files()
unloads them as .warc.zst files.

Equal payloads (same SHA-1 and length) of at least `least_bytes` bytes are stored once: the record with the largest id is
the response, the others revisit it. Only ids, digests and lengths are grouped, with map-side maxima, so a payload shared by
a third of all rows is no single task's; the ids of revisits then meet the rows, which stay where they are while Spark finds those ids small
enough to broadcast, and else move once, by their ids.

A response's block is an HTTP head and the payload. Edge cases: a null payload is an empty one; a null url has no target header and
reads back as null; a row without an id is always a response; a repeated id gives a record for each row, and a group's response is each row
with the largest id; an empty table gives no archives; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import slices, small_batches, written

#: Fixed values of the formats: the skippable frame of a dictionary, record heads.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date of their own
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
ARCHIVE_BYTES = 4 << 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit has no block and names the response that has it."""
    block = b"" if refers_to is not None else HTTP.format(len(payload)).encode() + payload
    head = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{'' if key is None else key}>",
        *(["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")] if url is not None else []),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a spread of the records, empty where there is too little to learn from."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    chosen = [r[: 64 << 10] for r in records[::step]]
    if len(chosen) < 8 or sum(map(len, chosen)) < 8 * size:
        return b"".join(chosen)[-size:]  # a raw-content dictionary
    try:
        return zstandard.train_dictionary(size, chosen).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[-size:]


def write_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of one .warc.zst archive."""
    words = build_dictionary(records)
    frame = zstandard.ZstdCompressor(level=19).compress(words)
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
    return lead + b"".join(map(packer.compress, records))


def read_archive(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size]) if size else b""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest = memoryview(archive)[8 + size :]
    while rest:
        one = unpacker.decompressobj()
        parts, at = [], 0
        while not one.eof:
            part = rest[at : at + (1 << 16)]
            if not part:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(part))
            at += len(part)
        rest = rest[at - len(one.unused_data) :]
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != VERSION or block[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, block[:size]


def deduplicated(df: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """key, url, payload (binary), payload_bytes, sha1 (hex) and refers_to: null for a response."""
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    marked = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    ids = marked.where(F.col("payload_bytes") >= least_bytes).select("key", "sha1", "payload_bytes")
    groups = ids.groupBy("sha1", "payload_bytes").agg(F.max("key").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = written(ids.join(groups, ["sha1", "payload_bytes"]).where("response > key").select("key", "sha1", F.col("response").alias("refers_to")).distinct(), "revisits")
    return (
        marked.join(revisits, ["key", "sha1"], "left")
        .withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
        .select("key", "url", "payload", "payload_bytes", "sha1", "refers_to")
    )


def archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """deduplicated() rows as archives of about `archive_bytes`: archive (name), n_records, content."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", archive_bytes):
            rows = batch.to_pylist()
            packed = write_archive([record_bytes(r["key"], r["url"], r["payload"] or b"", base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["payload_bytes"], r["refers_to"]) for r in rows])
            yield pa.record_batch([pa.array([f"{rows[0]['key']}-{hashlib.sha1(packed).hexdigest()[:16]}"]), pa.array([len(rows)], pa.int64()), pa.array([packed], pa.binary())], ["archive", "n_records", "content"])

    return small_batches(records).mapInArrow(write, "archive string, n_records long, content binary")


def write(df: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Write every row of df into archives in the shared folder; returns the table of archives."""
    return written(archives(deduplicated(df, key, url, payload, least_bytes)), "warc")


def read(table: DataFrame) -> DataFrame:
    """The records of a table of archives: key, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""

    def number(text: str | None) -> int | None:
        digits = (text or "").rpartition(":")[2].rstrip(">")
        return int(digits) if digits else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, block in map(parse_record, read_archive(content.as_py())):
                    response = f["WARC-Type"] == "response"
                    size = int(f["X-Payload-Length"])
                    body = block.partition(b"\r\n\r\n")[2]
                    if "sha1:" + digest_of(block) != f["WARC-Block-Digest"] or response and (len(body) != size or "sha1:" + digest_of(body) != f["WARC-Payload-Digest"]):
                        raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                    out.append((number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), body if response else None, size, f["WARC-Payload-Digest"][5:], f["WARC-Type"], number(f.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return table.select("content").mapInArrow(unpack, "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def files(table: DataFrame, folder: str) -> None:
    """Unload archives as <folder>/<archive>.warc.zst; the folder must be one that all executors mount."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                with open(f"{folder}/.{row['archive']}", "wb") as out:
                    out.write(row["content"])
                os.replace(f"{folder}/.{row['archive']}", f"{folder}/{row['archive']}.warc.zst")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    table.select("archive", "content").mapInArrow(save, "n long").agg(F.sum("n")).first()
