"""Zstandard WARC archives: a writer and a reader.

An archive starts with a skippable frame that holds the dictionary its frames were compressed with (magic 0x184D2A5D, fixed
value of the format), followed by one Zstandard frame per record. Records are WARC/1.1: ``response`` records carry an HTTP
response with the page as payload, ``revisit`` records only its HTTP header and point at the response with the same payload.
Files are written to and read from the shared folder through its file system, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.workspace import fresh_path, stage

DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, ordinal: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{ordinal}>"


def page_of(record: str | None) -> int | None:
    """The page id inside a record id; None for records of pages without one."""
    if record is None:
        return None
    page = record.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def record_bytes(page_id: int | None, ordinal: int, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed WARC record. A URL is kept to one header line by percent-encoding its control characters."""
    named = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in url or "")
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, ordinal)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{named}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class InvalidRecord(ValueError):
    """A frame, header or length that breaks the format."""


def parse_record(data: bytes) -> dict:
    """Headers, type and payload facts of one record; raises InvalidRecord for anything malformed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] != VERSION:
        raise InvalidRecord("no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise InvalidRecord(f"malformed or repeated header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "content-length", "warc-payload-digest", "warc-block-digest"} - set(headers)
    if missing or not headers["content-length"].isdigit():
        raise InvalidRecord(f"missing headers {sorted(missing)} or bad length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise InvalidRecord(f"block of {len(rest) - 4} bytes, header says {length}")
    block = rest[:length]
    if headers["warc-block-digest"] != f"sha1:{digest(block)}":
        raise InvalidRecord("block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
    named = headers["warc-payload-digest"].removeprefix("sha1:")
    kind, size = headers["warc-type"], int(fields["Content-Length"])
    if kind == "response":
        if size != len(payload) or named != digest(payload):
            raise InvalidRecord("payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise InvalidRecord(f"record type {kind!r} with {len(payload)} payload bytes")
    return {
        "record_type": kind, "record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri", ""),
        "payload": payload, "payload_bytes": size, "payload_digest": named, "refers_to": headers.get("warc-refers-to"),
    }


def filesystem(path: str):
    """The file system of a folder and the path inside it; local, HDFS and object stores alike."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path)
    return fs.LocalFileSystem(), path


class ArchiveWriter:
    """Writes records to archives of about ``limit`` compressed bytes. The dictionary of an archive is trained on its first
    records (up to ``SAMPLE_BYTES``), which wait until then; small archives go without a trained one."""

    def __init__(self, folder: str, limit: int):
        self.store, self.folder, self.limit = *filesystem(folder), limit
        self.store.create_dir(self.folder, recursive=True)
        self.waiting, self.held, self.file, self.done = [], 0, None, []

    def add(self, record: bytes) -> None:
        if self.file is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(record)
        if self.file is not None and self.size >= self.limit:
            self._close()

    def _open(self) -> None:
        import zstandard

        self.name, self.size, self.count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
        samples, dictionary = [r[:65536] for r in self.waiting], b""
        if len(samples) >= 16:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
            except zstandard.ZstdError:  # too little or too uniform material for a dictionary
                dictionary = b""
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        self.file = self.store.open_output_stream(f"{self.folder}/{self.name}")
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        for record in self.waiting:
            self._put(record)
        self.waiting, self.held = [], 0

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def _put(self, record: bytes) -> None:
        self._write(self.press.compress(record))
        self.count += 1

    def _close(self) -> None:
        self.file.close()
        self.done.append((f"{self.folder}/{self.name}", self.count, self.size))
        self.file = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._open()
        if self.file is not None:
            self._close()
        return self.done


def read_archive(file: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed records of an archive, one frame each, held one at a time."""
    import zstandard

    head = file.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise InvalidRecord("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = file.read(size)
    if len(dictionary) != size:
        raise InvalidRecord("dictionary frame cut short")
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpress = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        rest = rest or file.read(chunk)
        if not rest:
            return
        while len(rest) < 4 and (more := file.read(chunk)):
            rest += more
        if len(rest) < 4 or struct.unpack("<I", rest[:4])[0] != FRAME:
            raise InvalidRecord("not a Zstandard frame")
        frame, parts = unpress.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = file.read(chunk)
            if not rest:
                raise InvalidRecord("frame cut short")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id, url, html``; other columns ignored) below ``folder``; returns the
    manifest ``path, records, bytes`` of the finished archives.

    The payload is the html in UTF-8, null is empty. Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest ``page_id`` (nulls last; of repeated rows one) is the response and the others revisit it, shorter ones are all
    responses. Each archive is named by chance and enters the manifest only when its task has ended, so a lost or
    repeated task leaves at most files nobody lists. An empty table writes none.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("ordinal", F.monotonically_increasing_id())
    named = keyed.withColumn("name", F.sha2("payload", 256))
    first = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("ordinal"))
    sizes = named.filter(F.length("payload") >= min_bytes).groupBy("name").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = sizes.filter("n > 1").select(F.col("name").alias("known"), "first")
    rows = named.join(repeated, F.col("name") == F.col("known"), "left").select(
        "page_id", "ordinal", "url", "payload",
        F.when(F.col("first.ordinal") != F.col("ordinal"), F.col("first.page_id")).alias("refers_page"),
        F.when(F.col("first.ordinal") != F.col("ordinal"), F.col("first.ordinal")).alias("refers_ordinal"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, archive_bytes)
        for batch in batches:
            for page, ordinal, url, body, ref_page, ref in zip(*(batch.column(i) for i in range(6))):
                refers = record_id(ref_page.as_py(), ref.as_py()) if ref.is_valid else None
                writer.add(record_bytes(page.as_py(), ordinal.as_py(), url.as_py(), body.as_py(), refers))
        done = writer.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the listed archives: ``record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to`` (a
    record id), with ``payload`` if asked for. Every frame, header, length and digest is checked; a task fails on
    the first that does not hold. A file is read by one task, and files are bounded by their writer."""
    fields = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path) as file:
                    for data in read_archive(file):
                        seen += 1
                        rows.append(parse_record(data))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                if seen != count:
                    raise InvalidRecord(f"{path}: {seen} records, the manifest says {count}")
                if rows:
                    yield _batch(rows, fields)

    kinds = {"payload_bytes": "long", "payload": "binary"}
    schema = ", ".join(["page_id long"] + [f"{f} {kinds.get(f, 'string')}" for f in fields])
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("path", "records").repartition(parts, "path").mapInArrow(run, schema)


def _batch(rows: list[dict], fields: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    pages = pa.array([page_of(r["record_id"]) for r in rows], pa.int64())
    columns = [pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in fields]
    return pa.RecordBatch.from_arrays([pages, *columns], ["page_id", *fields])


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives and read back."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    target = fresh_path(spark, "archives")
    records = read_archives(write_archives(pages, target), target)
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(refers != "", refers.cast("long")).alias("refers_to"), "url",
    )


QUERIES = {"op3_warc": op3_warc}
SQL = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (SELECT *, sha1(html) AS hex FROM p),
bits AS (
  SELECT page_id, url, html, first, string_agg(lpad(bin(('0x' || hex[2 * i - 1:2 * i])::INT), 8, '0'), '' ORDER BY i) AS b
  FROM d, range(1, 21) r(i) GROUP BY ALL
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ('0b' || b[5 * k + 1:5 * k + 5])::INT]), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM bits
"""
}
