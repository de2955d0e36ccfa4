"""WARC archives in Zstandard with a dictionary of their own.

Each archive file begins with a skippable frame that holds the dictionary, trained on a bounded sample: the
file's first records up to ``train_bytes`` (1 MiB), of each its first ``SAMPLE_BYTES`` (128 KiB).  Pages are
dealt to files by a hash of their ids, so these are no special ones.  Every record follows as one frame of its own, compressed with it, so a reader can seek to any
record.  Records with equal payloads (SHA-1) are written once as ``response``; the others are ``revisit``
records that name it.

Plan: digests are taken in the JVM; the smallest page of each digest is a grouped minimum, which sums in
each task before its shuffle, so a digest that a third of the pages share gathers nowhere.  Only markers of
revisits (page, digest, response) then meet the payloads, in one shuffle by page id; each task streams its
sorted rows into files that are closed at ``roll_bytes``.  A file is written under a name of its own attempt
and counts only if it is in the manifest table, which Spark commits; files of lost attempts are never read.

The folder is reached through ``pyarrow.fs`` (file, hdfs, s3, gs by their URIs); it must be shared.

Defined results: a null payload is empty; equal empty payloads are revisits like others; a null URL gives an
empty target; repeated rows with equal payload: one is the response, the others revisit the same page id;
null page ids come last, and a payload that only such pages have has one of them as response
(``refers_to`` is then null).  A file with under 16 records or 8 KiB to train on has no dictionary frame.
Empty tables give no files; other columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, settle, shared_folder, text_bytes

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Of one record, what the dictionary is trained on at most.
SAMPLE_BYTES = 1 << 17

MANIFEST = "path string, records long, bytes long, dictionary_bytes long"


def record_id(page_id: int | None, serial: int = 0) -> str:
    """A version 8 UUID that holds the page id; pages without one get their serial in the file, marked."""
    value = (serial if page_id is None else page_id) & (1 << 64) - 1
    bits = (1 << 127 if page_id is None else 0) | (8 << 76) | (value >> 62 << 64) | (2 << 62) | (value & (1 << 62) - 1)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int | None:
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if bits >> 127:
        return None
    value = (bits >> 64 & 3) << 62 | bits & (1 << 62) - 1
    return value - (1 << 64) if value >> 63 else value


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, revisit: bool, refers_to: int | None, serial: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit with the same HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, serial)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    if len(records) < 16 or sum(map(len, records)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=256, d=8)
    except zstandard.ZstdError:
        return None


class _File:
    """One archive: records are held until there are enough to train on, then everything is streamed."""

    def __init__(self, system, path: str, level: int, dictionary_bytes: int, train_bytes: int):
        self.system, self.path, self.level, self.size, self.train_bytes = system, path, level, dictionary_bytes, train_bytes
        self.held: list[bytes] = []
        self.held_bytes = self.records = self.bytes = self.dictionary = 0
        self.out = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.held.append(record)
            self.held_bytes += len(record)
            if self.held_bytes >= self.train_bytes:
                self._start()
        else:
            self._put(self.compressor.compress(record))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        trained = train_dictionary([r[:SAMPLE_BYTES] for r in self.held], self.size)
        self.out = self.system.open_output_stream(self.path, compression=None)
        if trained is not None:
            raw = trained.as_bytes()
            self.dictionary = len(raw)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for record in self.held:
            self._put(self.compressor.compress(record))
        self.held = []

    def close(self) -> tuple[str, int, int, int]:
        if self.out is None:
            self._start()
        self.out.close()
        return self.path, self.records, self.bytes, self.dictionary


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        names = b.schema.names
        columns = [b.column(i) for i in range(len(names))]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                   least_revisit_bytes: int = 0, files: int | None = None, level: int = 3, dictionary_bytes: int = 1 << 15, train_bytes: int = 1 << 20, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the committed manifest: path, records, bytes, dictionary_bytes."""
    spark = pages.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    page = pages.select(F.col(id_column).cast("bigint").alias("page"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), text_bytes(payload_column).alias("payload"))
    digest = page.select("page", F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("n")).filter(F.col("n") >= least_revisit_bytes)
    same = digest.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    others = digest.drop("n").join(same, "digest").filter(~F.col("page").eqNullSafe(F.col("first")))
    markers = others.groupBy("page", "digest").agg(F.min("first").alias("first"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    salt = lambda digest: F.when(F.col("page").isNull(), F.crc32(digest)).otherwise(0).alias("salt")  # noqa: E731  pages without an id are dealt by payload
    both = markers.select("page", salt(F.col("digest")), F.lit(0).alias("kind"), none("string", "url"), "digest", "first").unionByName(
        page.select("page", salt(F.unhex(F.sha1("payload"))), F.lit(1).alias("kind"), "url", F.col("payload").alias("digest"), none("bigint", "first")))
    dealt = both.repartition(files, "page", "salt").drop("salt").sortWithinPartitions("page", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        attempt, done, now, page, first, seen = uuid.uuid4().hex, [], None, object(), {}, set()
        for page_id, kind, url, data, response in _rows(batches):
            if page_id != page:
                page, first, seen = page_id, {}, set()
            data = as_bytes(data)
            if kind == 0:
                first[data] = response
                continue
            sha = hashlib.sha1(data, usedforsecurity=False).digest()
            again = sha in seen and len(data) >= least_revisit_bytes
            revisit = sha in first or again
            seen.add(sha)
            if now is None:
                now = _File(system, f"{root}/{attempt}-{len(done):05d}.warc.zst", level, dictionary_bytes, train_bytes)
            now.add(warc_record(page_id, url, data, base64.b32encode(sha).decode(), revisit, first.get(sha, page_id), now.records))
            if now.bytes + now.held_bytes >= roll_bytes:
                done.append(now.close())
                now = None
        if now is not None:
            done.append(now.close())
        for row in done:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["path", "records", "bytes", "dictionary_bytes"])

    return settle(dealt.mapInArrow(write, MANIFEST), "warc-manifest").withColumn("folder", F.lit(folder))


def read_frames(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of one archive, read in chunks: only the dictionary and one record are held."""
    held, dictionary, reader = b"", None, None

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            data = source.read(max(chunk, n - len(held)))
            if not data:
                return False
            held += data
        return True

    while more(4):
        (magic,) = struct.unpack_from("<I", held)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not more(8) or not more(8 + (length := struct.unpack_from("<I", held, 4)[0])):
                raise ValueError("truncated skippable frame")
            body, held = held[8 : 8 + length], held[8 + length :]
            if magic == DICTIONARY_FRAME and reader is None:
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME_MAGIC else body)
            continue
        if held[:4] != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        if reader is None:
            reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdDecompressor()
        step, parts = reader.decompressobj(), []
        while True:
            parts.append(step.decompress(held))
            if step.eof:
                held = step.unused_data
                break
            held = source.read(chunk)
            if not held:
                raise ValueError("truncated frame")
        yield b"".join(parts)
    if held:
        raise ValueError("trailing bytes")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields (lower-cased names), HTTP head and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record must end after its content")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest``; ``intact``: the payload has the digest and length that its record states (null for revisits)."""
    schema = _READ if with_payload else _READ.removesuffix(", payload binary")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, folder in _rows(batches):
            system, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            rows, size = [], 0
            with system.open_input_stream(path, compression=None) as source:
                for record in read_frames(source):
                    fields, http, payload = parse_record(record)
                    stated = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), 0)
                    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                    intact = None if revisit else len(payload) == stated and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() == digest
                    refers = page_of(fields["warc-refers-to"]) if revisit else None
                    row = (page_of(fields["warc-record-id"]), fields.get("warc-target-uri", ""), fields["warc-type"], stated, digest, refers, intact)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(payload) + 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path", "folder").repartition(max(n, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, schema)


def archive_folder(spark) -> str:
    return os.path.join(shared_folder(spark, "warc"), "archives")
