"""WARC archives as Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Pages are written by Spark tasks, one or more archives each, and listed in a manifest table. Only the archives of
tasks that Spark committed are in the manifest, so retried and speculative tasks leave no double records. Reading
takes one archive at a time as a stream, checks every header, length and digest, and fails on the first that is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.session import scratch_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 16
RESULT = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


class WarcError(ValueError):
    """An archive that is not what its headers say."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as tasks see it: local folders, and whatever pyarrow reaches by its URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Each page with its payload and the page it refers to (NULL for a response).

    Equal payloads meet by digest and length: the group's largest id is found with map-side combining and joined
    back, a sort-merge join whose hot digests adaptive execution splits. Rows that repeat the largest id are
    responses too; a NULL id takes part as a revisit where its group has an id, else as a response.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"_sha": F.sha1("payload"), "_len": F.octet_length("payload")})
    first = rows.where(F.col("_len") >= min_bytes).groupBy("_sha", "_len").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    joined = rows.join(first.where("_n > 1 AND _first IS NOT NULL").drop("_n"), ["_sha", "_len"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose length is that of the full payload, and no body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))
    if revisit:
        fields |= {"WARC-Refers-To": f"<urn:x-page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    fields["Content-Length"] = str(len(block))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items()).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from an archive's first records; none where they are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive; the dictionary is trained on at most ``sample_bytes`` of its first records."""

    def __init__(self, stream, dictionary_bytes: int = 32768, sample_bytes: int = 1 << 20):
        self.stream, self.dictionary_bytes, self.sample_bytes = stream, dictionary_bytes, sample_bytes
        self.waiting: list[bytes] = []
        self.size, self.records, self.compressor = 0, 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.compressor:
            self.stream.write(self.compressor.compress(data))
        else:
            self.waiting.append(data)
            if self.size >= self.sample_bytes:
                self._start()

    def _start(self) -> None:
        learned = trained_dictionary(self.waiting, self.dictionary_bytes)
        options = {"level": 3, "write_checksum": True, "write_content_size": True}
        if learned:
            packed = zstandard.ZstdCompressor().compress(learned)
            self.stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            options["dict_data"] = zstandard.ZstdCompressionDict(learned)
        self.compressor = zstandard.ZstdCompressor(**options)
        for data in self.waiting:
            self.stream.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.stream.close()


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 1 << 27) -> DataFrame:
    """Write the rows of ``with_roles`` below ``folder`` and return the manifest (archive, records, bytes).

    A task starts a new archive after ``archive_bytes`` of records. File names are never reused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        writer, name, done = None, "", []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                writer.add(record(row["page_id"], row["url"], row["payload"], row["refers_to"]))
                if writer.size >= archive_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", writer.records, writer.size))
                    writer = None
        if writer:
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.size))
        columns = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                         names=["archive", "records", "bytes"])

    spark = rows.sparkSession
    schema = "archive string, records bigint, bytes bigint"
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    head = stream.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        length = struct.unpack("<I", head[4:])[0]
        data = stream.read(length)
        if len(data) != length:
            raise WarcError("the dictionary frame is cut short")
        if data[:4] == FRAME_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        known, head = zstandard.ZstdCompressionDict(data), b""
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    rest = head or stream.read(CHUNK)
    while rest:
        one, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as error:
                raise WarcError(f"not a frame: {error}") from error
            if one.eof:
                rest = one.unused_data or stream.read(CHUNK)
                break
            rest = stream.read(CHUNK)
            if not rest:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields and payload of one frame's record; raises where headers, lengths or digests disagree."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise WarcError(f"no {VERSION.decode()} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"bad or repeated header line: {name[:80]}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(fields)
    if missing:
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: the block is not {length} bytes, or another record follows in its frame")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError(f"{fields['warc-record-id']}: block digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    sizes = [line.split(b":")[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not mark or len(sizes) != 1 or not sizes[0].isdigit():
        raise WarcError(f"{fields['warc-record-id']}: HTTP header")
    size, kind = int(sizes[0]), fields["warc-type"]
    if kind == "response":
        if len(payload) != size or fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise WarcError(f"{fields['warc-record-id']}: payload length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
        raise WarcError(f"{fields['warc-record-id']}: record of type {kind}")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _page(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    if name and not name.lstrip("-").isdigit():
        raise WarcError(f"unknown record id {identifier[:80]}")
    return int(name) if name else None


def read_archives(manifest: DataFrame, payloads: bool = True, rows_per_batch: int = 256) -> DataFrame:
    """Every record of the archives a manifest lists; record counts are checked against it."""
    columns = [c for c in RESULT.split(", ") if payloads or not c.startswith("payload binary")]
    names = [c.split()[0] for c in columns]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                store, path = open_store(entry["archive"])
                kept, count = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        count += 1
                        kept.append({k: v for k, v in parse_record(data).items() if k in names})
                        if len(kept) >= rows_per_batch:
                            yield pa.RecordBatch.from_pylist(kept, schema=schema)
                            kept = []
                if count != entry["records"]:
                    raise WarcError(f"{entry['archive']}: {count} records, the manifest says {entry['records']}")
                if kept:
                    yield pa.RecordBatch.from_pylist(kept, schema=schema)

    archives = manifest.count()
    spread = manifest.repartition(max(1, archives), "archive")
    return spread.mapInArrow(run, ", ".join(columns))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write every page, read the archives back. An empty table gives no rows; repeated rows give a record each."""
    manifest = write_archives(with_roles(pages, min_bytes=min_bytes), scratch_path(spark, "warc"))
    return read_archives(manifest, payloads)


def base32_sha1_sql(column: str) -> str:
    """DuckDB SQL for the bare base32 SHA-1 of a blob column: five hex digits make four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> s) & 31 AS INT), 1)"
    group = f"list_transform([15, 10, 5, 0], lambda s: {letter})"
    value = f"CAST('0x' || substr(sha1({column}), 1 + 5 * CAST(g AS INT), 5) AS BIGINT)"
    return f"list_aggregate(flatten(list_transform(list_transform(range(0, 8), lambda g: {value}), lambda v: {group})), 'string_agg', '')"
