"""WARC archives as seekable Zstandard bundles, with an index from record ids to frame-relative offsets.

A bundle is a run of independent Zstandard frames, each with whole WARC records, and a last skippable frame
with the seek table (the public seekable format: sizes and checksum of each frame, then the frame count,
a descriptor and the magic number). A record is read by its frame and its offset in the unpacked frame.
Bundles are rows of a table, so that any file system that Spark reaches can hold them; export_files()
writes them out as .warc.zst files where the executors share a mounted folder.
"""

from __future__ import annotations

import hashlib
import os
import struct
import urllib.parse
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import work_path

# Fixed values of the public formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-record:"

BUNDLES = "bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"
ARROW_BUNDLES = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record if refers_to is given: its block ends before the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, bytes | None, int]:
    """The record at an offset: headers, payload length, payload (None for a revisit), where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(headers["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    http = dict(x.split(": ", 1) for x in data[start : body - 4].decode().split("\r\n")[1:])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record has no end")
    payload = None if headers["WARC-Type"] == "revisit" else data[body : start + size]
    return headers, int(http["Content-Length"]), payload, start + size + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The last skippable frame: (packed size, unpacked size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Of each frame: where it begins, its packed and unpacked sizes and checksum are read from the end of the bundle."""
    count, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS:
        raise ValueError("no seek table")
    table = data[len(data) - 9 - 12 * count : -9]
    found, at = [], 0
    for packed, _, check in struct.iter_unpack("<III", table):
        found.append((at, packed, check))
        at += packed
    return found


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, check = frame
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed])
    if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum differs")
    return raw


class Bundle:
    """A bundle under construction: only packed frames and one open frame are held."""

    def __init__(self):
        self.packed, self.table, self.open, self.index, self.size, self.digest = [], [], bytearray(), [], 0, hashlib.blake2b(digest_size=12)

    def add(self, record_id: str, raw: bytes) -> None:
        self.index.append((record_id, len(self.packed), len(self.open), len(raw)))
        self.open += raw

    def close_frame(self) -> None:
        if self.open:
            raw = bytes(self.open)
            frame = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(raw)
            self.digest.update(frame)
            self.packed.append(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(frame)
            self.open = bytearray()

    def batch(self) -> pa.RecordBatch:
        self.close_frame()
        ids, frames, offsets, lengths = zip(*self.index, strict=True)
        row = [self.digest.hexdigest(), b"".join(self.packed) + seek_table(self.table), list(ids), list(frames), list(offsets), list(lengths)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, ARROW_BUNDLES.types, strict=True)], schema=ARROW_BUNDLES)


def write_bundles(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Archive every row as a WARC record; returns the bundles as a table at `path` (or in the shared folder).

    Of records with equal payloads of at least min_revisit bytes the one with the smallest id is a response and
    the others revisit it. Payloads are UTF-8, null is empty; a null id is an empty one in the archive and never
    the smallest (where all ids of a payload are null, all are responses); a null url has no target header; rows
    that repeat the smallest id are all responses. Other columns are ignored. An empty table gives an archive
    without bundles. A payload is one row of one task and has to fit its Python worker.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    firsts = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = rows.join(firsts, "digest", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload", F.lower(F.hex("digest")).alias("digest"), F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to")
    )

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        for batch in batches:
            for rid, url, text, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                bundle.add(rid.as_py(), record(rid.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), refers.as_py(), date))
                if len(bundle.open) >= frame_bytes:
                    bundle.close_frame()
                if bundle.size >= bundle_bytes:
                    yield bundle.batch()
                    bundle = Bundle()
        if bundle.index:
            yield bundle.batch()

    path = path or work_path(spark, "warc")
    # small row groups: a reader holds a row group at a time, and these rows are megabytes
    marked.mapInArrow(bundled, BUNDLES).write.option("parquet.block.size", 4 * bundle_bytes).option("compression", "none").parquet(path)
    return read_bundles(spark, path)


def read_bundles(spark, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def _ids() -> F.Column:
    """The archive's ids with null for the empty one, which stands for it there."""
    return F.transform("record_ids", lambda x: F.when(x != "", x)).alias("record_ids")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset (in the unpacked frame), length: where each record lies. Reads no data."""
    each = F.explode(F.arrays_zip(_ids(), F.col("frames"), F.col("offsets"), F.col("lengths"))).alias("r")
    return bundles.select("bundle", each).select(F.col("r.record_ids").alias("record_id"), "bundle", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


READ = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, bundle string, frame int, offset int, payload binary"


def read_records(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles, cut out at its index entry; a record that isn't what the index says is an error.

    Frames are unpacked one after another, each by its place in the seek table, and held one at a time. A response's
    digest is taken from its payload and must agree. The empty id of the archive comes back as null. A very long
    payload makes a frame of its own, which one Python worker holds with its record.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("payload", pa.binary())])
    bare = lambda headers, h: headers[h][1:-1].removeprefix(RECORD_ID) if h in headers else None

    def row(raw: bytes, name: str, entry: tuple) -> tuple:
        rid, frame, offset, length = entry
        headers, n, payload, end = parse(raw, offset)
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if bare(headers, "WARC-Record-ID") != rid or end != offset + length:
            raise ValueError(f"{headers['WARC-Record-ID']}: the index has {rid} here")
        if payload is not None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload isn't what was archived")
        return rid or None, headers["WARC-Type"], headers.get("WARC-Target-URI"), n, digest, bare(headers, "WARC-Refers-To"), name, frame, offset, payload if with_payload else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob, *index in zip(*(batch.column(i) for i in range(6)), strict=True):
                name, data = name.as_py(), blob.as_py()
                table = read_seek_table(data)
                for k, entries in groupby(zip(*(x.as_py() for x in index), strict=True), key=lambda e: e[1]):
                    raw = read_frame(data, table[k])
                    rows = [row(raw, name, e) for e in entries]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return bundles.select("bundle", "data", "record_ids", "frames", "offsets", "lengths").mapInArrow(read, READ)


def fetch(bundles: DataFrame, wanted: DataFrame, id_col: str = "record_id") -> DataFrame:
    """record_id and record (the WARC bytes) of the wanted ids: unpacks only the frames that hold them."""
    found = record_index(bundles).join(wanted.select(F.col(id_col).cast("string").alias("record_id")).distinct(), "record_id")
    asked = found.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length", "record_id")).alias("at"))  # a bundle's records at most
    schema = pa.schema([("record_id", pa.string()), ("record", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = blob.as_py()
                table, frame, raw, rows = read_seek_table(data), -1, b"", []
                for x in sorted(at, key=lambda x: (x["frame"], x["offset"])):
                    if x["frame"] != frame:
                        frame, raw = x["frame"], read_frame(data, table[x["frame"]])
                    rows.append((x["record_id"], raw[x["offset"] : x["offset"] + x["length"]]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return bundles.join(asked, "bundle").select("data", "at").mapInArrow(cut, "record_id string, record binary")


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as <bundle>.warc.zst into a folder that all executors have mounted; returns file and bytes.

    Names follow from the content and files appear whole, so a task that runs again writes the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path, data = f"{folder}/{name}.warc.zst", blob.as_py()
                with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.record_batch({"file": [path], "bytes": pa.array([len(data)], pa.int64())})

    return bundles.select("bundle", "data").mapInArrow(write, "file string, bytes long")
