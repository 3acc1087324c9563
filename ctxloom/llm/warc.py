"""WARC records in seekable Zstandard bundles.

Records are grouped into independent zstd frames of about ``FRAME`` bytes; a
seek table (compressed and full size of each frame) stands in a skippable frame
at the end of the bundle, as the public seekable format has it, so any zstd
reader can read the whole bundle and ours reads one frame.  ``write`` returns
the index: record identifier -> bundle, frame, offset within the frame's full
bytes, length.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the
smallest key is the response, the others are revisits of it without payload.
Digests are grouped with a partial aggregate, and only digests that occur twice
are joined to the pages (Spark splits a hot digest in that join), so a group of
copies of any size is spread over tasks.

A null payload is empty.  Rows that repeat the smallest key of a payload are
all responses (they share a record identifier); a row without a key revisits the
smallest key, and is a response where there is none.  A null target URI is left
out of the record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import store
from ctxloom.llm.textops import slices
from ctxloom.session import materialize, ship_package

FRAME = 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122
_UNSAFE = re.compile(r"[\x00-\x20\x7F]")


def record_id(key, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{digest}')}"


def record(key, uri: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """A response, or with ``refers_to`` a revisit, as WARC/1.1 bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(key, digest)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Page-ID: {key}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, payload, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(fields["Content-Length"])
    block = data[stop + 4:end]
    return fields, block[block.index(b"\r\n\r\n") + 4:], end + 4


class BundleWriter:
    def __init__(self, out, frame: int = FRAME):
        self.out, self.frame = out, frame
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.parts, self.size, self.table = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        place = len(self.table), self.size
        self.parts.append(data)
        self.size += len(data)
        if self.size >= self.frame:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.size:
            packed = self.zip.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Reads frames by number through the seek table."""

    def __init__(self, f):
        self.f, end = f, f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        f.seek(end - 9 - 8 * n)
        self.table = np.frombuffer(f.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]

    def frame(self, k: int) -> bytes:
        self.f.seek(int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(self.f.read(int(self.table[k, 0])))


def write(pages: DataFrame, out_dir: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0,
          frame: int = FRAME) -> DataFrame:
    """Write a bundle per partition; returns the index: record_id, key, archive, frame, offset, length."""
    ship_package(pages.sparkSession)
    src = pages.select(F.col(key).alias("_key"), F.col(uri).cast("string").alias("_uri"), F.coalesce(F.col(payload), F.lit("")).alias("_text"))
    src = src.withColumn("_sha", F.sha1(F.col("_text").cast("binary")))
    twice = (src.where(F.octet_length("_text") >= min_bytes).groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
             .where("_n > 1 AND _first IS NOT NULL").drop("_n"))
    marked = src.join(twice, "_sha", "left").select("_key", "_uri", "_sha", F.when(~F.col("_key").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"), "_text")
    schema = marked.select(F.lit("").alias("record_id"), F.col("_key").alias(key), F.lit("").alias("archive"), F.lit(0).alias("frame"),
                           F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = slices(batches, "_text", 4 << 20)
        b = next(parts, None)
        if b is None:
            return
        task = TaskContext.get()
        # a name of this attempt: the index names the file it was written with
        path = f"{out_dir}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        with store.writing(path) as f:
            bundle = BundleWriter(f, frame)
            while b is not None:
                rows = []
                for k, u, sha, refers, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    data = record(k, u, text.encode(), digest, refers)
                    rows.append((record_id(k, digest), *bundle.add(data), len(data)))
                ids, frames, offsets, lengths = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), pa.array([path] * len(rows)), pa.array(frames, pa.int32()),
                                                  pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], schema.names)
                b = next(parts, None)
            bundle.close()

    return materialize(marked.mapInArrow(run, schema), "warc_index")


def read(spark: SparkSession, index: DataFrame, key: str = "page_id", with_payload: bool = False) -> DataFrame:
    """The records that ``index`` names, read from their frames: key, payload_bytes,
    payload_digest, record_type, refers_to, record_id, target_uri (and payload).
    A response's digest is computed from its payload, and must be the one it states."""
    ship_package(spark)
    kind = index.schema[key].dataType
    # ranges of bundles and frames: a task opens the few bundles that its range covers
    spread = index.select("archive", "frame", "offset").repartitionByRange("archive", "frame").sortWithinPartitions("archive", "frame", "offset")
    none = F.lit(None)
    columns = [none.cast(kind).alias(key), F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"),
               none.cast(kind).alias("refers_to"), F.lit("").alias("record_id"), none.cast("string").alias("target_uri")]
    schema = index.select(*columns, *[none.cast("binary").alias("payload")] * with_payload).schema
    number = str if kind.typeName() == "string" else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, at, bundle, data, closing = to_arrow_schema(schema), (None, None), None, b"", None
        try:
            for b in batches:
                rows = []
                for archive, frame, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if archive != at[0]:
                        if closing is not None:
                            closing.__exit__(None, None, None)
                        closing = store.reading(archive)
                        bundle = BundleReader(closing.__enter__())
                    if (archive, frame) != at:
                        data, at = bundle.frame(frame), (archive, frame)
                    fields, payload, _ = parse(data, offset)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"{archive}, frame {frame}, offset {offset}: the payload is not the one recorded")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    row = [None if page is None else number(page), size, digest, fields["WARC-Type"], None if refers is None else number(refers),
                           fields["WARC-Record-ID"].strip("<>"), fields.get("WARC-Target-URI")]
                    rows.append([*row, payload] if with_payload else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            if closing is not None:
                closing.__exit__(None, None, None)

    return spread.mapInArrow(run, schema)
