"""Token ids in bit- or byte-plane files.

A file holds the ids of consecutive documents:

    "PLN1" | blocks | index (zstd) | index length u64 | "PLN1"

A block is ``BLOCK`` ids (the last of a file: fewer), as unsigned 32-bit
numbers, transposed into 4 byte planes or 32 bit planes; each plane is a zstd
frame of its own, a plane of zeros takes no bytes.  The index has, for each
block, its offset and the size of each plane, and for each document its key and
number of ids, so any document can be read alone and the files need no other
index.

``write`` range-partitions the documents by key and writes one file per
partition in ascending key order (null first; rows that repeat a key in order of
their text): file k's ids all come before file k + 1's.  The number of files
follows the rows and is ``MAX_FILES`` at most, which bounds what the driver
holds (a row for each file).  A file is written as a stream and appears under
its name when it is whole; the name is the task attempt's, so a task that runs
again, or twice at a time, never touches a file that the result names.

Null and empty texts are one end id.  Keys are integers: the index holds them as
64-bit numbers, and a key that does not cast to one stops the job.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import store, tokens
from ctxloom.llm.textops import slices
from ctxloom.session import materialize, ship_package

MAGIC = b"PLN1"
BLOCK = 1 << 16
DOCS_PER_FILE = 4096
MAX_FILES = 1 << 16
LEVEL = 1


def split_planes(ids: np.ndarray, bits: bool = False) -> list[np.ndarray]:
    """4 byte planes or 32 bit planes of 32-bit ids, the lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    return [*np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")]


def join_planes(planes: list[np.ndarray], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
    ones = np.unpackbits(np.stack(planes), axis=1, bitorder="little")[:, :n]
    return np.ascontiguousarray(np.packbits(ones.T, axis=1, bitorder="little")).view("<u4").ravel()


class Writer:
    """Writes blocks to a stream as ids come; keys and sizes go to the index."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.left = np.zeros(0, np.uint32)
        self.place, self.index, self.n = len(MAGIC), [], 0
        self.keys, self.sizes = [], []
        out.write(MAGIC)

    def add(self, keys: list, ids: np.ndarray, offs: np.ndarray) -> None:
        self.keys += keys
        self.sizes.append(np.diff(offs))
        self.n += len(ids)
        ids = np.concatenate((self.left, ids)) if len(self.left) else ids
        whole = len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            self._block(ids[k:k + self.block])
        self.left = ids[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        sizes = []
        for plane in split_planes(ids, self.bits):
            data = self.zip.compress(plane.tobytes()) if plane.any() else b""
            self.out.write(data)
            sizes.append(len(data))
        self.index.append([self.place, len(ids), *sizes])
        self.place += sum(sizes)

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        table = np.array(self.index, "<i8").reshape(len(self.index), -1)
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes]).astype("<i8")
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        head = struct.pack("<4q", len(self.index), table.shape[1], len(self.keys), 32 if self.bits else 4)
        data = self.zip.compress(head + table.tobytes() + keys.tobytes() + null.tobytes() + sizes.tobytes())
        self.out.write(data + struct.pack("<Q", len(data)) + MAGIC)


class Reader:
    """Index of a file; blocks are read and joined as asked for."""

    def __init__(self, f):
        self.f = f
        end = f.size()
        f.seek(end - 12)
        size, magic = struct.unpack("<Q4s", f.read(12))
        if magic != MAGIC:
            raise ValueError("not a plane file, or cut short")
        f.seek(end - 12 - size)
        data = zstandard.ZstdDecompressor().decompress(f.read(size))
        blocks, width, docs, self.planes = struct.unpack("<4q", data[:32])
        at = 32
        self.blocks = np.frombuffer(data, "<i8", blocks * width, at).reshape(blocks, width)
        at += 8 * blocks * width
        keys, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
        null, at = np.frombuffer(data, np.uint8, docs, at), at + docs
        self.keys = [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.cumsum(self.blocks[:, 1]) - self.blocks[:, 1] if blocks else np.zeros(0, np.int64)

    def block(self, k: int) -> np.ndarray:
        place, n, *sizes = self.blocks[k].tolist()
        self.f.seek(place)
        data, planes, at = self.f.read(sum(sizes)), [], 0
        width = n if self.planes == 4 else (n + 7) // 8
        unzip = zstandard.ZstdDecompressor()
        for s in sizes:
            planes.append(np.frombuffer(unzip.decompress(data[at:at + s]), np.uint8) if s else np.zeros(width, np.uint8))
            at += s
        return join_planes(planes, n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        out, k = [np.zeros(0, np.uint32)], int(np.searchsorted(self.first, start, "right")) - 1
        while n > 0:
            part = self.block(k)[start - int(self.first[k]):][:n]
            out.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int, int]]:
        """(number, crc32 of its ids) of every document, each block read once."""
        doc, crc, left = 0, 0, int(self.sizes[0]) if len(self.sizes) else 0
        for k in range(len(self.blocks)):
            raw, at = memoryview(self.block(k).astype("<u4", copy=False).tobytes()), 0
            while at < len(raw):
                part = raw[at:at + 4 * left]
                crc, left, at = zlib.crc32(part, crc), left - len(part) // 4, at + len(part)
                if left == 0:
                    yield doc, crc
                    doc, crc = doc + 1, 0
                    left = int(self.sizes[doc]) if doc < len(self.sizes) else 0


def write(docs: DataFrame, out_dir: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0,
          bits: bool = False, docs_per_file: int = DOCS_PER_FILE, special: bool = False) -> DataFrame:
    """Write the files; returns part, path, n_docs, n_ids and first_id (ids of
    all files before it) of each; ``special`` as in ``tokens``."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = tokens.send(spark, tokenizer)
    src = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    n = min(MAX_FILES, max(1, -(-src.select("_key").count() // docs_per_file)))
    ordered = src.repartitionByRange(n, F.asc_nulls_first("_key")).sortWithinPartitions(F.asc_nulls_first("_key"), F.asc_nulls_first("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts = slices(batches, "_text", 2 << 20)
        first = next(parts, None)
        if first is None:  # an empty partition has no file
            return
        enc, path = tokens.encoder(sent, special), f"{out_dir}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.planes"
        with store.writing(path) as f:
            writer = Writer(f, bits)
            for b in itertools.chain((first,), parts):
                writer.add(b.column(0).to_pylist(), *tokens.with_end(*enc.encode(b.column(1)), end))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.keys)], pa.int64()),
                                          pa.array([writer.n], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    files = materialize(ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "plane_files")
    rows = sorted(tuple(r) for r in files.collect())  # MAX_FILES rows at most
    first = np.concatenate(([0], np.cumsum([r[3] for r in rows])))[:len(rows)].tolist()
    return spark.createDataFrame([(*r, f) for r, f in zip(rows, first, strict=True)], "part int, path string, n_docs long, n_ids long, first_id long")


def read(spark: SparkSession, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the files."""
    ship_package(spark)
    spread = files.select("path", "first_id").repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.reading(path) as f:
                    r = Reader(f)
                    crc = [c for _, c in r.documents()]
                    yield pa.RecordBatch.from_arrays([pa.array(r.keys, pa.int64()), pa.array(r.starts + base), pa.array(r.sizes),
                                                      pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
