"""Token counts by a separator scan over flat, unindexed token files.

A flat file is ids only (unsigned 16 or 32 bits, little-endian), each document
behind the one before, an end-of-document id behind each.  Nothing says where
documents start, so files are cut into fixed blocks that tasks search
independently (a vectorised comparison with the end id).  A block knows its own
separators only; a prefix scan over the blocks of a file (running count and last
separator, on one narrow row a block) then gives each block the number of
documents before it and where its first document started.  Documents may span
any number of blocks.

Ids behind the last separator of a file are one document with ``closed`` false.
An empty file has no documents.  A file whose size is no multiple of the id
width is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.llm import store, tokens
from ctxloom.llm.textops import slices
from ctxloom.session import materialize, ship_package

BLOCK = 1 << 21


def write_flat(docs: DataFrame, out_dir: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", width: int = 2) -> tuple[DataFrame, DataFrame]:
    """A flat file per partition of ``docs``.  Returns the files (path, n_bytes)
    and which document stands where (path, ordinal, key)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = tokens.send(spark, tokenizer)
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = src.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("ordinal"), F.when(F.lit(True), F.col("_key")).alias("_key"), F.lit(None).cast("long").alias("n_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{out_dir}/part-{task.partitionId():06d}-{task.taskAttemptId()}.u{8 * width}"
        enc, at, n_bytes, key_type = tokens.encoder(sent), 0, 0, pa.int64()
        with store.writing(path) as f:
            for b in slices(batches, "_text", 2 << 20):
                ids, _ = tokens.with_end(*enc.encode(b.column(1)), end)
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes: take a larger width")
                f.write(ids.astype(f"<u{width}").tobytes())
                n_bytes += width * len(ids)
                n, at, key_type = b.num_rows, at + b.num_rows, b.column(0).type
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at - n, at)), b.column(0), pa.nulls(n, pa.int64())], schema.names)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([-1], pa.int64()), pa.nulls(1, key_type), pa.array([n_bytes], pa.int64())], schema.names)

    found = materialize(src.mapInArrow(run, schema), "flat_files")
    return (found.where("ordinal = -1").select("path", "n_bytes"),
            found.where("ordinal >= 0").select("path", "ordinal", F.col("_key").alias(key)))


def scan(spark: SparkSession, files: DataFrame, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """path, ordinal, start, n_tokens (with the end id) and closed of every
    document of the files (path, n_bytes)."""
    ship_package(spark)
    step = block * width
    cut = (files.where("n_bytes > 0").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(step).cast("long"))))
           .select("path", "_at", F.least(F.col("n_bytes") - F.col("_at"), F.lit(step)).alias("_size")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size % width:
                    raise ValueError(f"{path}: cut within an id")
                with store.reading(path) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(size), f"<u{width}")
                ends = np.flatnonzero(ids == end) + at // width + 1  # where the next document starts
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at // width], pa.int64()), pa.array([len(ids)], pa.int64()),
                                                  pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([[None, *ends[:-1].tolist()][:len(ends)]], pa.list_(pa.int64()))],
                                                 ["path", "first", "n", "ends", "starts"])

    blocks = materialize(cut.repartition("path", "_at").mapInArrow(run, "path string, first long, n long, ends array<long>, starts array<long>"), "separators")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("path", "first", F.size("ends").alias("_n"), F.array_max("ends").alias("_last"))
    stitched = narrow.select("path", "first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                             F.coalesce(F.max("_last").over(before), F.lit(0)).alias("_from"))
    whole = (blocks.join(stitched, ["path", "first"])
             .select("path", "_before", "_from", F.posexplode(F.arrays_zip("starts", "ends")).alias("_k", "_doc"))
             .select("path", (F.col("_before") + F.col("_k")).alias("ordinal"),
                     F.coalesce("_doc.starts", "_from").alias("start"), F.col("_doc.ends").alias("_end")))
    whole = whole.select("path", "ordinal", "start", (F.col("_end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = (blocks.groupBy("path").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(0)).alias("start"),
                                       F.max(F.col("first") + F.col("n")).alias("_stop"))
            .where("_stop > start").select("path", "ordinal", "start", (F.col("_stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))
    return whole.unionByName(rest)


def counts(docs: DataFrame, out_dir: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """key and n_tokens (with the end id) of every row, counted in flat files."""
    files, where = write_flat(docs, out_dir, tokenizer, end, key, text, width)
    found = scan(docs.sparkSession, files, end, width)
    return where.join(found, ["path", "ordinal"]).select(key, "n_tokens")
