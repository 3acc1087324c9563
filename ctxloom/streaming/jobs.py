"""Streaming jobs.

Input arrives as parquet files in a folder (one or more files per arrival).
State is one row per key, kept by Spark's streaming aggregation in update
mode: each micro-batch emits only the keys it changed, and ``foreachBatch``
writes them to their own ``epoch=<id>`` folder of a changelog table
(overwrite, so a replayed epoch writes the same files).  Readers take the
latest row per key (``read_latest``), which is also how ``compact`` rewrites it.  Checkpoint and changelog live under the shared checkpoint
folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.constants import MAX_HISTORY
from ctxloom.functions.tokens import chars_to_tokens, file_tokens
from ctxloom.operators.history import clean_commands
from ctxloom.operators import updates
from ctxloom.session import scratch_path


def run_to_changelog(agg: DataFrame, label: str) -> str:
    """Run an aggregating stream in update mode until the input is drained;
    return the changelog folder (``epoch`` partitions of changed keys)."""
    spark = agg.sparkSession
    base = scratch_path(spark, "streams", f"{label}-{uuid.uuid4().hex[:12]}")
    log = base + "/changelog"

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch_id}")

    # an epoch without rows first: a stream without input leaves an empty table, not a missing one
    spark.createDataFrame([], agg.schema).write.mode("overwrite").parquet(f"{log}/epoch=-1")
    q = (agg.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return log


def compact(spark: SparkSession, log: str, keys: list[str], out: str) -> str:
    """Rewrite a changelog as one epoch with the latest row per key (to a new
    folder; the reader switches over and the old one can go)."""
    read_latest(spark, log, keys).write.mode("overwrite").parquet(f"{out}/epoch=0")
    return out


def read_latest(spark: SparkSession, log: str, keys: list[str], schema: str | None = None, epochs: Column | None = None) -> DataFrame:
    """Current result: per key the row of the latest epoch (one grouped pass), of some ``epochs`` only if told."""
    ch = spark.read.schema(f"{schema}, epoch int").parquet(log) if schema else spark.read.parquet(log)
    ch = ch if epochs is None else ch.where(epochs)
    values = [c for c in ch.columns if c not in keys and c != "epoch"]
    latest = ch.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("epoch")).alias("_v"))
    return latest.select(*keys, *[F.col("_v")[c].alias(c) for c in values])


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Files as they arrive; ``max_files`` per micro-batch only where a caller asks for it."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def latest_content(spark: SparkSession, path: str, schema, key: str = "url_key", max_files: int | None = None) -> DataFrame:
    """Newest content per key by ``(ts, seq)``; arrival order does not
    matter, so late records cannot overwrite newer ones, and a record delivered
    twice changes nothing but ``n_versions``.  The state is the time and number
    of the newest update of a key; content is read for the winners."""
    agg = file_stream(spark, path, schema, max_files).groupBy(key).agg(
        updates.newest().alias("_last"), F.count(F.lit(1)).alias("n_versions"))
    current = read_latest(spark, run_to_changelog(agg, "latest"), [key])
    return updates.latest_content(updates.with_content(current, spark.read.schema(schema).parquet(path), key), key)


def recent_commands(spark: SparkSession, path: str, schema, cap: int = MAX_HISTORY, max_files: int | None = None) -> DataFrame:
    """Most-recently-used commands per user.  The stream keeps the last
    use per (user, command); the top ``cap`` per user is a window over the
    current table (row-number windows are not allowed on streams)."""
    s = clean_commands(file_stream(spark, path, schema, max_files))
    agg = s.groupBy("user_id", "command").agg(F.max(F.struct("ts", "seq")).alias("last"))
    current = read_latest(spark, run_to_changelog(agg, "history"), ["user_id", "command"])
    w = Window.partitionBy("user_id").orderBy(F.col("last").desc(), F.col("command").desc())
    r = current.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return r.select("user_id", "rank", "command", F.col("last.seq").alias("last_seq"))


def running_estimate(spark: SparkSession, path: str, schema, max_files: int | None = None, order: str | None = None) -> DataFrame:
    """Per project, files seen so far, tokens of the ticked ones and the
    tree estimate, updated as file batches arrive.

    State is a file's newest arrival (its size and tick), so a file that arrives
    again replaces what it was: the one with the largest ``order`` column holds
    (default: the time of the file that brought it).  ``keyed_state`` has a twin
    that forgets files."""
    s = file_stream(spark, path, schema, max_files)
    at = F.col(order).cast("bigint") if order else F.unix_micros("_metadata.file_modification_time")
    agg = s.select("project_id", "rel_path", F.struct(
        at.alias("at"), F.when(F.col("selected"), file_tokens(F.col("length"))).otherwise(0).cast("bigint").alias("tokens")).alias("_v")
    ).groupBy("project_id", "rel_path").agg(F.max("_v").alias("_v"))
    cur = read_latest(spark, run_to_changelog(agg, "estimate"), ["project_id", "rel_path"])
    cur = cur.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("_v.tokens").cast("bigint").alias("file_tokens"),
                                        F.sum(F.octet_length("rel_path") + 4).cast("bigint").alias("tree_chars"))
    return cur.select("project_id", F.col("n_files").cast("bigint").alias("n_files"), "file_tokens",
                      chars_to_tokens(F.col("tree_chars") + 16).alias("tree_tokens"))
