"""T1 and T3 with keyed state, time-to-live and timers (``transformWithState``).

``jobs`` keeps state for ever in Spark's own aggregation, which is cheaper; these
twins let it go.  State needs the RocksDB store: the stream runs in a session of
its own with that setting, and the caller's session stays as it is.

* ``latest_content``: a key's state is the moment of its newest update.  An update
  passes if it is newer; its content is written to the changelog and not kept.
  A key without updates for ``ttl_ms`` is forgotten: its row stays in the result,
  and whatever comes next counts as new.
* ``running_estimate``: a file's state is its size and tick.  A file that arrives
  again puts its new size in the place of the old one; what is written are
  differences by project, so the result is their sum.  A file not seen for
  ``ttl_ms`` is taken out again by a timer.

Both resume from ``base`` (the folder of the checkpoint and the changelog); a
micro-batch that runs again writes the same folder again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ctxloom.functions.tokens import chars_to_tokens, file_tokens
from ctxloom.session import scratch_path, ship_package
from ctxloom.streaming.jobs import file_stream, read_latest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Rows (_ts, _seq, content) of a key; yields the newest one when it is newer than the state."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "ts long, seq long, n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        best, moment, n = None, (old[0], old[1]) if old else None, old[2] if old else 0
        for r in rows:
            n += 1
            at = (r["_ts"], r["_seq"])
            if moment is None or at > moment or (best is not None and at == moment and (r["content"] or "") > (best["content"] or "")):
                best, moment = r, at
        self.state.update((*moment, n))
        yield Row(key=key[0], content=best["content"] if best else None, seq=moment[1], n=n, changed=best is not None)

    def close(self) -> None:
        pass


class FileSizes(StatefulProcessor):
    """Rows (_order, _tokens, _chars) of a file; yields what its project's sums change by."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "at long, tokens long, chars long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        new = max(((r["_order"], r["_tokens"], r["_chars"]) for r in rows))
        if old and tuple(old[:3]) > new:
            new = tuple(old[:3])
        timer = old[3] if old else None
        if self.ttl_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
            self.handle.registerTimer(timer)
        self.state.update((*new, timer))
        yield Row(project_id=key[0], files=0 if old else 1, tokens=new[1] - (old[1] if old else 0), chars=new[2] - (old[2] if old else 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            old = self.state.get()
            if old[3] is not None and old[3] <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield Row(project_id=key[0], files=-1, tokens=-old[1], chars=-old[2])

    def close(self) -> None:
        pass


def _session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(name, None) is not None:
            own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # with timers a batch without data would follow another for ever: they fire with the next data
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def _run(rows: DataFrame, base: str, schema: str, spark: SparkSession, write) -> str:
    log = f"{base}/changelog"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{log}/epoch=-1")
    q = (rows.writeStream.outputMode("update").foreachBatch(lambda b, e: write(b).write.mode("overwrite").parquet(f"{log}/epoch={e}"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return log


def latest_content(spark: SparkSession, path: str, schema, key: str = "url_key", max_files: int | None = None,
                   ttl_ms: int | None = None, base: str | None = None) -> DataFrame:
    """``key, content, last_seq, n_versions`` of the newest update of each key
    (as ``operators.updates.latest_by_key``; a null key is a key)."""
    ship_package(spark)
    base = base or scratch_path(spark, "streams", f"newest-{uuid.uuid4().hex[:12]}")
    stream = file_stream(_session(spark), path, schema, max_files)
    kind = stream.schema[key].dataType.simpleString()
    least = -(2**63)
    rows = stream.select(F.col(key).alias("_key"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(least)).alias("_ts"),
                         F.coalesce(F.col("seq").cast("bigint"), F.lit(least)).alias("_seq"), "content")
    out = rows.groupBy("_key").transformWithState(Newest(ttl_ms), f"key {kind}, content string, seq long, n long, changed boolean", "Update",
                                                  "ProcessingTime" if ttl_ms else "None")
    log = _run(out, base, f"key {kind}, content string, seq long, n long, changed boolean", spark, lambda b: b)
    schema_ = f"key {kind}, content string, seq long, n long, changed boolean"
    counts = read_latest(spark, log, ["key"], schema_).select(F.col("key").alias("_k"), "n")
    won = spark.read.schema(f"{schema_}, epoch int").parquet(log).where("changed").groupBy("key").agg(F.max_by(F.struct("content", "seq"), "epoch").alias("_v"))
    return won.join(counts, F.col("key").eqNullSafe(F.col("_k"))).select(
        F.col("key").alias(key), "_v.content", F.when(F.col("_v.seq") > least, F.col("_v.seq")).alias("last_seq"), F.col("n").alias("n_versions"))


def running_estimate(spark: SparkSession, path: str, schema, max_files: int | None = None, ttl_ms: int | None = None,
                     base: str | None = None, order: str | None = None) -> DataFrame:
    """Per project the files known, the tokens of ticked ones and the tree
    estimate.  Of a file's arrivals the one with the largest ``order`` column
    holds (default: the time of the file that brought it)."""
    ship_package(spark)
    base = base or scratch_path(spark, "streams", f"sizes-{uuid.uuid4().hex[:12]}")
    stream = file_stream(_session(spark), path, schema, max_files)
    at = F.col(order).cast("bigint") if order else F.unix_micros("_metadata.file_modification_time")
    rows = stream.select("project_id", "rel_path", at.alias("_order"),
                         F.when(F.col("selected"), file_tokens(F.col("length"))).otherwise(0).cast("bigint").alias("_tokens"),
                         (F.octet_length("rel_path") + 4).cast("bigint").alias("_chars"))
    deltas = "project_id string, files long, tokens long, chars long"
    out = rows.groupBy("project_id", "rel_path").transformWithState(FileSizes(ttl_ms), deltas, "Update", "ProcessingTime" if ttl_ms else "None")
    log = _run(out, base, deltas, spark, lambda b: b.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in ("files", "tokens", "chars")]))
    total = spark.read.schema(deltas).parquet(log).groupBy("project_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("files", "tokens", "chars")])
    return total.where("files > 0").select("project_id", F.col("files").alias("n_files"), F.col("tokens").alias("file_tokens"),
                                           chars_to_tokens(F.col("chars") + 16).alias("tree_tokens"))
