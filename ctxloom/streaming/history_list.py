"""Exact command-history list as a stream (L4 + J6 + F9, T2).

The tool's history is a list edited in order: *add* trims the command, moves
it to the front (no duplicates) and drops the oldest beyond the cap;
*forget* removes one command; *clear* empties the list.  A forget can leave
a slot that an evicted command does not get back, so the list is not a pure
function of last-use times: it needs the events in order.

Each micro-batch is reduced to one edit script a user (``operators.edit_scripts``):
its events are range-sorted and spread over tasks, so a user with most of a
batch is split like any other.  The scripts are applied to the lists of the
epochs before, and the lists that changed are the epoch's rows, in a folder of
its own: a batch that runs again reads the same earlier epochs and writes the
same rows.  Every ``SNAPSHOT`` epochs all lists are written, so a batch reads a
bounded number of epochs.  Events must arrive in event order per user across
micro-batches (a topic keyed by user, or files written in order: the file source
takes files by modification time); within one they may come in any order.

An optional time-to-live (off by default) drops a user's list when more than
that lies between two events of the user, or between the user's last event and
the latest event of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.constants import MAX_HISTORY
from ctxloom.functions.globs import rust_trim
from ctxloom.operators.edit_scripts import ADD, CLEAR, FORGET, applied, scripts
from ctxloom.functions.text import trim_unicode
from ctxloom.session import scratch_path
from ctxloom.streaming.jobs import file_stream, read_latest

#: Every so many epochs hold all lists, not only those that changed.
SNAPSHOT = 16
EVENT_COLUMNS = ["user_id", "kind", "command", "ts", "seq"]
ENTRIES = "array<struct<command:string,ts:bigint,seq:bigint>>"


def apply_events(entries: list[str], kinds, commands, cap: int) -> list[str]:
    """Apply ordered ``add`` / ``forget`` / ``clear`` events to a list: what the
    streams must agree with."""
    out = list(entries)
    for kind, cmd in zip(kinds, commands):
        if kind == "add":
            c = rust_trim(cmd or "")
            if not c:
                continue
            if c in out:
                out.remove(c)
            out.insert(0, c)
            del out[cap:]
        elif kind == "forget":
            c = rust_trim(cmd or "")
            if c in out:
                out.remove(c)
        elif kind == "clear":
            out = []
    return out


def history_events(uses: DataFrame, forgets: DataFrame | None = None) -> DataFrame:
    """One event stream: uses become ``add``; forgets with a command become
    ``forget``, with a null command ``clear``."""
    adds = uses.select("user_id", F.lit("add").alias("kind"), "command", "ts", "seq")
    if forgets is None:
        return adds
    f = forgets.select("user_id", F.when(F.col("command").isNull(), F.lit("clear")).otherwise(F.lit("forget")).alias("kind"),
                       "command", "ts", "seq")
    return adds.unionByName(f)


def _edits(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "add", ADD).when(F.col("kind") == "forget", FORGET).when(F.col("kind") == "clear", CLEAR)
    out = events.select("user_id", kind.cast("int").alias("_kind"), trim_unicode(F.col("command")).alias("command"),
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("bigint").alias("seq"))
    return out.where(f"_kind = {CLEAR} OR (_kind IS NOT NULL AND command <> '')")


def _lists(spark: SparkSession, log: str, schema: str, epoch: int) -> DataFrame:
    """Lists after an epoch: from the last epoch with all lists on."""
    first = epoch - epoch % SNAPSHOT if epoch >= 0 else -1
    return read_latest(spark, log, ["user_id"], schema, F.col("epoch").between(first, epoch))


def history_lists(spark: SparkSession, path: str, schema, cap: int = MAX_HISTORY, max_files: int | None = None,
                  ttl_ms: int | None = None) -> DataFrame:
    """Run the stream over the event files at ``path``; returns the current
    list per user as ``(user_id, rank, command)``.

    ``ttl_ms``: the time-to-live, by event time, so a replay gives the same
    result whatever the micro-batches.
    """
    ttl = None if ttl_ms is None else ttl_ms * 1000
    base = scratch_path(spark, "streams", f"history-list-{uuid.uuid4().hex[:12]}")
    log = base + "/changelog"
    events = file_stream(spark, path, schema, max_files).select(*EVENT_COLUMNS)
    row = f"user_id {events.schema['user_id'].dataType.simpleString()}, entries {ENTRIES}, last_ts bigint"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        old = _lists(session, log, row, epoch - 1)
        new = scripts(_edits(batch), cap, ttl)
        before = old.select("user_id", F.col("entries").alias("old"), F.col("last_ts").alias("old_ts"))
        changed = applied(new.join(before, "user_id", "left"), cap, ttl)
        if epoch % SNAPSHOT == 0:
            changed = changed.unionByName(old.join(new, "user_id", "left_anti"))
        changed.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    spark.createDataFrame([], row).write.mode("overwrite").parquet(f"{log}/epoch=-1")
    q = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    epoch = spark.read.schema(f"{row}, epoch int").parquet(log).agg(F.max("epoch")).first()[0]
    current = _lists(spark, log, row, -1 if epoch is None else epoch)
    if ttl is not None:
        latest = current.select(F.max("last_ts")).scalar()
        current = current.where(latest - F.col("last_ts") <= ttl)
    return current.select("user_id", F.posexplode("entries").alias("rank", "_e")).select(
        "user_id", (F.col("rank") + 1).cast("int").alias("rank"), "_e.command")
