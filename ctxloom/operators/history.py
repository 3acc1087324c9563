"""Command history: most-recently-used list (L4), forget and clear (J6),
blank filter (F9), and the tolerant JSON source / sink (S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ctxloom.constants import MAX_HISTORY
from ctxloom.functions.text import trim_unicode
from ctxloom.operators.edit_scripts import edits, scripts


def clean_commands(history: DataFrame) -> DataFrame:
    """Trim and drop blank commands."""
    return (history.withColumn("command", trim_unicode(F.col("command")))
            .where(F.col("command") != F.lit("")))


def latest_uses(history: DataFrame) -> DataFrame:
    """Last use per (user, command): one grouped max with map-side partials."""
    return clean_commands(history).groupBy("user_id", "command").agg(
        F.max(F.struct("ts", "seq")).alias("last"))


def _ranked(uses: DataFrame, cap: int) -> DataFrame:
    """Newest first; of equal (ts, seq) the larger command, as the edits in order leave them."""
    w = Window.partitionBy("user_id").orderBy(F.col("last").desc(), F.col("command").desc())
    return uses.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def recent_commands(history: DataFrame, cap: int = MAX_HISTORY, forgets: DataFrame | None = None) -> DataFrame:
    """MRU list per user: move to front, no duplicates, at most ``cap`` (L4);
    with ``forgets`` exactly the list that the edits in event order leave (J6).

    ``forgets(user_id, command, ts, seq)``: ``command`` null clears the list.
    Edits are reduced to scripts that compose (``operators.edit_scripts``), so a
    user's events are spread over tasks like any others.

    ``rank`` 1 is the most recent.  Without forgets ``row_number() <= cap`` lets Spark cut each
    user to ``cap`` rows per task before the window shuffle, so a user with a
    third of all rows costs ``cap`` rows per map task.
    """
    if forgets is not None:
        lists = scripts(edits(history, forgets), cap).select("user_id", F.posexplode("front").alias("rank", "_e"))
        kind = history.schema["ts"].dataType
        ts = (F.timestamp_micros("_e.ts") if isinstance(kind, (TimestampType, TimestampNTZType)) else F.col("_e.ts")).cast(kind)
        return lists.select("user_id", (F.col("rank") + 1).cast("int").alias("rank"), "_e.command", ts.alias("last_ts"),
                            F.col("_e.seq").cast(history.schema["seq"].dataType).alias("last_seq"))
    return _ranked(latest_uses(history), cap).select("user_id", "rank", "command", F.col("last.ts").alias("last_ts"),
                                                     F.col("last.seq").alias("last_seq"))


def history_json(recent: DataFrame, cap: int = MAX_HISTORY) -> DataFrame:
    """Sink shape (S5): one JSON document per user ``{"commands": [...], "max": n}``.
    The list is bounded by ``cap``."""
    per_user = recent.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "command"))), lambda x: x["command"]).alias("commands"))
    return per_user.select("user_id", F.to_json(F.struct("commands", F.lit(cap).cast("bigint").alias("max"))).alias("json"))


def read_history_json(docs: DataFrame, default_max: int = MAX_HISTORY) -> DataFrame:
    """Tolerant reader (S5): bad JSON is ignored, non-string entries dropped,
    a missing or non-integer / negative ``max`` keeps the default.

    ``docs(user_id, json)`` -> ``(user_id, commands array<string>, max bigint)``;
    ``commands`` is null when the document has no usable ``commands`` array.
    """
    v = F.try_parse_json(F.col("json"))
    items = F.try_variant_get(v, "$.commands", "array<variant>")
    strings = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == F.lit("STRING")),
                          lambda x: F.variant_get(x, "$", "string"))
    mx_type = F.schema_of_variant(F.variant_get(v, "$.max", "variant"))
    mx = F.try_variant_get(v, "$.max", "bigint")
    mx_ok = mx_type.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$") & (mx >= 0)
    return docs.select("user_id", strings.alias("commands"),
                       F.when(mx_ok, mx).otherwise(F.lit(default_max).cast("bigint")).alias("max"))
