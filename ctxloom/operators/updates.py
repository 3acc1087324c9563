"""Latest value per key (J7), the batch twin of the streaming T1."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WIDTH, _HALF = Decimal(2**64), Decimal(2**63)


def moment() -> Column:
    """``(ts, seq)`` as one number (microseconds * 2^64 + seq + 2^63): a hash aggregate can hold
    its maximum, where a struct would be sorted.  A null time or number is older than any."""
    no_time, no_seq = F.lit(-(2**59)), F.lit(-(2**63)).cast("bigint")  # no timestamp is as early
    return (F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), no_time).cast("decimal(38,0)") * F.lit(_WIDTH)
            + F.coalesce(F.col("seq").cast("bigint"), no_seq) + F.lit(_HALF))


def newest() -> Column:
    return F.max(moment())


def latest_rows(updates: DataFrame, key: str = "url_key") -> DataFrame:
    """One row per key: the newest update by ``(ts, seq)`` with all its columns,
    and ``n_versions``, the updates delivered (a repeated one each time).

    A late record cannot overwrite a newer one, a record delivered twice is one
    row, a null key is a key.  Of different updates with equal ``(ts, seq)`` the
    one with the larger other columns (in their order) wins.  The grouped
    maximum has no content in it; content is joined for the winners, and what a
    caller derives from the result is computed for them alone."""
    last = updates.groupBy(key).agg(newest().alias("_last"), F.count(F.lit(1)).alias("n_versions"))
    return with_content(last, updates, key)


def latest_by_key(updates: DataFrame, key: str = "url_key") -> DataFrame:
    """``key, content, last_seq, n_versions`` of the newest update of each key."""
    return latest_content(latest_rows(updates, key), key)


def latest_content(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "content", F.col("seq").alias("last_seq"), "n_versions")


def with_content(last: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``last(key, _last, n_versions)``, ``_last`` by ``newest``, with the columns of that update."""
    won = last.select(F.col(key).alias("_key"), "_last", "n_versions")
    rows = updates.withColumn("_at", moment()).join(won, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_last")))
    others = [F.col(c).desc() for c in updates.columns if c not in (key, "ts", "seq")]
    first = F.row_number().over(Window.partitionBy("_key", "_last").orderBy(*others or [F.lit(1)]))
    return rows.withColumn("_first", first).where("_first = 1").select(*updates.columns, "n_versions")
