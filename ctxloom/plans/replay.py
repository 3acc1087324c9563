"""Replay of tables as file arrivals, for the streaming queries and tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.session import scratch_path


def stage_arrivals(df: DataFrame, order_col: str, n_files: int, label: str, ordered: bool = False) -> str:
    """Write ``df`` as about ``n_files`` parquet files; returns the folder.

    The file source takes files in modification-time order; files written by
    one job get no reliable order, which is fine for the commutative
    aggregates (rows are dealt by a hash of ``order_col``: ranges would run the
    plan twice, for their bounds).  ``ordered=True`` runs the plan once, cut into ranges (bounds from
    ``percentile_approx``), then lets the ranges arrive one after another.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "streams", f"{label}-in-{uuid.uuid4().hex[:12]}")
    if not ordered:
        df.repartition(n_files, order_col).write.mode("overwrite").parquet(path)
        return path
    qs = [i / n_files for i in range(1, n_files)]
    bounds = df.agg(F.percentile_approx(order_col, qs).alias("b")).first()["b"] or []
    bucket = sum((F.col(order_col) > F.lit(b)).cast("int") for b in bounds) if bounds else F.lit(0)
    staged = scratch_path(spark, "streams", f"{label}-cut-{uuid.uuid4().hex[:12]}")
    # one file per arrival: a trigger of one file then takes a whole range
    df.withColumn("_arrival", bucket).repartition(n_files, "_arrival").write.partitionBy("_arrival").parquet(staged)
    cut = spark.read.parquet(staged)
    for i in range(len(bounds) + 1):
        cut.where(F.col("_arrival") == i).select(*df.columns).write.mode("append").parquet(path)
    return path
