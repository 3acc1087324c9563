"""Embedding whitening by weighted multiplicity covariance.

A vector's entries become integers, ``floor(scale * c)``.  Equal integer
vectors are grouped before anything is fitted: each distinct vector enters the
covariance once, with its number of rows or one as its weight.  Every task
centres its vectors on the exact mean and adds one weighted matrix product;
the sums of all tasks give the covariance, whose leading eigenvectors whiten
each distinct vector once.  The results are joined back to the rows.

A vector that half of all rows share is one row of the distinct table; its
rows are dealt over several keys for the join back (``HOT`` rows each, or more
so that at most ``SPLIT`` vectors need it, which bounds what is broadcast).
What reaches the driver is the sums and the covariance: numbers of the
dimension squared, whatever the rows.

Rows whose vector is null or holds a null, NaN or infinite entry are left out,
as are empty vectors and vectors of another length than the most frequent one
(of equally frequent ones the longest).  Entries beyond 2**53 after scaling
count as that.  A component whose eigenvalue is not positive (to double
precision) is a direction in which nothing varies: its ``whitened`` is null,
its ``explained`` 0 (with a trace of 0 as well), and ``identity_error`` is over the others.
``deviation`` is null where it exceeds a long.  Rows that repeat a key, and
null keys, count as they come.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.session import materialize, ship_package

SCALE = 256
COMPONENTS = 4
HOT, SPLIT = 10_000, 10_000
_MOST = 2**53
_ROWS = 4096


@dataclass
class Model:
    n: int  # sum of the weights
    sums: list[int]  # exact, by dimension
    vectors: np.ndarray  # (dimension, components), unit length
    values: np.ndarray  # eigenvalues, falling
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def varies(self) -> np.ndarray:
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_MOST))), F.lit(-float(_MOST)))).cast("long"))


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _added(distinct: DataFrame, width: int, rows: int, piece) -> np.ndarray:
    """Sum over all tasks of ``piece(vectors, weights)``, (rows, width) doubles.
    A task sends one row of numbers for each row of the sum; each is added up in the order of the tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in _parts(batches):
            total += piece(_matrix(b.column(0), width), b.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * rows, pa.int32()), pa.array(range(rows), pa.int32()),
                                          pa.array([r.tobytes() for r in total], pa.binary())], ["_task", "_row", "_sum"])

    def whole(t: pa.Table) -> pa.Table:
        parts = t.sort_by("_task").column("_sum").to_pylist()
        return pa.table({"_row": t.column("_row").slice(0, 1), "_sum": pa.array([np.sum([np.frombuffer(p) for p in parts], 0).tobytes()], pa.binary())})

    found = distinct.select("_x", "_w").mapInArrow(add, "_task int, _row int, _sum binary").groupBy("_row").applyInArrow(whole, "_row int, _sum binary").collect()
    out = np.zeros((rows, width))
    for r in found:
        out[r["_row"]] = np.frombuffer(r["_sum"])
    return out


def _exact_sums(distinct: DataFrame, width: int) -> list[int]:
    """Weighted sums by dimension: high and low parts add up exactly as doubles
    (entries to 2**40 over 2**33 rows, or to 2**53 over 2**20)."""
    def piece(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        high = x >> 20
        return np.stack([(high * w[:, None]).sum(0), ((x - (high << 20)) * w[:, None]).sum(0)])

    high, low = _added(distinct, width, 2, piece)
    return [(int(h) << 20) + int(v) for h, v in zip(high, low, strict=True)]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    """Model of a table of distinct vectors ``_x`` (array of long) with weights ``_w``."""
    n = int(distinct.agg(F.sum("_w")).first()[0])
    sums = _exact_sums(distinct, width)
    mean = np.array([s / n for s in sums])

    def piece(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = x - mean
        return c.T @ (c * w[:, None])

    cov = _added(distinct, width, width, piece) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return Model(n, sums, vectors[:, ::-1][:, :components], values[::-1][:components], float(np.trace(cov)))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the dimensions of (n * x - S)^2, exact; null beyond a long."""
    most = max(n * int(np.abs(x).max(initial=0)), n) + max(map(abs, sums))
    if most**2 * len(sums) < 2**63:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([d if d < 2**63 else None for d in exact], pa.int64())


def apply(distinct: DataFrame, model: Model) -> DataFrame:
    """_x, deviation and whitened (array of double, null where nothing varies) of each distinct vector, once."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)
    width = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        on = m.varies()
        turn = m.vectors / np.sqrt(np.where(on, m.values, 1.0))
        for b in _parts(batches):
            x = _matrix(b.column(0), width)
            w = (x - m.mean) @ turn
            values = pa.array(w.ravel(), mask=np.tile(~on, len(w)))
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _deviation(x, m.n, m.sums), pa.ListArray.from_arrays(offsets, values)],
                                             ["_x", "_rows", "deviation", "_white"])

    return distinct.select("_x", "_rows").mapInArrow(run, "_x array<bigint>, _rows long, deviation long, _white array<double>")


def identity_error(white: DataFrame, model: Model) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, weighted like the fit."""
    on = np.flatnonzero(model.varies()).tolist()
    if not on:
        return None
    total, w = F.sum("_w"), F.col("_w")
    z = {i: F.col("_white")[i] for i in on}
    means = white.agg(*[(F.sum(z[i] * w) / total).alias(f"m{i}") for i in on]).first()
    c = {i: z[i] - F.lit(means[f"m{i}"]) for i in on}
    row = white.agg(*[(F.sum(c[i] * c[j] * w) / total).alias(f"c{i}_{j}") for i in on for j in on if i <= j]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in on for j in on if i <= j)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "one", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error
    of every row; ``weights``: "one" or "count" for each distinct vector."""
    if weights not in ("one", "count"):
        raise ValueError('weights must be "one" or "count"')
    spark = vectors.sparkSession
    ship_package(spark)
    sound = F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where(sound)
    rows = materialize(rows.select("_key", integers(F.col("_v"), scale).alias("_x"), F.monotonically_increasing_id().alias("_row")), "whiten-rows")
    kind = rows.schema["_key"].dataType.simpleString()
    names = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("_x").alias("_size")).count().orderBy(F.desc("count"), F.desc("_size")).first()
    if length is None:
        return spark.createDataFrame([], names)
    width = length["_size"]
    rows = rows.where(F.size("_x") == width)
    distinct = materialize(rows.groupBy("_x").agg(F.count("*").alias("_rows")), "whiten-distinct")
    weight = F.col("_rows") if weights == "count" else F.lit(1).cast("long")
    model = fit(distinct.withColumn("_w", weight), width, components)
    white = materialize(apply(distinct, model), "whiten-white")
    error = identity_error(white.withColumn("_w", weight), model)
    # rows of a frequent vector are dealt over keys of their own; at most SPLIT vectors are frequent
    many = max(HOT, rows.count() // SPLIT)
    share = F.ceil(F.col("_rows") / many).cast("long")
    hot = white.where(F.col("_rows") > many).select("_x", share.alias("_shares"))
    left = rows.join(F.broadcast(hot), "_x", "left").withColumn("_share", F.pmod("_row", F.coalesce("_shares", F.lit(1).cast("long"))))
    right = white.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_rows") > many, share - 1).otherwise(F.lit(0).cast("long")))))
    back = left.join(right.select("_x", "_share", "deviation", "_white"), ["_x", "_share"])
    explained = [float(v / model.trace) if on else 0.0 for v, on in zip(model.values, model.varies(), strict=True)]
    out = back.select("_key", "deviation", F.posexplode("_white").alias("_i", "whitened"))
    return out.select(F.col("_key").alias(key), (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*map(F.lit, explained))[F.col("_i")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
