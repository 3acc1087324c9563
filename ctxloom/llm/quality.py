"""Quality rules: base counts and a hashed n-gram logistic regression.

The regression reads word 1- and 2-grams and character (code point) 3- and
5-grams, hashed into four blocks of ``BLOCK`` weights; a block's features are
shares (they sum to one), so long and short texts compare.  It is fitted with numpy in one task
from a bounded sample of labelled rows (``SAMPLE`` a class, drawn by hash of
the key), then calibrated (Platt scaling) on
the quarter of the sample that the fit did not see.  The model is
4 * ``BLOCK`` floats whatever the corpus, so it is broadcast.  Every text is
scored whole, in Arrow batches, against fixed thresholds on the probability.

Null and empty texts have no words and fail the base rules.  Without labelled
rows of both classes the model accepts everything (the base rules remain).
A label on several rows of a key, or rows that repeat a key, count as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.textops import WS, _mix, flat, hash_spans, rows_of, runs, slices, text_bytes
from ctxloom.session import ship_package

BLOCK = 1 << 16
#: Labelled rows of each class that the fit may see.
SAMPLE = 1_500
#: Kept at this calibrated probability of good quality, or more.
THRESHOLD = 0.3
SCALE = 30.0
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray  # float32, 4 blocks
    bias: float = 0.0
    slope: float = 1.0  # calibration: p = 1 / (1 + exp(-(slope * score + shift)))
    shift: float = 0.0
    trained: bool = False


def _count(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per row: words inside windows of ``size`` words that the row has twice or more."""
    rows = rows_of(first)
    n = len(hashes) - size + 1
    out = np.zeros(len(first) - 1, np.int64)
    if n <= 0:
        return out
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    key = rows[at].astype(np.uint64)
    for k in range(size):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1), hashes[at + k])
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        covered = np.zeros(len(hashes), bool)
        for k in range(size):
            covered[at[twice[near] == key] + k] = True
        np.add.at(out, rows[covered], 1)
    return out


def base_counts(buf: np.ndarray, offs: np.ndarray, texts: list[bytes], hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    n = int(offs[-1])
    body = buf[:n]
    out = {"n_words": np.diff(first).astype(np.int64),
           "word_chars": _count(((body & 0xC0) != 0x80) & ~WS[body], offs),
           "n_symbols": _count(_SYMBOLS[body], offs),
           "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
           "n_repeat_words": repeated_words(hashes, first)}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PCT * out["n_words"])
    return out


def grams(buf: np.ndarray, offs: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: (weight numbers, first of each row, end of each row)."""
    body = buf[:int(offs[-1])]
    top = np.uint64(48)
    chars = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[offs]  # first character of each row
    points = np.zeros(int(chars[-1]) + 4, np.uint64)
    points[:int(chars[-1])] = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
    for k, size in enumerate((3, 5)):
        key = np.zeros(int(chars[-1]), np.uint64)
        for i in range(size):  # the zeros lie behind the last text
            key = (key ^ points[i:len(points) - 4 + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        yield (key >> top).astype(np.int64) + k * BLOCK, chars[:-1], np.maximum(chars[:-1], chars[1:] - size + 1)
    yield (hashes >> top).astype(np.int64) + 2 * BLOCK, first[:-1], first[1:]
    pair = _mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15), hashes[1:]) if len(hashes) else hashes  # in order
    yield (pair >> top).astype(np.int64) + 3 * BLOCK, first[:-1], np.maximum(first[:-1], first[1:] - 1)


def _words(batch: pa.RecordBatch, column: str):
    col = batch.column(batch.schema.get_field_index(column))
    buf, offs = flat(col)
    starts, ends, first = runs(~WS[buf], offs)
    return buf, offs, text_bytes(col), hash_spans(buf, starts, ends), first


def raw_scores(model: Model, buf, offs, hashes, first) -> np.ndarray:
    z = np.full(len(offs) - 1, model.bias)
    for number, begin, end in grams(buf, offs, hashes, first):
        total = np.concatenate(([0.0], np.cumsum(model.weights[number], dtype=np.float64)))
        z += SCALE * (total[end] - total[begin]) / np.maximum(end - begin, 1)
    return z


def probability(model: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -500, 500))) if model.trained else np.ones(len(z))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_y, text) rows to (_y, weight numbers, values) as packed arrays."""
    for b in slices(batches, "_text", 1 << 20):
        buf, offs, _, hashes, first = _words(b, "_text")
        blocks = [*grams(buf, offs, hashes, first)]
        numbers, values = [], []
        for i in range(b.num_rows):
            num, val = [], []
            for number, begin, end in blocks:
                u, c = np.unique(number[begin[i]:end[i]], return_counts=True)
                num.append(u)
                val.append(c * (SCALE / max(1, end[i] - begin[i])))
            numbers.append(np.concatenate(num).astype(np.int32).tobytes())
            values.append(np.concatenate(val).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.binary()), pa.array(values, pa.binary())], ["_y", "_num", "_val"])


def _descend(y, rows, nums, vals, n_weights, steps, rate=0.1, penalty=1e-4):
    """Full-batch Adam on the logistic loss, the classes weighted alike."""
    w, bias = np.zeros(n_weights), 0.0
    m, v, mb, vb = np.zeros(n_weights), np.zeros(n_weights), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[nums], minlength=len(y)) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.bincount(nums, vals * r[rows], minlength=n_weights) + penalty * w
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE, steps: int = 60) -> Model:
    """Fit on at most ``sample`` labelled rows of each class; calibrate on a quarter of them."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    chosen = None
    for y in (0, 1):  # at most `sample` ids a class reach the driver
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    ids = [(r["_id"], r["_y"]) for r in chosen.distinct().collect()]
    model = Model(np.zeros(4 * BLOCK, np.float32))
    if len({y for _, y in ids}) < 2:
        return model
    spark = docs.sparkSession
    drawn = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(spark.createDataFrame(ids, known.schema)), "_id")
    one = drawn.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_y", "_text")  # a repeated key gives one text
    features = one.mapInArrow(_features, "_y int, _num binary, _val binary").withColumn("_all", F.lit(0))

    def fit(table: pa.Table) -> pa.Table:  # one task: the sample is bounded
        found = _fit(table, steps)
        return pa.table({"weights": pa.array([found.weights.tobytes()], pa.binary()), "bias": [found.bias], "slope": [found.slope],
                         "shift": [found.shift], "trained": [found.trained]})

    rows = features.groupBy("_all").applyInArrow(fit, "weights binary, bias double, slope double, shift double, trained boolean").collect()
    if not rows:
        return model
    (r,) = rows
    return Model(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["shift"], r["trained"])


def _fit(table: pa.Table, steps: int) -> Model:
    """Fit on three quarters of the rows, calibrate on the rest."""
    y = np.array(table.column("_y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(4 * BLOCK, np.float32))
    nums = [np.frombuffer(x, np.int32) for x in table.column("_num").to_pylist()]
    vals = [np.frombuffer(x, np.float32) for x in table.column("_val").to_pylist()]
    # the order of shuffled rows may differ between runs: take them in an order of their own
    order = sorted(range(len(y)), key=lambda i: (y[i], len(nums[i]), nums[i][:64].tobytes(), vals[i].tobytes()[:256]))
    held = np.zeros(len(y), bool)
    held[np.array(order)[np.arange(len(order)) % 4 == 3]] = True

    def pack(sel):
        sel = [i for i in order if sel[i]]
        rows = np.repeat(np.arange(len(sel), dtype=np.int32), [len(nums[i]) for i in sel])
        return y[sel], rows, np.concatenate([nums[i] for i in sel]), np.concatenate([vals[i] for i in sel])

    w, bias = _descend(*pack(~held), n_weights=4 * BLOCK, steps=steps)
    yh, rows, n, v = pack(held if held.any() and len(set(y[held])) == 2 else ~held)
    z = np.bincount(rows, v * w[n], minlength=len(yh)) + bias
    scale = max(1e-9, float(np.abs(z).mean()))
    (slope,), shift = _descend(yh, np.arange(len(yh)), np.zeros(len(yh), np.int64), z / scale, 1, 400, rate=0.05, penalty=1e-3)
    return Model(w.astype(np.float32), float(bias), float(slope) / scale, float(shift), True)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, the base counts, ``base_failed``, ``probability`` and ``kept`` of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    src = docs.select(key, F.col(text).alias("_text")) if key != "_text" else docs.select(key, text)
    schema = src.select(key, *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(True).alias("base_failed"),
                        F.lit(0.0).alias("probability"), F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 2 << 20):
            base, p = judge(sent.value, b, "_text")
            kept = ~base["base_failed"] & (p >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(base[c]) for c in COUNTS], pa.array(base["base_failed"]),
                                              pa.array(p), pa.array(kept)], schema.names)

    return src.mapInArrow(run, schema)


def judge(model: Model, batch: pa.RecordBatch, column: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    buf, offs, texts, hashes, first = _words(batch, column)
    return base_counts(buf, offs, texts, hashes, first), probability(model, raw_scores(model, buf, offs, hashes, first))


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass the base rules and the model, with all their columns."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 2 << 20):
            base, p = judge(sent.value, b, text)
            yield b.filter(pa.array(~base["base_failed"] & (p >= threshold)))

    return docs.mapInArrow(run, docs.schema)
