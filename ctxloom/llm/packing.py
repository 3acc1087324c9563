"""Order-preserving packing into sequences by dynamic programming.

The documents of a task form one stream of ids (each document's end id behind
it).  Window cuts may stand behind a document, behind a sentence (an id whose
text ends with . ! ? or the like) at ``SENTENCE_COST``, and every ``GRID`` ids
of a stretch without either at ``TEAR_COST``.  With positions p and penalties c,

    best(j) = c(j) + min over i of  best(i) + padding(p_j - p_i),   0 < p_j - p_i <= size

Padding is ``size - length``, so the minimum over the window is that of
best(i) + p_i: a monotone queue gives each step in constant time.  A length
that is a power of two is not padded; those from ``SHORT`` up are tried too.

A task's stream is solved in parts of ``PART`` ids.  All windows of a part but
the last are final; the last one's ids open the next part, so parts add no
padding.  The rest of a task's stream is padded once or torn into powers of two,
whichever costs less.  Nothing is shuffled: a sequence holds neighbours of the
input order.

Null and empty texts are one end id.  Rows that repeat a key are documents of
their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import tokens
from ctxloom.llm.textops import slices
from ctxloom.session import ship_package

SIZE = 4096
END = 2
SENTENCE_COST = 48
TEAR_COST = 256
GRID = 256
SHORT = 256
PART = 1 << 20

SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？")


def sentence_ids(spec: bytes) -> np.ndarray:
    """Flag for each id: its text ends a sentence."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_buffer(spec).get_vocab(with_added_tokens=True)
    flags = np.zeros(max(vocab.values()) + 1, bool)
    for text, i in vocab.items():
        flags[i] = text.removesuffix("</w>").endswith(SENTENCE_ENDS)
    return flags


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where a cut may stand, from 0 to the last id."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    cost[np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = 0
    if cost[n] < 0:
        cost[n] = TEAR_COST
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > GRID)
    if len(wide):
        more = np.concatenate([np.arange(at[k] + GRID, at[k + 1], GRID) for k in wide.tolist()])
        cost[more] = TEAR_COST
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def solve(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> tuple[list[float], list[int]]:
    """best(j) and the cut before j of each boundary."""
    p, c = at.tolist(), cost.tolist()
    n = len(p)
    place = np.full(p[-1] + 1, -1, np.int64)
    place[at] = np.arange(n)
    powers = [1 << k for k in range(SHORT.bit_length() - 1, (size - 1).bit_length())]
    from_power = []
    for w in powers:  # the boundary exactly a power of two before each
        back = at - w
        from_power.append(np.where(back >= 0, place[np.maximum(back, 0)], -1).tolist())
    best, before = [0.0] * n, [-1] * n
    queue, value = [0], [0]  # boundaries by place; best(i) + p_i ascends
    head = 0
    for j in range(1, n):
        pj = p[j]
        while p[queue[head]] < pj - size:
            head += 1
        i = queue[head]
        b = value[head] + size - pj
        for back in from_power:
            k = back[j]
            if k >= 0 and best[k] < b:
                b, i = best[k], k
        b += c[j]
        best[j], before[j] = b, i
        v = b + pj
        while len(queue) > head and value[-1] >= v:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(v)
    return best, before


def tail_cost(length: int, size: int = SIZE) -> int:
    return min(size - length, TEAR_COST * (length.bit_count() - 1))


def cut(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, last: bool, size: int = SIZE) -> list[int]:
    """Ends of the windows of a stream; of a part that is not the ``last``, without its last window."""
    if not len(ids):
        return []
    at, cost = boundaries(ids, doc_ends, ends_sentence)
    best, before = solve(at, cost, size)
    n, p = len(ids), at.tolist()
    near = range(int(np.searchsorted(at, n - size, "left")), len(p) - 1)
    # the window from here to the end: a rest, padded or torn; of a part, still open
    i = min(near, key=lambda k: best[k] + (tail_cost(n - p[k], size) if last else 0) + (0 if last else (k + 1 - len(p)) * 1e-9))
    ends = []
    k = i
    while k > 0:
        ends.append(p[k])
        k = before[k]
    ends.reverse()
    if last:
        rest = n - p[i]
        if TEAR_COST * (rest.bit_count() - 1) < size - rest:
            at_ = p[i]
            for b in range(size.bit_length() - 1, -1, -1):
                if rest >> b & 1:
                    at_ += 1 << b
                    ends.append(at_)
        else:
            ends.append(n)
    return ends


def _pieces(starts: np.ndarray, doc_ends: np.ndarray, ids: np.ndarray, ends: list[int], number: int) -> list[tuple]:
    """(row, start in its document, length, crc, sequence, offset) of each piece up to the last end."""
    begin = np.concatenate(([0], doc_ends[:-1]))
    edges = np.unique(np.concatenate(([0], doc_ends, ends)))
    edges = edges[edges <= ends[-1]]
    a, b = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, a, "right")
    ends_ = np.array(ends)
    window = np.searchsorted(ends_, a, "right")
    from_ = np.concatenate(([0], ends_[:-1]))[window]
    raw = ids.astype("<u4").tobytes()
    return [(int(d), int(starts[d] + x - begin[d]), int(y - x), zlib.crc32(raw[4 * x:4 * y]), number + int(w), int(x - f))
            for d, x, y, w, f in zip(doc.tolist(), a.tolist(), b.tolist(), window.tolist(), from_.tolist(), strict=True)]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, special: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``sequence_id`` is the task's number times 2^32 plus a count; ``special`` as in ``tokens``."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = tokens.send(spark, tokenizer)
    flags = spark.sparkContext.broadcast(sentence_ids(sent.value))
    src = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = src.select(key, *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(sent, special)
        number = TaskContext.get().partitionId() << 32
        keys, starts, sizes, ids, held = [], [], [], [], 0

        def flush(last: bool):
            nonlocal keys, starts, sizes, ids, held, number
            stream = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            start, doc_size = np.array(starts, np.int64), np.array(sizes, np.int64)
            doc_ends = np.cumsum(doc_size - start)
            ends = cut(stream, doc_ends, flags.value, last, size)
            if not ends:
                return None
            rows = _pieces(start, doc_ends, stream, ends, number)
            number += len(ends)
            doc, *cols = zip(*rows, strict=True)
            cols.insert(3, [sizes[d] for d in doc])
            out = pa.RecordBatch.from_arrays([pa.array([keys[d] for d in doc], key_type), *[pa.array(c, pa.int64()) for c in cols]], schema.names)
            done = ends[-1]
            d = int(np.searchsorted(doc_ends, done, "right"))  # the first document with ids left
            begin = int(doc_ends[d - 1]) if d else 0
            keys, sizes = keys[d:], sizes[d:]
            starts = [int(start[d]) + done - begin, *starts[d + 1:]] if keys else []
            ids, held = [stream[done:]], len(stream) - done
            return out

        key_type = None
        for b in slices(batches, "_text", 2 << 20):
            key_type = b.column(0).type
            flat, offs = tokens.with_end(*enc.encode(b.column(1)), end)
            keys += b.column(0).to_pylist()
            starts += [0] * b.num_rows
            sizes += np.diff(offs).tolist()
            ids.append(flat)
            held += len(flat)
            if held >= PART and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    return src.mapInArrow(run, schema)
