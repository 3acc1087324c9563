"""Vectorised byte and word helpers shared by the operators that run in Arrow batches.

Texts are handled as one flat UTF-8 byte array per slice of a batch plus row
offsets, so masks, word spans and hashes are numpy passes over whole slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 16
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)

#: ASCII white space: space and \t \n \v \f \r.
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def text_bytes(col) -> list[bytes]:
    """A string column of a batch as UTF-8 bytes; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    return col.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``max_bytes`` per
    slice (one longer text is a slice of its own): bounds what the numpy passes
    need, whatever the batch size of the session."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        size = np.asarray(size.to_numpy(zero_copy_only=False), np.int64)
        at = 0
        while at < len(size):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


def flat(col, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes followed by PAD zero bytes, row offsets) of a string column."""
    texts = text_bytes(col)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    buf = np.frombuffer(b"".join([*texts, b"\0" * PAD]), np.uint8)
    return (FOLD[buf] if fold else buf), offs


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row: (starts, ends, first run of each row and the total)."""
    n = int(offs[-1])
    m = mask[:n]
    first, last = m.copy(), m.copy()
    if n:
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        full = offs[1:] > offs[:-1]
        begin, end = offs[:-1][full], offs[1:][full] - 1
        first[begin], last[end] = m[begin], m[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    return h ^ (h >> np.uint64(32))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step; spans over 512 bytes by xxh3."""
    import xxhash

    words = np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf).data, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * _C1
    at, left, who = starts.copy(), length.copy(), np.arange(len(starts))
    for i in np.flatnonzero(length > 512):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i]:ends[i]].tobytes())
    who = who[(length > 0) & (length <= 512)]
    at, left = at[who], left[who]
    while len(who):
        x = words[at]
        short = left < 8
        x = np.where(short, x & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), x)
        h[who] = _mix(h[who], x)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return h


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each run, from the third result of ``runs``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's runs (0 for a row without any)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
