"""Benchmark decontamination by suffix arrays of the training texts.

Words are lower-cased runs of word bytes.  Each slice of a training shard gets
a word-level suffix array: positions ordered by their next words, which are
packed into 64-bit keys (as many words as fit).  Every benchmark suffix is
binary-searched in it; a range that still holds several words' ties is ordered
by the next key only there, so a suffix array costs one sort a slice and a
refinement where the benchmark touches it.  Suffix arrays live as long as their
slice: no shuffle, and no text leaves its task.

The benchmark is cut into blocks of about ``BLOCK_BYTES`` of text, long items
into pieces that overlap by a window less a word.  A block is built by a task
and written to the shared folder; tasks read one block at a time and search
all slices that they hold with it, so neither the driver nor a worker ever
holds more of the benchmark than a block.

A window is ``window`` consecutive words of an item (all of a shorter item).
Windows that occur one behind the other in an item and in a document make up a
longest verbatim match, also across blocks; documents are judged by the words
inside their longest matches.  Words are compared by 64-bit hashes.

Null and empty texts have no words; an item without words has no window.  A
null item_id counts as the empty string; rows that repeat an item_id count as
one item, each of their texts by itself.  Rows that repeat a document are
judged one by one.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import store
from ctxloom.llm.textops import flat, hash_spans, rows_of, runs, slices
from ctxloom.session import materialize, scratch_path, ship_package

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Words of a piece of an item; document bytes that a task holds for a round over the blocks; pairs of places looked at at once.
PIECE_WORDS = 1 << 17
HELD_BYTES = 32 << 20
PAIRS = 1 << 21
#: Contaminated when the hit words are at least one in this many.
ONE_IN = 20

#: Word bytes after folding: 0-9, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row) of a string column."""
    buf, offs = flat(col, fold=True)
    starts, ends, first = runs(WORD[buf], offs)
    return hash_spans(buf, starts, ends), first


@dataclass
class Block:
    """Searchable side: the vocabulary and the distinct windows of some pieces of items."""
    window: int
    vocab: np.ndarray      # ascending word hashes; rank is the place + 1
    bits: int              # of a rank
    words: np.ndarray      # windows (n, window) of ranks, 0 behind a shorter one
    lengths: np.ndarray    # words in each window
    first: np.ndarray      # of each window in the two below
    item: np.ndarray       # numbers of item texts
    at: np.ndarray         # first word of the window within the item
    ids: dict[int, str]    # item id of each text

    @property
    def per_key(self) -> int:
        return 63 // self.bits


def build_block(pieces: list[tuple[int, str, int, np.ndarray]], window: int = WINDOW) -> Block:
    """Windows of (number of the text, item id, first word, word hashes); equal windows are one."""
    vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for *_, h in pieces]]))
    bits = max(1, int(len(vocab)).bit_length())
    rows, lengths, item, at = [np.zeros((0, window), np.int32)], [], [], []
    for no, _, start, hashes in pieces:
        rank = (np.searchsorted(vocab, hashes) + 1).astype(np.int32)
        if not len(rank):
            continue
        n = max(1, len(rank) - window + 1)
        padded = np.concatenate((rank, np.zeros(max(0, window - len(rank)), np.int32)))
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
        lengths.append(np.full(n, min(window, len(rank))))
        item.append(np.full(n, no))
        at.append(start + np.arange(n))
    words = np.concatenate(rows)
    lengths, item, at = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (lengths, item, at))
    order = np.lexsort((at, item, *words.T[::-1])) if len(words) else np.zeros(0, np.int64)
    words, lengths, item, at = words[order], lengths[order], item[order], at[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    first = np.flatnonzero(new)
    return Block(window, vocab, bits, words[first].astype(np.int64), lengths[first], np.concatenate((first, [len(words)])).astype(np.int64),
                 item, at, {no: name for no, name, *_ in pieces})


class SuffixArray:
    """Word positions of a slice ordered by their next ``per_key`` known words."""

    def __init__(self, ranks: np.ndarray, bits: int, per_key: int):
        self.bits, self.per_key = bits, per_key
        padded = np.concatenate((ranks, np.zeros(per_key, np.int64)))
        key = np.zeros(len(ranks), np.int64)
        for i in range(per_key):
            key = key << bits | padded[i:i + len(ranks)]
        self.key = np.concatenate((key, np.zeros(64 * per_key, np.int64)))
        at = np.flatnonzero(ranks)
        self.order = at[np.argsort(key[at], kind="stable")]
        self.sorted = key[self.order]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(window number, positions where it stands) of every window that occurs."""
        if not len(windows) or not len(self.order):
            return
        keys, ends = self._keys(windows, lengths, 0)
        low, high = np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, ends, "right")
        open_ = [(w, self.order[low[w]:high[w]]) for w in np.flatnonzero(high > low)]
        depth = 1
        while open_:
            deeper, sorted_once = [], {}
            for w, found in open_:
                if lengths[w] <= depth * self.per_key:
                    yield int(w), found
                    continue
                # windows with the same words so far share one refined range
                mark = (int(found[0]), len(found))
                if mark not in sorted_once:
                    key = self.key[found + depth * self.per_key]
                    by = np.argsort(key, kind="stable")
                    sorted_once[mark] = (key[by], found[by])
                key, found = sorted_once[mark]
                a, b = self._keys(windows[w:w + 1], lengths[w:w + 1], depth)
                i, j = np.searchsorted(key, a[0], "left"), np.searchsorted(key, b[0], "right")
                if j > i:
                    deeper.append((w, found[i:j]))
            open_, depth = deeper, depth + 1

    def _keys(self, windows, lengths, depth) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest key that a window's words at ``depth`` allow."""
        low, high = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        for i in range(depth * self.per_key, (depth + 1) * self.per_key):
            word = windows[:, i] if i < windows.shape[1] else np.zeros(len(windows), np.int64)
            given = i < lengths
            low = low << self.bits | np.where(given, word, 0)
            high = high << self.bits | np.where(given, word, (1 << self.bits) - 1)
        return low, high


def search(block: Block, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in rows of words: (window number, row, first word within the row)."""
    none = np.zeros(0, np.int64)
    if not len(block.vocab) or not len(hashes):
        return none, none, none
    near = np.minimum(np.searchsorted(block.vocab, hashes), len(block.vocab) - 1)
    rank = np.where(block.vocab[near] == hashes, near + 1, 0)
    rows = rows_of(first)
    ranks = np.zeros(len(hashes) + len(first), np.int64)  # a 0 behind each row: no match runs across
    ranks[np.arange(len(hashes)) + rows] = rank
    found = [*SuffixArray(ranks, block.bits, block.per_key).search(block.words, block.lengths)]
    if not found:
        return none, none, none
    at = np.concatenate([p for _, p in found])
    begin = first[:-1] + np.arange(len(first) - 1)
    row = np.searchsorted(begin, at, "right") - 1
    return np.repeat([w for w, _ in found], [len(p) for _, p in found]), row, at - begin[row]


#: Places of longest matches: row, first word, number of the item text, first word in it, words.
FIELDS = 5


def longest(block: Block, window: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Longest verbatim matches (n, FIELDS) within a block: occurrences of
    consecutive windows of an item on one diagonal are one match.

    A window may stand at many places of the benchmark and of a document: the
    pairs of places are looked at ``PAIRS`` at a time, whole items and rows together."""
    out = [np.zeros((0, FIELDS), np.int64)]
    count = np.diff(block.first)[window]
    by = np.argsort(row, kind="stable")
    window, row, at, count = window[by], row[by], at[by], count[by]
    rows = np.concatenate((np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), [len(row)])) if len(row) else np.zeros(1, np.int64)
    total = np.concatenate(([0], np.cumsum(count)))
    begin = 0
    while begin < len(rows) - 1:
        end = max(begin + 1, int(np.searchsorted(total[rows], total[rows[begin]] + PAIRS, "right")) - 1)
        w, r, p = (x[rows[begin]:rows[end]] for x in (window, row, at))
        pairs = int(total[rows[end]] - total[rows[begin]])
        # one row with more pairs: its items in parts, as a match stays within an item
        parts = -(-pairs // PAIRS) if end == begin + 1 else 1
        for part in range(parts):
            out.append(_diagonals(block, w, r, p, part, parts))
        begin = end
    return np.concatenate(out)


def _diagonals(block: Block, window, row, at, part: int, parts: int) -> np.ndarray:
    found = []
    step = max(1, len(window) // parts)
    for lo in range(0, len(window), step):  # spelled out some windows at a time, kept only for this part's items
        w = window[lo:lo + step]
        count = block.first[w + 1] - block.first[w]
        who = np.repeat(np.arange(len(w)), count)
        place = np.repeat(block.first[w], count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        if parts > 1:
            own = block.item[place] % parts == part
            who, place = who[own], place[own]
        found.append(np.stack([row[lo:lo + step][who], at[lo:lo + step][who], block.item[place], block.at[place], block.lengths[w[who]]], 1))
    return joined(np.concatenate(found), block.window)


def joined(found: np.ndarray, window: int) -> np.ndarray:
    """Matches that go on where another one of the same row, item and diagonal stands are one."""
    if not len(found):
        return found.reshape(0, FIELDS)
    r, p, i, q, size = found[np.lexsort((found[:, 1], found[:, 1] - found[:, 3], found[:, 2], found[:, 0]))].T
    new = np.ones(len(r), bool)  # the last window of a match is followed by the next one's first
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] > p[:-1] + size[:-1] - np.minimum(size[:-1], window) + 1)
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(p + size, begin)
    return np.stack([r[begin], p[begin], i[begin], q[begin], end - p[begin]], 1)


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
           piece_words: int = PIECE_WORDS) -> list[str]:
    """Files of the benchmark's blocks in the shared folder, built and written by tasks."""
    spark = benchmark.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "files", f"benchmark-{uuid.uuid4().hex[:12]}")
    items = materialize(benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_item"), F.col(text).alias("_text"))
                        .where("_text IS NOT NULL").distinct().withColumn("_no", F.monotonically_increasing_id()), "benchmark-items")
    n = int((items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // block_bytes) + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            hashes, first = word_hashes(b.column(1))
            for k in range(b.num_rows):
                own = hashes[first[k]:first[k + 1]]
                for at in range(0, max(1, len(own) - window + 1) if len(own) else 0, piece_words):
                    part = own[at:at + piece_words + window - 1]
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(k, 1), b.column(0).slice(k, 1), pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                                                     ["_no", "_item", "_at", "_words"])

    def build(t: pa.Table) -> pa.Table:
        found = sorted(zip(*(c.to_pylist() for c in t.columns[1:]), strict=True), key=lambda r: (r[0], r[2]))
        block = build_block([(no, item, at, np.frombuffer(w, np.uint64)) for no, item, at, w in found], window)
        path = f"{folder}/{uuid.uuid4().hex}.block"
        with store.writing(path) as f:
            f.write(zstandard.compress(pickle.dumps(block), 1))
        return pa.table({"path": [path]})

    cut = items.select("_item", "_text", "_no").mapInArrow(pieces, "_no long, _item string, _at long, _words binary")
    cut = cut.select(F.pmod(F.xxhash64("_no", "_at"), F.lit(n)).alias("_block"), "_no", "_item", "_at", "_words")
    return sorted(r["path"] for r in cut.groupBy("_block").applyInArrow(build, "path string").collect())


@lru_cache(1)
def load_block(path: str) -> Block:
    """One block at a time in a worker."""
    with store.reading(path) as f:
        return pickle.loads(zstandard.decompress(f.read()))


@dataclass
class Judged:
    """A slice of documents: its rows, words and longest matches."""
    batch: pa.RecordBatch
    words: np.ndarray
    hit: np.ndarray
    matches: np.ndarray          # (n, FIELDS), by row
    names: dict[int, str]        # item ids of the texts in them

    def of_rows(self) -> list[np.ndarray]:
        return np.split(self.matches, np.searchsorted(self.matches[:, 0], np.arange(1, self.batch.num_rows)))


def judge(batches: Iterator[pa.RecordBatch], column: str, paths: list[str], window: int = WINDOW) -> Iterator[Judged]:
    """Slices with their longest matches, all blocks over ``HELD_BYTES`` of documents at a time."""
    def done(held):
        found = [[np.zeros((0, FIELDS), np.int64)] for _ in held]
        names: list[dict[int, str]] = [{} for _ in held]
        for path in paths:
            block = load_block(path)
            for k, (_, hashes, first) in enumerate(held):
                here = longest(block, *search(block, hashes, first))
                if len(here):
                    found[k].append(here)
                    names[k].update((i, block.ids[i]) for i in np.unique(here[:, 2]).tolist())
        for (batch, hashes, first), parts, own in zip(held, found, names, strict=True):
            matches = joined(np.concatenate(parts), window) if len(parts) > 2 else parts[-1]
            matches = matches[np.argsort(matches[:, 0], kind="stable")]
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, first[matches[:, 0]] + matches[:, 1], 1)
            np.add.at(edge, first[matches[:, 0]] + matches[:, 1] + matches[:, 4], -1)
            total = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
            yield Judged(batch, np.diff(first).astype(np.int64), total[first[1:]] - total[first[:-1]], matches, own)

    held, size = [], 0
    for b in slices(batches, column, 4 << 20):
        col = b.column(b.schema.get_field_index(column))
        held.append((b, *word_hashes(col)))
        size += col.nbytes
        if size >= HELD_BYTES:
            yield from done(held)
            held, size = [], 0
    yield from done(held)


def _contaminated(j: Judged) -> np.ndarray:
    return (j.hit > 0) & (ONE_IN * j.hit >= j.words)


def score(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated of every row;
    n_matches, the number of longest matches, and longest_words, longest_item and
    longest_at (first word in the document) of the longest one (of equal ones the
    first in the document, then the least item id; null without any)."""
    ship_package(docs.sparkSession)
    paths = blocks(benchmark, window=window)
    src = docs.select(F.col(key), F.col(text).alias("_text"))
    number = F.lit(0).cast("long")
    none = F.when(F.lit(False), number)
    schema = src.select(key, *[number.alias(c) for c in ("n_words", "n_hit", "n_items")], F.lit("").alias("items_sha256"), F.lit(True).alias("contaminated"),
                        number.alias("n_matches"), none.alias("longest_words"), none.cast("string").alias("longest_item"), none.alias("longest_at")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j in judge(batches, "_text", paths, window):
            n_items, sha, best = [], [], []
            for own in j.of_rows():
                ids = sorted({j.names[i] for i in np.unique(own[:, 2]).tolist()})
                n_items.append(len(ids))
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                top = own[own[:, 4] == own[:, 4].max()] if len(own) else own
                best.append(min(((int(p), j.names[int(i)], int(n)) for _, p, i, _, n in top), default=(None, None, None)))
            count = np.bincount(j.matches[:, 0], minlength=j.batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [j.batch.column(0), pa.array(j.words), pa.array(j.hit), pa.array(n_items, pa.int64()), pa.array(sha), pa.array(_contaminated(j)),
                 pa.array(count, pa.int64()), pa.array([n for *_, n in best], pa.int64()), pa.array([i for _, i, _ in best], pa.string()),
                 pa.array([p for p, *_ in best], pa.int64())], schema.names)

    return src.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches with their places: key, doc_word, item_id, item_word, n_words."""
    ship_package(docs.sparkSession)
    paths = blocks(benchmark, window=window)
    src = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = src.select(key, F.lit(0).cast("long").alias("doc_word"), F.lit("").alias("item_id"),
                        F.lit(0).cast("long").alias("item_word"), F.lit(0).cast("long").alias("n_words")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j in judge(batches, "_text", paths, window):
            r, p, i, q, n = j.matches.T
            yield pa.RecordBatch.from_arrays([j.batch.column(0).take(pa.array(r)), pa.array(p), pa.array([j.names[k] for k in i.tolist()], pa.string()),
                                              pa.array(q), pa.array(n)], schema.names)

    return src.mapInArrow(run, schema)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    ship_package(docs.sparkSession)
    paths = blocks(benchmark, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j in judge(batches, text, paths, window):
            yield j.batch.filter(pa.array(~_contaminated(j)))

    return docs.mapInArrow(run, docs.schema)
