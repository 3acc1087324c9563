"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the
bytes before it, ``DEPTH`` deep.  A node (context of d bytes, bits of the byte so
far) has the Krichevsky-Trofimov estimate of its training counts, and

    P_w(node) = KT(node)                                          at full depth
    P_w(node) = 1/2 KT(node) + 1/2 product of P_w(children)       above

so a bit's probability mixes the estimates of all depths along its path, each
with the weight that the training text gives it.  A text is its bytes (A-Z in
lower case) and an end mark, with start marks before it; ``score`` is log10 of
its probability, a whole text's code length in another unit.

How it is spread:

1. A task counts, for each chunk of ``CHUNK`` bytes at most, the distinct
   (context, byte) grams and the distinct words, and puts the chunk's texts into
   a file in the shared store.  Held-out texts name their grams with count 0.
   Keys have a group: grams by a hash of their nearest four context bytes, words
   by their hash.  A row is what a sender has for a receiver, as packed arrays
   (sorted keys as delta byte planes).
2. Chunks and groups meet in steps (``Steps``).  A step sums the keys of at most
   ``FAN`` bundles of chunks for one remainder of the group, and deals the sums
   over ``FAN`` finer remainders, until a bundle is all chunks and a remainder is
   one group.  So a sender costs at most ``FAN`` rows for grams and as many for
   words in a step, whatever the corpus.  Bundles are planned for whole chunks: an
   input of many small partitions has more chunks in a bundle, each a smaller one.
3. A group weighs its subtrees, which begin at depth 4, and names its nodes of
   depth 3.  Their sums over all groups and the levels above are a table a level:
   own estimates, then a sum by parent upward, a join with the parent downward.
   Nothing of it passes the driver.  Each group gets its nodes' shares back and
   gives every gram its log probability.
4. The steps are gone back, each row gets the values of its keys, and a chunk's
   texts are scored against the table of its own grams and words.

No table of the whole corpus is held anywhere; what moves is the distinct grams
and words of each chunk.  Words are counted for the unigram base score.  Words are
known by 63 bits of a hash, unchecked: two that share them would count as one.

Null and empty texts are the end mark only.  A null key counts as the empty text
for the fold and is a training row.  Rows that repeat a key are documents of
their own.  Without training rows every estimate is one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import store
from ctxloom.llm.textops import FOLD, WS, flat, hash_spans, runs, slices
from ctxloom.session import materialize, ship_package

DEPTH = 6
#: The deepest level above the groups' subtrees.
TOP = 3
CHUNK = 32 << 20
DOCS_PER_GROUP = 1 << 13
#: Rows of a sender in a step, and senders of a receiver.
FAN = 64
#: Keys that a task gathers before it merges them.
MERGE = 3_000_000
FOLDS, HELD = 7, 2
MARK = 0xFF  # no byte of UTF-8: start and end of a text
END_WORD = np.int64(-1)


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD


def _gammaln(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series at x + 8)."""
    y = x + 8.0
    down = np.ones_like(y)
    for k in range(8):
        down *= x + k
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(down)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return np.where(n0 + n1 > 0, _gammaln(n0 + 0.5) + _gammaln(n1 + 0.5) - np.log(np.pi) - _gammaln(n0 + n1 + 1.0), 0.0)


def gram_keys(texts: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams, row offsets): the nearest context byte is the highest, the
    coded byte the lowest; one gram for each byte and one for the end mark."""
    n_rows, n = len(offs) - 1, int(offs[-1])
    padded = np.full(n + n_rows * (depth + 1), MARK, np.uint8)
    row = np.repeat(np.arange(n_rows), np.diff(offs))
    padded[np.arange(n) + row * (depth + 1) + depth] = texts[:n]
    wide = padded.astype(np.int64)
    end = len(padded)
    key = np.zeros(max(0, end - depth), np.int64)
    for k in range(1, depth + 1):
        key = key << 8 | wide[depth - k:end - k]
    key = key << 8 | wide[depth:]
    # places of coded bytes: all but each row's start marks
    keep = np.ones(len(key), bool)
    starts = offs[:-1] + np.arange(n_rows) * (depth + 1)
    for k in range(depth):
        at = starts[1:] + k - depth
        keep[at] = False
    return key[keep], offs + np.arange(n_rows + 1)


def count(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, how often, or the sum of weights)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys, weights = keys[by], weights[by]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[new], np.diff(np.append(new, len(keys)))
    return keys[new], np.add.reduceat(weights, new) if len(new) else np.zeros(0, weights.dtype)


def word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(negative 64-bit keys of the words, first word of each row)."""
    starts, ends, first = runs(~WS[buf], offs)
    key = (hash_spans(buf, starts, ends) | np.uint64(1 << 63)).view(np.int64)
    return np.where(key == END_WORD, np.int64(-2), key), first


def _nodes(keys: np.ndarray, n: np.ndarray, k: int):
    """Nodes of full depth for a byte's bit ``k``, in the order of the ascending
    grams: (context << 8 | bits so far, n0, n1, node of each gram, bit of each gram)."""
    node = keys >> 8 << 8 | 1 << k | (keys & 255) >> (8 - k)
    new = np.ones(len(keys), bool)
    new[1:] = node[1:] != node[:-1]
    start = np.flatnonzero(new)
    bit = (keys >> (7 - k) & 1).astype(bool)
    n1 = np.add.reduceat(n * bit, start).astype(np.float64)
    return node[start], np.add.reduceat(n, start) - n1, n1, (np.cumsum(new) - 1).astype(np.int32), bit


def climb(node, n0, n1, below) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One depth up: (node, n0, n1, log P_w, weight of the node's own estimate, parent of each child)."""
    parent, inverse = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
    a, b = np.bincount(inverse, n0, len(parent)), np.bincount(inverse, n1, len(parent))
    own = log_kt(a, b)
    both = np.logaddexp(own, np.bincount(inverse, below, len(parent))) - np.log(2)
    return parent, a, b, both, np.exp(own - np.log(2) - both), inverse


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, k: int, top: int):
    """For a byte's bit ``k`` (the trees of different bits share no node): (nodes at
    depth top + 1 with counts and log P_w; for each leaf the probability of a one
    from there down, and its node up there; leaf and bit of each gram)."""
    node, n0, n1, leaf, bit = _nodes(keys, n, k)
    level = [((n1 + 0.5) / (n0 + n1 + 1), np.ones(len(node)), np.arange(len(node)))]
    log_w, place = log_kt(n0, n1), np.arange(len(node))
    for _ in range(depth - top - 1):
        node, n0, n1, log_w, weight, inverse = climb(node, n0, n1, log_w)
        place = inverse[place]
        level.append(((n1 + 0.5) / (n0 + n1 + 1), weight, place))
    one = level[0][0]
    for estimate, weight, at in level[1:]:
        one = weight[at] * estimate[at] + (1 - weight[at]) * one
    return node, n0, n1, log_w, one, place, leaf, bit


def above(nodes: DataFrame, top: int) -> DataFrame:
    """From the nodes of depth ``top`` (``node, n0, n1, below``: counts and the log
    product of their children's P_w): ``node, share, left``, the share of a one that
    the depths 0 to ``top`` give and the weight left for what is below.  A table a
    depth: up by sums over a parent's children, down by joins with the parent."""
    estimate = F.pandas_udf(lambda a, b: pd.Series(log_kt(a.to_numpy(), b.to_numpy())), "double")
    levels = []
    for _ in range(top + 1):
        both = "greatest(own, below) + log1p(exp(-abs(own - below))) - ln(2D)"
        level = materialize(nodes.withColumn("own", estimate("n0", "n1")).selectExpr(
            "node", "shiftleft(shiftright(node, 16), 8) | (node & 255) AS parent", "n0", "n1", f"{both} AS log_w",
            f"exp(own - ln(2D) - ({both})) AS weight", "(n1 + 0.5D) / (n0 + n1 + 1) AS one"), "ctw_level")
        levels.append(level)
        nodes = level.groupBy(F.col("parent").alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
    out = levels.pop().selectExpr("node", "weight * one AS share", "1 - weight AS left")
    while levels:
        up = out.withColumnRenamed("node", "parent")
        out = levels.pop().join(up, "parent").selectExpr("node", "share + left * weight * one AS share", "left * (1 - weight) AS left")
    return out


class Steps:
    """How many steps lead from chunks to at least ``groups`` groups, and over how
    many rows a sender deals its keys in each."""

    def __init__(self, groups: int, limit: int = FAN):
        self.count, self.fan = 1, 2
        while limit ** self.count < groups:
            self.count += 1
        while self.fan ** self.count < groups:
            self.fan += 1
        self.groups = self.fan ** self.count

    def bundle(self, chunk: int) -> int:
        """The first step's bundle of a chunk; that of step k + 1 is its quotient by the fan."""
        return (chunk * 0x9E3779B97F4A7C15 >> 24) % self.groups // self.fan

    def deal(self, keys: np.ndarray, n: np.ndarray, step: int, depth: int, top: int) -> list[tuple[int, bytes, bytes]]:
        """What goes to each shelf (remainder of the group) of a step: (shelf, keys, counts); keys ascend."""
        shelf = group_of(keys, self.groups, depth, top) % self.fan ** step
        by = np.argsort(shelf, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(shelf[by])) + 1) if len(by) else []
        return [(int(shelf[i[0]]), pack_keys(keys[i]), pack(n[i])) for i in parts]


class Table:
    """Values by key, looked up with a few vectorised probes: a table of places
    for all keys, then ever smaller ones for those that met an occupied place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.probes = []
        left, seed = np.arange(len(keys), dtype=np.int32), 0x9E3779B97F4A7C15
        while len(left):
            bits = max(8, int(2 * len(left) + 1).bit_length())
            probe = np.uint64(seed), np.uint64(64 - bits)
            slot = self._slot(keys[left], *probe)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left
            self.probes.append((probe, table))
            left = left[table[slot] != left]
            seed = seed * 0xBF58476D1CE4E5B9 % 2**64 | 1

    @staticmethod
    def _slot(keys: np.ndarray, seed: np.uint64, shift: np.uint64) -> np.ndarray:
        x = keys.view(np.uint64) * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return (x >> shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, who = np.zeros(len(keys)), None
        for probe, table in self.probes:
            mine = keys if who is None else keys[who]
            at = table[self._slot(mine, *probe)]
            hit = (at >= 0) & (self.keys[at] == mine)
            if who is None:
                out[hit] = self.values[at[hit]]
                who = np.flatnonzero(~hit)
            else:
                out[who[hit]] = self.values[at[hit]]
                who = who[~hit]
            if not len(who):
                return out
        if len(keys):
            raise KeyError("a gram or word that the chunk did not name")
        return out


def _flat_lower(col) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = flat(col)
    return FOLD[buf], offs


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: differences in byte planes, zstd."""
    planes = np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def group_of(keys: np.ndarray, groups: int, depth: int, top: int) -> np.ndarray:
    """Group of each key: grams by their nearest top + 1 context bytes, words by themselves."""
    near = np.where(keys < 0, keys, keys >> 8 * (depth - top)).view(np.uint64)
    near = near * np.uint64(0x9E3779B97F4A7C15)
    return ((near ^ near >> np.uint64(29)) % np.uint64(groups)).view(np.int64)


def summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each row, all distinct keys, their counts)."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    n = [unpack(x, np.int64) for x in table.column("n").to_pylist()]
    return keys, *count(np.concatenate(keys), np.concatenate(n))


def replies(table: pa.Table, step: Steps, number: int, keys: list[np.ndarray], known: np.ndarray, value: np.ndarray) -> dict:
    """To the sender of each row of step ``number``: the values of its keys."""
    back = pa.array(np.asarray(table.column("shelf")) % step.fan ** (number - 1))
    return {"word": table.column("word"), "child": table.column("child"), "shelf": back, "keys": table.column("keys"),
            "value": pa.array([pack(value[np.searchsorted(known, k)]) for k in keys], pa.binary())}


SENT = "word boolean, child long, bundle long, shelf long, keys binary, n binary"
REPLY = "word boolean, child long, shelf long, keys binary, value binary"


def _merge(steps: Steps, k: int, depth: int, top: int):
    def merge(table: pa.Table) -> pa.Table:
        _, keys, n = summed(table)
        word, bundle = table.column("word")[0].as_py(), table.column("bundle")[0].as_py()
        sent = [(word, bundle, bundle // steps.fan, *part) for part in steps.deal(keys, n, k + 1, depth, top)]
        return pa.table([pa.array(c) for c in zip(*sent, strict=True)], ["word", "child", "bundle", "shelf", "keys", "n"])

    return merge


def gather(rows: DataFrame, steps: Steps, depth: int, top: int) -> list[DataFrame]:
    """The rows of every step, from the chunks' (step 1) to those that meet in groups."""
    tables = [rows]
    for k in range(1, steps.count):
        merged = tables[-1].groupBy("word", "bundle", "shelf").applyInArrow(_merge(steps, k, depth, top), SENT)
        tables.append(materialize(merged, "ctw_step"))
    return tables


def _give(steps: Steps, k: int):
    def give(sent: pa.Table, got: pa.Table) -> pa.Table:
        kind = np.int64 if sent.column("word")[0].as_py() else np.float32
        known = np.concatenate([unpack_keys(x) for x in got.column("keys").to_pylist()])
        value = np.concatenate([unpack(x, kind) for x in got.column("value").to_pylist()])
        by = np.argsort(known)
        return pa.table(replies(sent, steps, k, [unpack_keys(x) for x in sent.column("keys").to_pylist()], known[by], value[by]))

    return give


def hand_back(values: DataFrame, tables: list[DataFrame], steps: Steps) -> DataFrame:
    """From the groups' replies to the last step, back to the chunks'."""
    for k in range(steps.count - 1, 0, -1):
        got = values.withColumnRenamed("child", "bundle").groupBy("word", "bundle", "shelf")
        values = tables[k - 1].groupBy("word", "bundle", "shelf").cogroup(got).applyInArrow(_give(steps, k), REPLY)
    return values


def score(docs: DataFrame, work_dir: str, key: str = "doc_id", text: str = "text", depth: int = DEPTH, chunk: int = CHUNK,
          docs_per_group: int = DOCS_PER_GROUP, fan: int = FAN) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.
    ``work_dir``: a folder in the shared store for the chunks' texts."""
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    if fan < 2:
        raise ValueError("fan must be 2 or more")
    spark = docs.sparkSession
    ship_package(spark)
    top = min(TOP, depth - 1)
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    size = src.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0)).alias("bytes")).first()
    steps = Steps(max(8, size["rows"] // docs_per_group, size["bytes"] // chunk), fan)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = task.partitionId() << 32 | (task.taskAttemptId() & 0xFFFFF) << 12
        held, size, found = [], 0, []

        def close() -> pa.RecordBatch:
            nonlocal name, held, size, found
            with store.writing(f"{work_dir}/{name:x}.arrow") as f, pa.ipc.new_file(f, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            keys, n = count(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
            found = []
            words = int(np.searchsorted(keys, 0))  # their keys are negative
            rows = [(word, name, steps.bundle(name), *part) for word, mine in ((True, slice(0, words)), (False, slice(words, None)))
                    for part in steps.deal(keys[mine], n[mine], 1, depth, top)]
            name, held, size, found = name + 1, [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "child", "bundle", "shelf", "keys", "n"])

        for b in slices(batches, "_text", 1 << 20):
            held.append(b)
            buf, offs = _flat_lower(b.column(1))
            train = ~np.fromiter(map(held_out, b.column(0).to_pylist()), bool, b.num_rows)
            grams, at = gram_keys(buf, offs, depth)
            words, first = word_keys(buf, offs)
            for keys, bounds in ((grams, at), (words, first)):
                own = np.repeat(train, np.diff(bounds))
                found.append(count(keys[own]))
                rest, _ = count(keys[~own])
                found.append((rest, np.zeros(len(rest), np.int64)))
            found.append((np.array([END_WORD]), np.array([int(train.sum())], np.int64)))
            if sum(len(k) for k, _ in found) > MERGE:
                found = [count(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))]
            size += int(offs[-1])
            if size >= chunk:
                yield close()
        if held:
            yield close()

    tables = gather(materialize(src.mapInArrow(collect, SENT), "ctw_rows"), steps, depth, top)
    grams, words = (tables[-1].where(c).withColumn("group", F.col("shelf")) for c in ("NOT word", "word"))

    def summarise(table: pa.Table) -> pa.Table:
        _, keys, n = summed(table)
        found = [subtree(keys, n, depth, k, top)[:4] for k in range(8)]
        node, n0, n1, log_w = map(np.concatenate, zip(*found, strict=True))
        up, at = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
        sums = [pa.array(np.bincount(at, x, len(up))) for x in (n0, n1, log_w)]
        return pa.table([pa.array(np.full(len(up), table.column("group")[0].as_py())), pa.array(up), *sums], ["group", "node", "n0", "n1", "below"])

    # a node of depth ``top`` is in as many groups as it has children, 256 at most
    nodes = materialize(grams.groupBy("group").applyInArrow(summarise, "group long, node long, n0 double, n1 double, below double"), "ctw_nodes")
    ups = above(nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]), top)
    ups = nodes.select("group", "node").join(ups, "node")

    def weigh(table: pa.Table, up: pa.Table) -> pa.Table:
        rows, keys, n = summed(table)
        up = up.sort_by("node")
        known, share, left = (up.column(c).to_numpy() for c in ("node", "share", "left"))
        logs = np.zeros(len(keys))
        for k in range(8):
            node, _, _, _, one, place, leaf, bit = subtree(keys, n, depth, k, top)
            at = np.searchsorted(known, node >> 16 << 8 | node & 255)[place]
            one = share[at] + left[at] * one
            logs += np.where(bit, np.log10(one)[leaf], np.log10(1 - one)[leaf])
        return pa.table(replies(table, steps, steps.count, rows, keys, logs.astype(np.float32)))

    def total_words(table: pa.Table) -> pa.Table:
        rows, keys, n = summed(table)
        rest = [0] * (len(rows) - 1)  # the group's totals stand on its first row
        return pa.table({**replies(table, steps, steps.count, rows, keys, n), "n": pa.array([int(n.sum()), *rest], pa.int64()),
                         "v": pa.array([int((n > 0).sum()), *rest], pa.int64())})

    word_values = materialize(words.groupBy("group").applyInArrow(total_words, REPLY + ", n long, v long"), "ctw_words")
    total = word_values.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_types = int(total["n"] or 0), int(total["v"] or 0)
    values = grams.groupBy("group").cogroup(ups.groupBy("group")).applyInArrow(weigh, REPLY).unionByName(word_values.drop("n", "v"))
    schema = src.select(F.col("_key").alias(key), F.lit(True).alias("held_out"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")],
                        F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema

    def rate(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        name = table.column("child")[0].as_py()
        parts: dict[bool, list] = {False: [], True: []}
        for word, keys, value in zip(*(table.column(c).to_pylist() for c in ("word", "keys", "value")), strict=True):
            parts[word].append((unpack_keys(keys), unpack(value, np.int64 if word else np.float32)))
        bytes_, words = (Table(np.concatenate([k for k, _ in parts[w]]), np.concatenate([v for _, v in parts[w]])) for w in (False, True))
        end = float(words.get(np.array([END_WORD]))[0])
        arrow, out = to_arrow_schema(schema), []
        with store.reading(f"{work_dir}/{name:x}.arrow") as f, pa.ipc.open_file(f) as r:
            for k in range(r.num_record_batches):
                b = r.get_batch(k)
                buf, offs = _flat_lower(b.column(1))
                grams, at = gram_keys(buf, offs, depth)
                total = np.concatenate(([0.0], np.cumsum(bytes_.get(grams))))
                word, first = word_keys(buf, offs)
                c = words.get(word)
                base = np.concatenate(([0.0], np.cumsum(np.log10((c + 1) / (n_train + n_types + 1)))))
                known = np.concatenate(([0], np.cumsum(c > 0)))
                keys_ = b.column(0)
                out.append(pa.RecordBatch.from_arrays([
                    keys_, pa.array([held_out(x) for x in keys_.to_pylist()]), pa.array(np.diff(first) + 1),
                    pa.array(known[first[1:]] - known[first[:-1]] + (end > 0)), pa.array(np.full(b.num_rows, n_train, np.int64)),
                    pa.array(base[first[1:]] - base[first[:-1]] + np.log10((end + 1) / (n_train + n_types + 1))),
                    pa.array(total[at[1:]] - total[at[:-1]])], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    return hand_back(values, tables, steps).groupBy("child").applyInArrow(rate, schema)
