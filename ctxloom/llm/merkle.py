"""Merkle manifest of a dataset: a SHA-256 midstate tree over every row.

A row's leaf is the hash of its columns; a group's leaves, ascending by key,
are folded three at a time into the group's root; the groups' roots, ascending
by group (null first), likewise into the root of the dataset.  Digests enter a
hash as 64 hex characters, one block of SHA-256, so a parent keeps the hash
state before each child's slot.  Checking a changed leaf resumes the state of
its slot with the new digest and the siblings to its right; what lies to the
left is never hashed again.

Rows get their places by a range sort and counts of each sorted part, so a
group of any size is spread over tasks.  A task then builds whole subtrees of
``3 ** LEVELS`` leaves and takes its leaves' folds that far; the subtrees'
roots (one row for 6,561) are the leaves of the next round.  A round's nodes
keep their way up as packed records (slot, children, state, the children),
which are joined to the leaves by subtree, at most 6,561 rows a key.

A null is ``-`` in a leaf; empty texts are values of their own.  Rows that
repeat a key stand in the order of their leaves, so the result does not depend
on the order of the input; equal rows have equal leaves, and which of their
places each one takes does not matter to anyone but the proofs.  A null key
sorts first and reads as the empty text in ``tampered``.  An empty table gives
no rows.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.session import materialize, ship_package

FAN = 3
#: Levels that one task builds at once: subtrees of 6,561 leaves.
LEVELS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: slot, children, state before the slot, the three children.
RECORD = 2 + 32 + 32 * FAN
_CHUNK = 4096


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The first 32 bits of the fractions of square and cube roots of primes, as the standard says.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_K = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), "<u2")


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states after one more block: (rows, 8) and (rows, 16) words."""
    out = np.empty((len(state), 8), np.uint32)
    for at in range(0, len(state), _CHUNK):
        s, w = state[at:at + _CHUNK].T.copy(), [*block[at:at + _CHUNK].T.copy()]
        a, b, c, d, e, f, g, h = s
        for t in range(64):
            if t >= 16:
                x, y = w[t - 15], w[t - 2]
                w.append(w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
            one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + _K[t] + w[t]
            two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
            a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
        out[at:at + _CHUNK] = (s + np.stack([a, b, c, d, e, f, g, h])).T
    return out


def hexed(digest: np.ndarray) -> np.ndarray:
    """The 64 hex characters of (rows, 8) digests as blocks of (rows, 16) words."""
    raw = np.ascontiguousarray(digest).astype(">u4").view(np.uint8).reshape(len(digest), 32)
    return _HEX[raw].view(">u4").astype(np.uint32)


def ending(blocks: np.ndarray) -> np.ndarray:
    """The padding block after so many whole blocks, a row each."""
    out = np.zeros((len(blocks), 16), np.uint32)
    out[:, 0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    out[:, 14], out[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return out


def _start(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))


def _words(col: pa.Array) -> np.ndarray:
    """A column of 32-byte digests as (rows, 8) words."""
    return np.frombuffer(b"".join(col.to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8)


def _packed(digest: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(digest).astype(">u4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def levels_of(n: np.ndarray) -> np.ndarray:
    """Levels above n leaves: how often their number is cut to a third before one remains."""
    out, left = np.zeros(len(n), np.int64), n.copy()
    while (left > 1).any():
        out += left > 1
        left = np.where(left > 1, -(-left // FAN), left)
    return out


def parents(pos: np.ndarray, tree: np.ndarray, digest: np.ndarray):
    """One level up, for nodes ascending by (tree, pos): (first child, children, states before each slot, digests) of the parents."""
    up = pos // FAN
    first = np.flatnonzero(np.concatenate(([True], (up[1:] != up[:-1]) | (tree[1:] != tree[:-1]))))
    n = np.diff(np.concatenate((first, [len(pos)])))
    block = hexed(digest)
    state = _start(len(first))
    kept = [state]
    for j in range(FAN):
        has = n > j
        after = state.copy()
        after[has] = compress(state[has], block[first[has] + j])
        state = after
        kept.append(state)
    return first, n, kept[:FAN], compress(state, ending(n))


def resume(state: np.ndarray, slot: np.ndarray, n: np.ndarray, kids: list[np.ndarray], digest: np.ndarray) -> np.ndarray:
    """Parents' digests with ``digest`` in ``slot``: from the state before the slot, over the siblings to the right."""
    state = compress(state, hexed(digest))
    for j in range(1, FAN):
        right = (slot < j) & (j < n)
        if right.any():
            state[right] = compress(state[right], hexed(kids[j][right]))
    return compress(state, ending(n))


def absorb(state: np.ndarray, count: np.ndarray, slot: np.ndarray, n: np.ndarray, kids: list[np.ndarray]) -> None:
    """Hash the siblings of ``slot`` onto ``state``, left to right, in place."""
    for j in range(FAN):
        other = (slot != j) & (j < n)
        if other.any():
            state[other] = compress(state[other], hexed(kids[j][other]))
            count[other] += 1


def _subtrees(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Whole subtrees of a task's rows, ascending by (_tree, _pos), some thousands of rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            tree, sub = t.column("_tree").to_numpy(), t.column("_pos").to_numpy() // FAN**LEVELS
            cut = np.flatnonzero((tree[1:] != tree[:-1]) | (sub[1:] != sub[:-1]))
            if len(cut):
                yield t.slice(0, int(cut[-1]) + 1)
                t = t.slice(int(cut[-1]) + 1)
            held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _climb(t: pa.Table):
    """Each level of a batch of subtrees: (rows concerned, their slot, number of children, state, children)
    for every row of the batch; then the digest on top of each row's subtree."""
    tree, pos, digest = t.column("_tree").to_numpy(), t.column("_pos").to_numpy(), _words(t.column("_digest"))
    left = np.minimum(levels_of(t.column("_n").to_numpy()), LEVELS)
    node, top = np.arange(len(pos)), digest.copy()  # each row's node on this level, -1 once its tree is finished
    for level in range(LEVELS):
        live = left > level
        if not live.any():
            break
        node = np.where(node >= 0, np.where(live, np.cumsum(live) - 1, -1)[node], -1)
        tree, pos, digest, left = tree[live], pos[live], digest[live], left[live]
        first, n, states, above = parents(pos, tree, digest)
        rows = np.flatnonzero(node >= 0)
        up, slot = np.repeat(np.arange(len(first)), n)[node[rows]], pos[node[rows]] % FAN
        kids = [digest[np.minimum(first[up] + j, len(digest) - 1)] for j in range(FAN)]
        yield rows, slot, n[up], np.choose(slot[:, None], [s[up] for s in states]), kids
        node[rows], top[rows] = up, above[up]
        tree, pos, digest, left = tree[first], pos[first] // FAN, above, left[first]
    yield top


def _dealt(nodes: DataFrame) -> DataFrame:
    """Whole subtrees in a task, ascending."""
    return nodes.repartition("_tree", F.expr(f"_pos div {FAN**LEVELS}")).sortWithinPartitions("_tree", "_pos")


def _heads(t: pa.Table, top: np.ndarray) -> pa.Array:
    """The subtree's root in its first row, null in others."""
    first = t.column("_pos").to_numpy() % FAN**LEVELS == 0
    return pa.array([r.tobytes() if f else None for r, f in zip(top.astype(">u4"), first, strict=True)], pa.binary())


def _fold_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _subtrees(batches):
        fold, proof, count = _words(t.column("_found")), _start(t.num_rows), np.zeros(t.num_rows, np.int64)
        top = None
        for step in _climb(t):
            if not isinstance(step, tuple):
                top = step
                continue
            rows, slot, n, state, kids = step
            fold[rows] = resume(state, slot, n, kids, fold[rows])
            p, c = proof[rows], count[rows]
            absorb(p, c, slot, n, kids)
            proof[rows], count[rows] = p, c
        out = t.select(["_key", "_tree", "_pos", "_n", "_digest"])
        for name, col in (("_fold", _packed(fold)), ("_proof", _packed(proof)), ("_count", pa.array(count)), ("_head", _heads(t, top))):
            out = out.append_column(name, col)
        yield from out.to_batches()


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper nodes with their records to the top of their subtree."""
    for t in _subtrees(batches):
        ways, top = [b""] * t.num_rows, None
        for step in _climb(t):
            if not isinstance(step, tuple):
                top = step
                continue
            rows, slot, n, state, kids = step
            packed = np.concatenate([np.stack([slot, n], 1).astype(np.uint8), *[x.astype(">u4").view(np.uint8).reshape(len(rows), 32) for x in (state, *kids)]], 1)
            for i, r in zip(rows.tolist(), packed, strict=True):
                ways[i] += r.tobytes()
        out = t.select(["_tree", "_pos", "_n"])
        out = out.append_column("_way", pa.array(ways, pa.binary())).append_column("_head", _heads(t, top))
        yield from out.to_batches()


def _above(rows: DataFrame) -> DataFrame:
    """The roots of the subtrees of a round as the nodes of the next."""
    size = FAN**LEVELS
    return rows.where("_head IS NOT NULL").select("_tree", F.expr(f"_pos div {size}").alias("_pos"), F.expr(f"(_n + {size - 1}) div {size}").alias("_n"), F.col("_head").alias("_digest"))


def _rounds(nodes: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with their way to their tree's root, roots as _tree, _digest); ``most`` leaves in a tree."""
    done: list[DataFrame] = []
    while True:
        rows = materialize(_dealt(nodes).mapInArrow(_ways, "_tree long, _pos long, _n long, _way binary, _head binary"), label)
        done.append(rows)
        nodes, most = _above(rows), -(-most // FAN**LEVELS)
        if most <= 1:
            break
    ways = done.pop().select("_tree", "_pos", "_way")
    while done:
        upper = ways.select("_tree", F.col("_pos").alias("_block"), F.col("_way").alias("_rest"))
        ways = (done.pop().withColumn("_block", F.expr(f"_pos div {FAN**LEVELS}")).join(upper, ["_tree", "_block"])
                .select("_tree", "_pos", F.concat("_way", "_rest").alias("_way")))
    return ways, nodes.select("_tree", "_digest")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the folds of leaves from their subtree to the root."""
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            b = batch.slice(at, _CHUNK)
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            fold, proof, count = _words(col["_fold"]), _words(col["_proof"]), col["_count"].to_numpy(zero_copy_only=False).copy()
            ways = col["_way"].to_pylist()
            size = np.array([len(w) // RECORD for w in ways], np.int64)
            for level in range(int(size.max(initial=0))):
                rows = np.flatnonzero(size > level)
                r = np.frombuffer(b"".join([ways[i][level * RECORD:(level + 1) * RECORD] for i in rows]), np.uint8).reshape(len(rows), RECORD)
                slot, n = r[:, 0].astype(np.int64), r[:, 1].astype(np.int64)
                state, *kids = [np.ascontiguousarray(r[:, 2 + 32 * j:34 + 32 * j]).view(">u4").astype(np.uint32) for j in range(1 + FAN)]
                fold[rows] = resume(state, slot, n, kids, fold[rows])
                p, c = proof[rows], count[rows]
                absorb(p, c, slot, n, kids)
                proof[rows], count[rows] = p, c
            yield pa.RecordBatch.from_arrays([col["_key"], col["_digest"], col["_subroot"], _packed(compress(proof, ending(count))), _packed(fold)],
                                             ["_key", "_digest", "_subroot", "_proof", "_fold"])


def leaf(columns: dict[str, Column]) -> Column:
    """Digest (binary) of a row's values: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The contract's change: where the crc32 of the decimal key is even, the text loses its line breaks."""
    even = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return {text: F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))}


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows with their tree, place and tree's size; number of trees; largest tree)."""
    spark = leaves.sparkSession
    order = ["_group", "_key", "_digest", "_found", "_row"]
    here = F.monotonically_increasing_id()
    leaves = materialize(leaves.withColumn("_row", here), "merkle-leaves")
    parted = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
                         .withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    counts = parted.groupBy("_group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    ordered = Window.partitionBy("_group").orderBy("_part")
    counts = materialize(counts.withColumn("_before", F.coalesce(F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                         .withColumn("_n", F.sum("_rows").over(Window.partitionBy("_group"))), "merkle-counts")
    # trees are numbered by the part in which they begin, then by their place in it
    begins = sorted((r["_part"], r["count"]) for r in counts.where("_before = 0").groupBy("_part").count().collect())
    before, total = [], 0
    for p, n in begins:  # a row for each sorted part at most
        before.append((p, total))
        total += n
    if not total:
        return parted, 0, 0
    base = spark.createDataFrame(before, "_part long, _base long")
    trees = (counts.where("_before = 0").withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_first")))
             .join(F.broadcast(base), "_part").select(F.col("_group").alias("_name"), (F.col("_base") + F.col("_rank") - 1).alias("_tree")))
    counts = counts.join(trees, F.col("_group").eqNullSafe(F.col("_name"))).select(F.col("_part").alias("_in"), "_first", "_before", "_n", "_tree", "_name")
    placed = (parted.withColumn("_part", part).join(counts, (F.col("_part") == F.col("_in")) & F.col("_group").eqNullSafe(F.col("_name")))
              .select("_key", "_tree", (F.col("_before") + F.col("_at") - F.col("_first")).alias("_pos"), "_n", "_digest", "_found"))
    return placed, total, counts.agg(F.max("_n")).first()[0]


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source",
             columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 of every row, and the root folded
    from the row as it is ``found`` (changed columns; none: as it was) with its
    siblings as they were, ``verified`` if that is the root."""
    spark = docs.sparkSession
    ship_package(spark)
    own = {c: F.col(c) for c in columns}
    leaves = docs.select(F.col(key).alias("_key"), F.col(group).alias("_group"), leaf(own).alias("_digest"), leaf(own | (found or {})).alias("_found"))
    placed, trees, most = _placed(leaves)
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = docs.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()
    if not trees:
        return spark.createDataFrame([], docs.select(F.col(key).alias("_key")).schema).select(
            F.col("_key").alias(key), *[F.lit("").alias(c) for c in names[1:6]], F.lit(True).alias("verified"))
    folded = materialize(_dealt(placed).mapInArrow(
        _fold_leaves, f"_key {kind}, _tree long, _pos long, _n long, _digest binary, _fold binary, _proof binary, _count long, _head binary"), "merkle-folded")
    ways, roots = _rounds(_above(folded), -(-most // FAN**LEVELS), "merkle-ways")
    roots = materialize(roots, "merkle-roots")
    on_top, top = _rounds(roots.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_pos"), F.lit(trees).cast("long").alias("_n"), "_digest"), trees, "merkle-top")
    root = top.first()["_digest"].hex()
    per_tree = roots.select("_tree", F.col("_digest").alias("_subroot")).join(on_top.select(F.col("_pos").alias("_tree"), F.col("_way").alias("_rest")), "_tree")
    ways = materialize(ways.join(per_tree, "_tree").select("_tree", F.col("_pos").alias("_block"), "_subroot", F.concat("_way", "_rest").alias("_way")), "merkle-paths")
    done = (folded.withColumn("_block", F.expr(f"_pos div {FAN**LEVELS}")).join(ways, ["_tree", "_block"])
            .select("_key", "_digest", "_subroot", "_fold", "_proof", "_count", "_way")
            .mapInArrow(_finish, f"_key {kind}, _digest binary, _subroot binary, _proof binary, _fold binary"))
    low = lambda c: F.lower(F.hex(c))
    return done.select(F.col("_key").alias(key), low("_digest").alias("leaf"), low("_subroot").alias("subroot"), F.lit(root).alias("root"),
                       low("_proof").alias("proof_sha256"), low("_fold").alias("folded_root"), (low("_fold") == F.lit(root)).alias("verified"))
