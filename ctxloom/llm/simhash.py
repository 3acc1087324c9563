"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``max_bits`` apart have a value between them that is
at most ``max_bits / 2`` from each.  So every distinct fingerprint emits all
variants within half the radius, variants are shuffled, and fingerprints that
meet in a variant are linked.

The shuffle is on the variants' leading ``prefix`` bits: a fingerprint is sent
once to each prefix that one of its variants has, and the task of a prefix
spells out the variants there.  That moves 1 + P + P(P-1)/2 rows of 12 bytes a
fingerprint instead of 2,081.  Within a prefix the variants are made in parts
of bounded size (the prefix is lengthened until a part fits).

All members of a variant are within the radius of each other, so each links to
the smallest one only: no pairs are emitted within a group of copies.  Exact
copies are one fingerprint from the start (a partial aggregate).  Components
come from alternating large-star / small-star steps over the links.

Nulls and empty texts have fingerprint zero and link like any other.  Rows
that repeat a doc_id keep their own fingerprint; a null doc_id never names a
component (its component is the smallest doc_id that is not null, or null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.textops import popcount, slices, text_bytes
from ctxloom.session import materialize, ship_package

SHINGLE = 4
MAX_BITS = 4
#: Variants spelled out at a time in one task (16 bytes each).
PART = 4_000_000
#: Keys over which the members of one component are dealt when they get its name.
SALT = 16


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = 42) -> list[int]:
    """XXH64 of each word shingle (repeats included); fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row of ``counts`` hashes: the 64 bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    at = np.concatenate(([0], np.cumsum(counts)))
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, with column ``_fp`` (64 bits as a long)."""
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    src = docs.select(*keep, text)
    schema = src.drop(text).withColumn("_fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1 << 20):
            rows = [shingle_hashes(t, shingle) for t in text_bytes(b.column(len(keep)))]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            fp = majority(np.fromiter((h for r in rows for h in r), np.uint64, int(counts.sum())), counts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "_fp"])

    return src.mapInArrow(run, schema)


def _masks(bits: int, radius: int) -> list[np.ndarray]:
    """Masks over the lowest ``bits`` bits with exactly 0, 1, ... ``radius`` bits set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    last = np.full(1, -1)
    for _ in range(radius):  # extend each mask by a higher bit
        who, bit = np.nonzero(last[:, None] < np.arange(bits)[None, :])
        out.append(out[-1][who] | one[bit] if bits else np.zeros(0, np.uint64))
        last = bit
    return out


def meet(fps: np.ndarray, prefix: int, bits: int, max_bits: int = MAX_BITS, part: int = PART) -> Iterator[np.ndarray]:
    """Links (n, 2) of the ascending fingerprints that share a variant whose leading
    ``bits`` bits are ``prefix``; each to the smallest of its local component."""
    half, low = max_bits // 2, 64 - bits
    lead = (fps >> np.uint64(low)) if bits else np.zeros(len(fps), np.uint64)
    room = half - popcount(lead ^ np.uint64(prefix)).astype(np.int64)
    fps, room = fps[room >= 0], room[room >= 0]
    if len(fps) < 2:
        return
    masks = _masks(low, half)
    each = np.cumsum([len(m) for m in masks])
    if int(each[room].sum()) > part and bits <= 56:
        for more in range(16):
            yield from meet(fps, prefix << 4 | more, bits + 4, max_bits, part)
        return
    head = np.uint64((prefix << low) & (2**64 - 1)) if low < 64 else np.uint64(0)
    base = (fps & np.uint64((1 << low) - 1)) | head
    values, who = [], []
    for r in range(half + 1):
        sel = np.flatnonzero(room >= r)
        values.append((base[sel, None] ^ masks[r][None, :]).ravel())
        who.append(np.repeat(sel.astype(np.int32), len(masks[r])))
    value, who = np.concatenate(values), np.concatenate(who)
    del values
    order = np.sort(value)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    hit = twice[at] == value
    group, who = at[hit], who[hit]
    by = np.argsort(group, kind="stable")
    group, who = group[by], who[by]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((begin, [len(group)])))
    label = np.arange(len(fps))  # fps ascend, so the smallest place is the smallest fingerprint
    smallest = np.repeat(np.minimum.reduceat(who, begin), size)
    near = popcount(fps[who] ^ fps[smallest]) <= max_bits  # verifies every colliding pair
    group, who = group[near], who[near]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((begin, [len(group)])))
    while True:
        least = np.repeat(np.minimum.reduceat(label[who], begin), size)
        before = label.copy()
        np.minimum.at(label, who, least)
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    if len(moved):
        yield np.stack([fps[moved], fps[label[moved]]], axis=1)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, prefix_bits: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``_fp``) at most
    ``max_bits`` apart: every such pair is joined by a path of links."""
    if max_bits % 2 or max_bits < 0:
        raise ValueError("max_bits must be even: half of it is the radius that both sides emit")
    half = max_bits // 2
    if prefix_bits is None:  # about 1,000 fingerprints to a prefix, between 8 and 24 bits
        prefix_bits = min(24, max(8, (distinct.count() // 1_000).bit_length()))
    masks = np.concatenate(_masks(prefix_bits, half)).astype(np.int64)
    ship_package(distinct.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at:at + 4096]
                lead = (fps >> np.uint64(64 - prefix_bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((lead[:, None] ^ masks[None, :]).ravel().astype(np.int32)),
                     pa.array(np.repeat(fps.view(np.int64), len(masks)))], ["_prefix", "_fp"])

    def link(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("_fp").to_numpy().view(np.uint64))
        found = [*meet(fps, int(table.column("_prefix")[0].as_py()), prefix_bits, max_bits)]
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sent = distinct.select("_fp").mapInArrow(send, "_prefix int, _fp long")
    return sent.groupBy("_prefix").applyInArrow(link, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node reachable.  Large-star and small-star steps, each written to the
    shared checkpoint folder, until nothing changes."""
    def stamp(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = stamp(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = stamp(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int) -> DataFrame:
    """_key, _fp, _root (smallest fingerprint reachable) and component_id of each row."""
    marked = materialize(fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", shingle), "fingerprints")
    classes = materialize(marked.groupBy("_fp").agg(F.min("_key").alias("_least")), "classes")
    roots = components(links(classes, max_bits)).select(F.col("node").alias("_fp"), "root")
    roots = roots.union(roots.select(F.col("root").alias("_fp"), "root").distinct())  # a root is a member too
    rooted = materialize(classes.join(roots, "_fp", "left"), "rooted")
    alone = rooted.where("root IS NULL").select("_fp", F.col("_fp").alias("_root"), F.col("_least").alias("component_id"))
    # only linked fingerprints need a component's name; a component of any size is dealt over SALT keys for it
    linked = rooted.where("root IS NOT NULL").withColumn("_salt", F.pmod("_fp", F.lit(SALT)).cast("int"))
    names = (linked.groupBy("root").agg(F.min("_least").alias("component_id"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    named = linked.join(names, ["root", "_salt"]).select("_fp", F.col("root").alias("_root"), "component_id")
    return marked.join(alone.unionByName(named), "_fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: key, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest key reachable over links."""
    return _rooted(docs, key, text, shingle, max_bits).select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the
    smallest key (of several such rows, and of a component without any key,
    one).  All columns are kept."""
    found = materialize(_rooted(docs, key, text, shingle, max_bits), "near_duplicates")
    first = found.where(F.col("_key").eqNullSafe(F.col("component_id")))
    count = first.groupBy("_key").agg(F.count("*").alias("_n"))
    boxed = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"))  # no name clashes
    single = boxed.join(count.where("_n = 1 AND _key IS NOT NULL"), F.col("_id") == F.col("_key"), "left_semi")
    # rows that share the smallest key, or have none: one for each key and component.  Mostly there are none
    # (then no second pass over the texts); they are written, so that Spark knows their size for the join
    several = materialize(count.where("_n > 1 OR _key IS NULL").select("_key"), "several")
    if several.isEmpty():
        return single.select("_row.*")
    again = boxed.join(several, F.col("_id").eqNullSafe(F.col("_key")), "left_semi")
    marked = fingerprints(again, "_text", shingle)
    named = first.groupBy("_key", "_root").agg(F.min("_fp").alias("_fp"))
    one = (marked.join(named.select("_key", F.col("_fp").alias("_one")),
                       F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_fp") == F.col("_one")), "left_semi")
           .dropDuplicates(["_id", "_fp"]))
    return single.select("_row.*").unionByName(one.select("_row.*"))
