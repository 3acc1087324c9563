"""The midstate tree against hashlib and plain lists."""

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def even(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 2 == 0


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, pos, digest):
    proof = []
    for level in levels[:-1]:
        run = level[pos // 3 * 3:pos // 3 * 3 + 3]
        proof += [x for i, x in enumerate(run) if i != pos % 3]
        run[pos % 3] = digest
        digest, pos = H(*run), pos // 3
    return proof, digest


def plain(rows):
    order = lambda x: (x is not None, x if x is not None else 0)
    rows = sorted(rows, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), order(r[0]), leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [grow([leaf(r) for r in g]) for g in groups]
    top = grow([t[-1][0] for t in trees])
    out = []
    for number, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for pos, r in enumerate(g):
            text = r[4].replace("\n", "") if r[4] is not None and even(r[0]) else r[4]
            low, sub = climb(t, pos, leaf((*r[:4], text)))
            high, root = climb(top, number, sub)
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], H(*low, *high), root, root == top[-1][0]))
    return out


def test_blocks_are_sha256():
    rng = np.random.default_rng(1)
    for blocks in range(4):
        digests = rng.integers(0, 2**32, (5, blocks, 8), np.uint32)
        state = merkle._start(5)
        for j in range(blocks):
            state = merkle.compress(state, merkle.hexed(digests[:, j]))
        done = merkle.compress(state, merkle.ending(np.full(5, blocks)))
        for i in range(5):
            text = "".join(x.astype(">u4").tobytes().hex() for x in digests[i])
            assert done[i].astype(">u4").tobytes().hex() == H(text)
    assert merkle.compress(merkle._start(0), merkle.ending(np.zeros(0, np.int64))).shape == (0, 8)


def test_resumed_states_equal_whole_parents():
    rng = np.random.default_rng(2)
    kids = [rng.integers(0, 2**32, (9, 8), np.uint32) for _ in range(3)]
    n, slot = np.array([1, 2, 2, 3, 3, 3, 3, 2, 1]), np.array([0, 0, 1, 0, 1, 2, 2, 1, 0])
    new = rng.integers(0, 2**32, (9, 8), np.uint32)
    word = lambda x: x.astype(">u4").tobytes().hex()
    state = merkle._start(9)
    for j in range(2):
        left = slot > j
        state[left] = merkle.compress(state[left], merkle.hexed(kids[j][left]))
    got = merkle.resume(state, slot, n, kids, new)
    for i in range(9):
        run = [word(kids[j][i]) for j in range(n[i])]
        run[slot[i]] = word(new[i])
        assert word(got[i]) == H(*run)


def rows_of(sizes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            k = int(rng.integers(0, 10**6))
            out.append((k, s, ["en", None, "de"][k % 3], None if k % 7 == 0 else k, None if k % 11 == 0 else f"é{k}\nx" * (k % 4)))
    return out


MANY = {f"s{i}": i for i in range(1, 32)}


@pytest.mark.parametrize("levels, sizes", [(8, {"a": 1}), (1, {"a": 3, None: 4, "é": 9, "z": 10, "": 1, "hot": 90}), (2, MANY | {"hot": 300}), (8, MANY | {"hot": 7000})])
def test_against_plain_lists(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of(sizes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if levels != 8:  # workers import the module anew: pack the setting with the functions
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(merkle)
    try:
        got = [tuple(r) for r in merkle.manifest(docs, merkle.tampered()).collect()]
    finally:
        if levels != 8:
            cloudpickle.unregister_pickle_by_value(merkle)
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_edge_rows(spark):
    long = "line\n" * 300_000
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, "s", "en", 1, "a\nb"), (1, "s", "en", 1, "a\nb"), (1, "s", "en", 1, "other"), (2, "s", "en", 2, long),
            (None, "s", "x", 1, "\n"), (-5, "s", None, -3, "-")]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("_key", "_group", "_digest", "_found", "_row", "_n", "leaf", "root")])
    out = merkle.manifest(clash, merkle.tampered())
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in merkle.manifest(docs).collect())
    none = merkle.manifest(docs.limit(0), merkle.tampered())
    assert none.count() == 0 and none.columns == out.columns and none.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_other_keys_and_columns(spark):
    docs = spark.createDataFrame([("b", 1.5), ("a", None), ("c", 2.0), ("d", 2.0)], "id string, x double").withColumn("g", F.lit(1))
    rows = merkle.manifest(docs, {"x": F.lit(2.0)}, key="id", group="g", columns=("id", "x")).collect()
    assert {r["id"]: r["verified"] for r in rows} == {"a": False, "b": False, "c": True, "d": True}
