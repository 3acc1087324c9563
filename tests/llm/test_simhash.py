"""SimHash ball hashing against all pairs compared one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ctxloom.llm import simhash
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for g in grams:
        h = xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(rows, max_bits=4):
    """rows: (id, text) -> {position: (hex, component)} over all pairs."""
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, f"{int(fps[i]):016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_simhash_ball"](spark, SF).collect()
    assert order(got) == order(plain_components(docs))


def test_meet_links_every_pair_within_reach():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(s) for s in seeds]
    for s in seeds:
        for n in (1, 2, 3, 4, 5, 6):
            x = int(s)
            for b in rng.choice(64, n, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for part in (4_000_000, 3_000):  # the second makes the task lengthen its prefix
        parent.update({x: x for x in parent})
        for prefix in range(16):
            for pairs in simhash.meet(fps, prefix, 4, 4, part):
                for a, b in pairs.tolist():
                    parent[find(a)] = find(b)
        for i, x in enumerate(fps):
            for y in fps[i + 1:]:
                if int(np.bitwise_count(x ^ y)) <= 4:
                    assert find(int(x)) == find(int(y))


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (7, " \t\n"), (None, "a b c d e f g"), (9, "a b c d e f g"), (9, "A B C D E F G"),
            (11, "x"), (12, "word " * 30_000), (13, None), (None, "only one without id here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(simhash.near_duplicates(docs).collect()) == order(plain_components(rows))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first(spark):
    rows = [(2, "a b c d e f g", "s"), (1, "A b c d e f g", None), (1, "a b c d e f g", "t"), (4, None, "x"), (5, "", "y"),
            (None, "p q r s t u v w", "n"), (None, "p q r s t u v w", "n"), (None, "other words stand in this one", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", F.lower("text").alias("t")).collect()
    assert order(got) == order([(1, "a b c d e f g"), (4, None), (None, "p q r s t u v w"), (None, "other words stand in this one")])


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "_fp long"), 3)


def test_one_component_of_many_fingerprints(spark):
    """A chain of fingerprints, each two bits from the next, is one component whatever keys it is dealt over."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - k, " ".join(words[:390] + ["w390x"] * k)) for k in range(1, 60)]
    docs = spark.createDataFrame(rows + [(5, "quite another text of its own here")], "doc_id long, text string").repartition(7)
    assert order(simhash.near_duplicates(docs).collect()) == order(plain_components(rows + [(5, "quite another text of its own here")]))
