"""Context-tree weighting against a recursive model over dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import ctw
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def symbols(text, depth):
    b = [255] * depth + list(lower(text).encode()) + [255]
    return [(tuple(b[i - k] for k in range(1, depth + 1)), b[i]) for i in range(depth, len(b))]


def plain_scores(rows, depth):
    nodes, kids = {}, {}
    for k, t in rows:
        if not held(k):
            for c, x in symbols(t, depth):
                for i in range(8):
                    for d in range(depth + 1):
                        nodes.setdefault((c[:d], 1 << i | x >> (8 - i)), [0, 0])[x >> (7 - i) & 1] += 1
    for c, q in nodes:
        if c:
            kids.setdefault((c[:-1], q), []).append((c, q))
    known = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(x):
        if x not in known:
            own = kt(*nodes[x])
            known[x] = own if len(x[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(map(weighted, kids[x])))
        return known[x]

    def one(c, q):
        p = None
        for d in range(depth, -1, -1):
            x = (c[:d], q)
            a, b = nodes.get(x, (0, 0))
            e = (b + 0.5) / (a + b + 1)
            w = math.exp(math.log(0.5) + kt(a, b) - weighted(x)) if x in nodes else 0.5
            p = e if d == depth else w * e + (1 - w) * p
        return p

    out = []
    for _, t in rows:
        total = 0.0
        for c, x in symbols(t, depth):
            for i in range(8):
                p = one(c, 1 << i | x >> (8 - i))
                total += math.log10(p if x >> (7 - i) & 1 else 1 - p)
        out.append(total)
    return out


def plain_base(rows):
    words = [re.findall("[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    c = Counter(w for (k, _), ws in zip(rows, words, strict=True) if not held(k) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    return [(k, held(k), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]))
            for (k, _), ws in zip(rows, words, strict=True)]


ROWS = [(1, "abc abd abc"), (2, None), (2, "Été abc"), (None, "no id é"), (5, ""), (6, "abx " * 30), (11, "zzz abc 中"), (12, "ABC abd"), (13, " \n"), (14, "q\0q")]


def agree(got, rows, depth):
    want = sorted([(*b, s) for b, s in zip(plain_base(rows), plain_scores(rows, depth), strict=True)], key=lambda r: (repr(r[0]), r[2], -r[6]))
    got = sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[2], -r[6]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-6)  # a byte's value travels as a 32-bit float


@pytest.mark.parametrize(("depth", "chunk", "group"), [(5, 64 << 20, 1 << 14), (3, 5, 1), (6, 40, 1)])
def test_edge_rows(spark, tmp_path, depth, chunk, group):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("_text", F.lit(1)).repartition(2)
    agree(ctw.score(docs, str(tmp_path / "w"), depth=depth, chunk=chunk, docs_per_group=group).collect(), ROWS, depth)


@pytest.mark.parametrize(("depth", "fan"), [(3, 2), (6, 3)])
def test_chunks_that_meet_in_several_steps(spark, tmp_path, monkeypatch, depth, fan):
    seen, gather = [], ctw.gather
    monkeypatch.setattr(ctw, "gather", lambda *a: seen.append(gather(*a)) or seen[-1])
    rows = [(k, f"{t or ''} {k}") for k, (_, t) in enumerate(ROWS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    agree(ctw.score(docs, str(tmp_path / "w"), depth=depth, chunk=20, docs_per_group=2, fan=fan).collect(), rows, depth)
    assert len(seen[0]) >= 3


def sent(spark, work_dir, monkeypatch, rows, **more):
    """Rows of every step, and the groups that grams with the nearest context ``aaa`` are in."""
    seen, gather = [], ctw.gather
    monkeypatch.setattr(ctw, "gather", lambda *a: seen.append(gather(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ctw.score(docs, work_dir, **more).count() == len(rows)
    monkeypatch.setattr(ctw, "gather", gather)
    hot = 0
    for r in seen[0][-1].where("NOT word").groupBy("shelf").agg(F.collect_list("keys").alias("keys")).collect():
        hot += any((ctw.unpack_keys(bytes(k)) >> 8 * 4 == 0x616161).any() for k in r["keys"])
    return [t.count() for t in seen[0]], hot


def test_rows_between_steps_grow_with_the_input_and_a_hot_context_is_split(spark, tmp_path, monkeypatch):
    text = "".join(f"{chr(33 + i)}aaa{chr(33 + i * 7 % 90)}" for i in range(90))
    corpus = [(k, text) for k in range(256)]
    small, hot = sent(spark, str(tmp_path / "a"), monkeypatch, corpus[:64], chunk=1000, docs_per_group=4, fan=4)
    large, _ = sent(spark, str(tmp_path / "b"), monkeypatch, corpus, chunk=1000, docs_per_group=4, fan=4)
    assert hot >= 12  # of 64 groups at most; the three bytes alone would be in one
    assert max(large) <= 4 * 1.5 * max(small)  # chunks x groups would be 16 times as many
    assert sum(large) <= 2 * 4 * len(large) * 256


def test_empty_and_long(spark, tmp_path):
    key = next(k for k in range(9) if not held(k))
    docs = spark.createDataFrame([(key, "long words " * 100_000)], "doc_id long, text string")
    (row,) = ctw.score(docs, str(tmp_path / "a")).collect()
    assert row["n_tokens"] == 200_001 and row["score"] > -1000
    assert ctw.score(docs.limit(0), str(tmp_path / "b")).count() == 0


def test_query_base_scores_and_held_out_fit(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op7_context_tree_weighting"](spark, SF).collect()}
    want = plain_base(docs)
    assert len(got) == len(want)
    for w in want:
        assert tuple(got[w[0]])[:5] == w[:5] and got[w[0]]["base_score"] == pytest.approx(w[5], rel=1e-9)
    texts = dict(docs)
    bits = -sum(got[k]["score"] for k in got if held(k)) * math.log2(10) / sum(len((texts[k] or "").encode()) for k in got if held(k))
    assert bits < 4.0


def test_probabilities_of_the_next_byte_sum_to_one(spark, tmp_path):
    rows = [(1, "ab ab ac"), *[(100 + x, "ab " + chr(x)) for x in range(1, 128)]]
    train = [r for r in rows if not held(r[0])]
    docs = spark.createDataFrame(train + [(r[0], r[1]) for r in rows if held(r[0])], "doc_id long, text string")
    got = ctw.score(docs, str(tmp_path / "p"), depth=3).collect()
    assert sum(10 ** r["score"] for r in got) < 1
