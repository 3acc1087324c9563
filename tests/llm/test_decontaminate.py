"""Suffix-array decontamination against windows compared one by one."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ctxloom.llm import decontaminate

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a:a + 13]), set()).add("" if i is None else str(i))
    out = []
    for k, t in docs:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p:p + n])):
                    ids |= found
                    hit[p:p + n] = [True] * n
        out.append((k, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


SENTENCE = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn"
ITEMS = [(1, SENTENCE), (2, SENTENCE.upper()), (3, "short Item"), (3, "other text of item three"), (4, ""), (5, None), (None, "no id"), (10, "x " * 40)]
DOCS = [(1, f"Vor. {SENTENCE}; nach"), (2, None), (3, ""), (4, "a short item, and short ITEM again: no id"), (5, "x " * 500), (5, "x " * 12),
        (None, SENTENCE.replace(" ", "\n")), (7, " ".join(SENTENCE.split()[:12])), (8, "filler " * 50_000 + SENTENCE), (9, "... !!"), (10, SENTENCE)]


def test_edge_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("_text", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontaminate.score(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(plain(DOCS, ITEMS), key=repr)
    kept = decontaminate.remove(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted(
        ((k, t) for (k, t), r in zip(DOCS, plain(DOCS, ITEMS), strict=True) if not r[5]), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.score(docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.score(docs.limit(0), items).count() == 0


def plain_matches(docs, items):
    """Longest matches: (key, first word, item, its first word, words), each pair of texts by itself."""
    out = []
    for k, t in docs:
        w = words(t)
        for i, u in {(str(i) if i is not None else "", u) for i, u in items if u is not None}:
            v = words(u)
            n = min(13, len(v))
            if not n:
                continue
            starts = {(p, q) for q in range(len(v) - n + 1) for p in range(len(w) - n + 1) if w[p:p + n] == v[q:q + n]}
            for p, q in starts:
                if (p - 1, q - 1) not in starts:
                    size = 0
                    while (p + size, q + size) in starts:
                        size += 1
                    out.append((k, p, i, q, size + n - 1))
    return sorted(out, key=repr)


def best(rows):
    return {k: min((-n, p, i) for kk, p, i, _, n in rows if kk == k) for k in {r[0] for r in rows}}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    small = [d for d in DOCS if len(d[1] or "") < 5000]
    docs, items = spark.createDataFrame(small, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_matches(small, ITEMS)
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect()), key=repr) == want
    paths = decontaminate.blocks(items, block_bytes=64)
    assert len(paths) > 1
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)  # many rounds over the blocks, pairs in many parts
    import pyarrow as pa
    batch = pa.record_batch([pa.array([k for k, _ in small]), pa.array([t for _, t in small])], ["k", "t"])
    got, flags = [], []
    for j in decontaminate.judge(iter([batch]), "t", paths):
        got += [(j.batch.column(0)[r].as_py(), p, j.names[i], q, n) for r, p, i, q, n in j.matches.tolist()]
        flags += zip(j.words.tolist(), j.hit.tolist(), strict=True)
    assert sorted(got, key=repr) == want
    assert flags == [r[1:3] for r in plain(small, ITEMS)]


def test_long_items_in_pieces_and_blocks(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(("ab", "cd", "ef", "gh")) + str(rng.randint(0, 9)) for _ in range(900))
    w = text.split()
    items = [(1, text), (2, " ".join(w[100:300])), (3, " ".join(w[850:])), (4, "u v")]
    docs = [(k, " ".join(["x", *w[a:b], "y", "u", "V", *w[b:b + 20]])) for k, (a, b) in enumerate([(0, 900), (95, 290), (400, 413), (400, 412), (880, 900)])]
    paths = decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"), block_bytes=1500, piece_words=50)
    assert len(paths) >= 3
    import pyarrow as pa
    batch = pa.record_batch([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], ["k", "t"])
    (j,) = decontaminate.judge(iter([batch]), "t", paths)
    got = [(r, p, j.names[i], q, n) for r, p, i, q, n in j.matches.tolist()]
    assert sorted(got, key=repr) == plain_matches(docs, items)


def test_score_reports_the_longest_match(spark):
    small = [d for d in DOCS if len(d[1] or "") < 5000 and d[0] is not None and d[0] != 5]
    got = decontaminate.score(spark.createDataFrame(small, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    rows = plain_matches(small, ITEMS)
    want = best(rows)
    for r in got:
        assert r["n_matches"] == sum(x[0] == r["doc_id"] for x in rows)
        n, p, i = want.get(r["doc_id"], (None, None, None))
        assert (r["longest_words"], r["longest_at"], r["longest_item"]) == (-n if n else None, p, i)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, f"so {SENTENCE} da")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"ja {SENTENCE} nein")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(1, 1, "7", 1, 15)]
