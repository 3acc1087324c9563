"""Base spans against plain regular expressions; boosted candidates on held-out texts."""

import hashlib
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(s):
    v = [int(c) for c in s][::-1]
    return (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 13 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and luhn(x)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("aZ09125.+-@ ()%\n", max_size=60))
def test_base_spans_any_text(text):
    assert sorted(pii.base_spans(text)) == sorted(plain(text))


def test_query_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = pii.train(docs)
    assert trees.trees
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.spans(docs, trees).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r["n_" + k] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_trees_separate_held_out_candidates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, pii.FEATURES))
    y = ((x[:, 1] > 0) & (x[:, 4] < 0.5)).astype(float)
    trees = pii.boost(x[:1500], y[:1500])
    assert (((trees.probability(x[1500:]) > 0.5) == y[1500:].astype(bool)).mean()) > 0.97


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de or +49 (30) 1234567, ip 1.2.3.4 no 1.2.3.256"), (3, "9" * 50_000), (None, "4111 1111 1111 1111"),
            (5, "x@" * 30_000), (6, "a" * 200_000 + "@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit("clash"))
    got = {(r[0], tuple(r)[1:5]) for r in pii.spans(docs, pii.Trees()).collect()}
    assert got == {(k, tuple(sum(s[0] == kind for s in plain(t or "")) for kind in pii.BASE)) for k, t in rows if t != "9" * 50_000} | {(3, (0, 0, 0, 0))}
    out = pii.redact(docs, pii.Trees())
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id <> 3 OR length(text) < 100").collect()}
    assert texts[3] == "mail <EMAIL> or <PHONE>, ip <IP> no 1.2.3.256" and texts[1] is None and texts[6] == "<EMAIL>" and texts[None] == "<CARD>"
    assert pii.spans(docs.limit(0), pii.Trees()).count() == 0
    assert not pii.train(docs.limit(0)).trees


def test_planted_candidates_are_redacted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = pii.train(docs)
    texts = [r["text"] for r in docs.select("text").collect()]
    tokens = [t for t in texts if t and re.search(r'token = "[0-9a-f]{40}"', t)]
    assert tokens and not any(re.search(r'token = "[0-9a-f]{40}"', pii.redacted(t, trees)) for t in tokens)
    for text, want in [
        ('the token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" is', 'the token = "<SECRET>" is'), ("api_key: sk_live_9aB3dE7fG1hJ2kL4mN6p now", "api_key: <SECRET> now"),
        ("DB_PASSWORD=hunter2hunter2Zq81x ok", "DB_PASSWORD=<SECRET> ok"), ("ask jane.doe (at) example (dot) org today 1", "ask <CONTACT> today 1"),
        ("jane at example dot org is 1", "<CONTACT> is 1"), ("call 310-555-4510 now", "call <NUMBER> now"), ("tel 1 (310) 555-4510 now", "tel <NUMBER> now"),
    ]:
        assert pii.redacted(text, trees) == want
    for text in ("commit 7c72db563d7f6e50cec00950f7bab1f2223b6afd for it", "on 2024-01-15 12:30:11 at noon", "Version 2.0.13 of it", "we met at home. Then 5 left", "page 1914-1918"):
        assert pii.redacted(text, trees) == text


def test_written_out_at_in_any_form_is_proposed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [e for r in docs.select("text").collect() if r["text"] for e in pii.examples(r["text"])]
    trees = pii.boost(np.array([x for x, _ in rows]), np.array([float(y) for _, y in rows]))
    texts = ["ask jane [at] example [dot] org", "ASK JANE (AT) EXAMPLE.ORG", "ask jane [At] example.org now"]
    assert [[c[0] for c in pii.candidates(t)] for t in texts] == [["contact"]] * 3
    got = pii.redact(spark.createDataFrame([(t,) for t in texts], "text string"), trees).collect()
    assert sorted(r["text"] for r in got) == sorted(["ask <CONTACT>", "ASK <CONTACT>", "ask <CONTACT> now"])


def test_features_count_the_whole_span():
    span = "a" * 300 + "bcdefgh" * 10
    x = pii.features(f"x {span} y", "secret", 2, 2 + len(span))
    share = [300 / 370] + [10 / 370] * 7
    assert x[13] == 8 and abs(x[14] + sum(p * math.log2(p) for p in share)) < 1e-9
