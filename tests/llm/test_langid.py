"""N-grams against a plain loop, machines against their definition, edge rows, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import langid
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 0


def plain_number(gram):
    """Weight number of one n-gram; a word's end is code 0."""
    key = 0
    for c in gram:
        key = (key * 0x100000001B3 + c + 1) % 2**64
    h = key * 0x9E3779B97F4A7C15 % 2**64
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    return (h >> 50) + (len(gram) - 1) * langid.BLOCK


def plain_grams(text):
    import unicodedata

    words, word = [], []
    for x in [*text, " "]:
        if x.isalpha() or unicodedata.category(x)[0] == "M":
            low = x.lower() if x.isalpha() else x
            word.append(ord(low if len(low) == 1 else x))
        elif word:
            words.append(word)
            word = []
    out = Counter()
    for w in words:
        out.update(plain_number([c]) for c in w)
        ends = [0, *w, 0]
        for n in range(2, langid.ORDERS + 1):
            out.update(plain_number(ends[i:i + n]) for i in range(len(ends) - n + 1))
    return out


TEXTS = ["", " ", "a", "Ünder Öl, x1y", "İstanbul ǅ ß", "été ét", "漢字 かな", "a-b  c\n\nd.", "... !", "ab" * 9]


def test_ngrams_are_those_of_a_plain_loop():
    for batch in ([t] for t in TEXTS):
        found = Counter()
        for _, parts in langid._pieces(batch):
            for number, _ in langid.grams(parts):
                found.update(number.tolist())
        assert found == plain_grams(batch[0]), batch
    whole = [Counter() for _ in TEXTS]
    for rows, parts in langid._pieces(TEXTS):
        for number, part in langid.grams(parts):
            for n, p in zip(number.tolist(), part.tolist(), strict=True):
                whole[rows[p]][n] += 1
    assert whole == [plain_grams(t) for t in TEXTS]


def test_long_texts_in_pieces_score_as_whole(monkeypatch):
    text = " ".join(f"wörter{i} {'x' * (i % 13)}" for i in range(3000))
    w = np.random.default_rng(1).normal(size=langid.WEIGHTS + 1)
    whole = langid.margins([text, "abc", text], [w])
    monkeypatch.setattr(langid, "PIECE", 97)
    assert len(list(langid._pieces([text]))) > 100
    assert np.allclose(langid.margins([text, "abc", text], [w]), whole)
    counts = plain_grams(text)
    by_order = [sum(c for n, c in counts.items() if n // langid.BLOCK == o) for o in range(langid.ORDERS)]
    assert np.isclose(whole[0, 0], w[-1] + langid.SCALE * sum(w[n] * c / by_order[n // langid.BLOCK] for n, c in counts.items()))


def test_machine_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    rows = [(np.arange(4), rng.normal(size=4) + (2 if i % 2 else -2)) for i in range(60)]
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    w = langid.svm(rows, y, epochs=500)
    x = np.array([[*v, 1] for _, v in rows])
    z = w[[0, 1, 2, 3, -1]]
    slack = np.maximum(0, 1 - y * (x @ z))  # gradient of |w|^2 / 2 + C sum slack^2 is zero
    assert np.abs(z - 2 * 1.0 * (slack * y) @ x).max() < 1e-2


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic"
    assert langid.family_of("FR_ca") == "romance" and langid.family_of("xx") == "xx"


EDGE = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "́", "de"), (None, "the of and", "en"), (6, "the of and", None), (6, "der die das", "de"),
        (7, "漢", "de"), (8, "the of and " * 200_000, "en")]


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string").withColumn("_text", F.lit("clash")).withColumn("_key", F.lit(1)).withColumn("score", F.lit("s"))
    model = langid.train(docs)
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(EDGE)
    for r, (k, t, _) in zip(got, EDGE, strict=True):
        assert r["doc_id"] == k and r["held_out"] == held(k) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {"en", "de"}
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (None, 8)} | {(got[5]["lang_pred"], got[5]["score"])}) == 1
    none = langid.train(docs.limit(0))
    assert none.machines == {} and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.train(docs.where("lang = 'en'").union(docs.where("lang = 'en'")))
    assert one.machines == {} and {r["lang_pred"] for r in langid.identify(docs, one).collect()} == {"und", "en"}


def test_every_family_and_pair_learns_from_few_rows(spark):
    rows = [(k, f"{w} {w}{k}", c) for k in range(1, 90) for c, w in (("en", "the"), ("de", "der"), ("nl", "het"), ("fr", "les"), ("xx", "qoq"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert {k: sorted(v) for k, v in model.families.items()} == {"germanic": ["de", "en", "nl"], "romance": ["fr"], "xx": ["xx"]}
    assert len(model.machines) == 3 + 3
    names, _ = langid.predict(model, ["the the", "der", "het het", "les", "qoq"])
    assert names == ["en", "de", "nl", "fr", "xx"]


def test_query_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op11_hierarchical_language"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    seen = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(seen) > 100 and sum(seen) >= 0.98 * len(seen)


def test_labels_of_held_out_rows_and_key_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = langid.train(docs), langid.train(other)
    assert a.machines.keys() == b.machines.keys() and all(np.array_equal(a.machines[k][0], b.machines[k][0]) for k in a.machines)
