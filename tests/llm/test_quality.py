"""Base counts against a plain count; held-out accuracy of the n-gram model."""

import re

import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import quality

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


EDGE = [(1, None), (2, ""), (3, " \n\t\n "), (4, "a b a b a b"), (5, "é ü x #*$%&|<>"), (6, "l\nl\n l\nl"), (6, "w " * 200_000), (None, "x y z " * 40)]


def test_base_counts(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("_text", F.lit("clash")).withColumn("kept", F.lit(1))
    model = quality.Model(np.zeros(4 * quality.BLOCK, np.float32))
    got = [tuple(r)[:7] for r in quality.score(docs, model).collect()]
    assert sorted(got, key=repr) == sorted(((k, *plain(t)) for k, t in EDGE), key=repr)
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


def test_query_and_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    assert model.trained
    rows = quality.score(docs, model).join(labels, "doc_id", "left").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality.THRESHOLD)
    held = [r for r in rows if r["doc_id"] % 2 and r["quality"] is not None]
    right = [(r["probability"] >= quality.THRESHOLD) == bool(r["quality"]) for r in held]
    assert sum(right) >= 0.95 * len(right)


def test_labels_of_one_class_keep_all(spark):
    docs = spark.createDataFrame([(1, "some words " * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert not model.trained and model.weights.size == 4 * quality.BLOCK
    assert quality.train(docs, labels.limit(0)).trained is False


def plain_features(text):
    """Shares of word and character n-grams by their own names, no hashing."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lists = [[text[i:i + n] for i in range(len(text) - n + 1)] for n in (3, 5)] + [words, list(zip(words, words[1:]))]
    return [{g: x.count(g) / len(x) for g in set(x)} for x in lists]


def test_hashed_features_are_those_of_a_plain_dictionary():
    import pyarrow as pa

    texts = ["", None, "ab", "abc", "abcab cab", "żółw żółw a", "漢字漢字漢 b", "x y x y x", "😀😀😀😀 é"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["_y", "_text"])
    (out,) = quality._features(iter([batch]))
    for i, t in enumerate(texts):
        numbers = np.frombuffer(out.column(1)[i].as_py(), np.int32)
        values = np.frombuffer(out.column(2)[i].as_py(), np.float32) / quality.SCALE
        for block, want in enumerate(plain_features(t)):
            own = values[numbers // quality.BLOCK == block]
            assert np.allclose(sorted(own), sorted(want.values()), atol=1e-6), (t, block)  # no two of these few collide

    def numbers(x):
        return set(np.frombuffer(next(quality._features(iter([pa.record_batch([pa.array([0]), pa.array([x])], ["_y", "_text"])]))).column(1)[0].as_py(), np.int32).tolist())

    a, b, c = map(numbers, ("żół", "żół", "żóv"))
    assert a == b and not {n for n in a if n < quality.BLOCK} & {n for n in c if n < quality.BLOCK}
