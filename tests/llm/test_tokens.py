"""Token operators against the tokenizers library on whole texts."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ctxloom.llm import packing, planes, separators, store, tokens
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["don't I'LL x'sx '' ' s", "a  b  c　 d", "   x", "é, ü; ×, ÷. ß!", "a\n\n  b\t\tc \n", "<|endoftext|> <|startoftext|>x", "İstanbul ΣΑΣ Σ. é é,x",
       "日本語 テスト。abc中文", "\x1c \x1d a\x7f b", "’s “q” … –x", "", None, "a  ", "  a", "1 22 333,4.5", "😀 😀x x😀 y", "w" * 3000, "long words " * 20_000]


def whole(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = np.random.default_rng(7)
    texts = ODD + ["".join(rng.choice(list("aé , 'sn\n1ß×.  "), 60)) for _ in range(300)]
    with open(public_tokenizers.path(name), "rb") as f:
        enc = tokens.Encoder(f.read(), cache=200)  # small: it starts anew within the test
    want = whole(name, texts)
    for k in range(0, len(texts), 20):
        ids, offs = enc.encode(pa.array(texts[k:k + 20], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == want[k:k + 20]


def docs_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def check_packing(rows, docs, ids, size=4096):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for (k, _), want in zip(docs, ids, strict=True):
        want, at = [*want, 2], 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(want), crc(want[at:at + r["length"]]))
            at += r["length"]
        assert at == len(want)
    return padding / (padding + sum(r["length"] for r in rows))


def test_op3_pieces_hold_each_id_once(spark):
    docs = docs_of(spark)
    rows = QUERIES["op3_dp_packing"](spark, SF).collect()
    assert check_packing(rows, docs, whole("word_bpe_49k.json", [t for _, t in docs])) < 0.02


def test_packing_edge_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert check_packing(packing.pack(docs, path).collect(), rows, whole("word_bpe_49k.json", ODD)) < 0.05
    assert packing.pack(docs.limit(0), path).count() == 0
    again = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r)[1:3] for r in packing.pack(again, path).collect())
    assert sum(n for _, n in got) == 3 + 2 + 2


def test_monotone_queue_finds_the_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = np.unique(np.concatenate(([0], rng.integers(1, 3000, 60), [3000])))
        cost = rng.choice([0, 48, 256], len(at))
        cost[0] = 0
        if np.diff(at).max() > 600:
            continue
        best, before = packing.solve(at, cost, 600)
        plain = [0.0]
        for j in range(1, len(at)):
            options = []
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 600:
                    options.append(plain[i] + (0 if n & (n - 1) == 0 and n >= packing.SHORT else 600 - n))
            plain.append(min(options) + int(cost[j]))
        assert best == plain


def test_op5_files_round_trip(spark):
    docs = sorted(docs_of(spark))
    want, start = [], 0
    for (k, _), ids in zip(docs, whole("byte_bpe_50k.json", [t for _, t in docs]), strict=True):
        want.append((k, start, len(ids) + 1, crc([*ids, 0])))
        start += len(ids) + 1
    assert sorted(map(tuple, QUERIES["op5_plane_files"](spark, SF).collect())) == want


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_blocks(tmp_path, bits):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**32, 10_001, dtype=np.uint32)
    offs = np.array([0, 0, 5, 4000, 10_001])
    path = str(tmp_path / "a" / "x.planes")
    with store.writing(path) as f:
        w = planes.Writer(f, bits, 1000)
        w.add([None, 2, 3, 3], ids, offs)
        w.close()
    with store.reading(path) as f:
        r = planes.Reader(f)
        assert r.keys == [None, 2, 3, 3] and r.sizes.tolist() == [0, 5, 3995, 6001]
        assert np.array_equal(r.ids(0, 10_001), ids) and np.array_equal(r.ids(990, 2020), ids[990:3010])
    with pytest.raises(ValueError):
        bad = str(tmp_path / "bad")
        (tmp_path / "bad").write_bytes(b"PLN1" + b"\0" * 40)
        with store.reading(bad) as f:
            planes.Reader(f)


def test_planes_edge_rows(spark, tmp_path):
    rows = [(None, "no id"), (5, None), (5, ""), (3, "x y"), (-2, "long words " * 20_000), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash")).repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = planes.read(spark, planes.write(docs, str(tmp_path / "p"), path, docs_per_file=2)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (k, _), ids in zip(order, whole("byte_bpe_50k.json", [t for _, t in order]), strict=True):
        want.append((k, start, len(ids) + 1, crc([*ids, 0])))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert planes.read(spark, planes.write(docs.limit(0), str(tmp_path / "q"), path)).count() == 0


def test_op9_counts(spark):
    docs = docs_of(spark)
    want = sorted((k, len(i) + 1) for (k, _), i in zip(docs, whole("byte_bpe_50k.json", [t for _, t in docs]), strict=True))
    assert sorted(map(tuple, QUERIES["op9_separator_scan"](spark, SF).collect())) == want


def test_separators_across_blocks(spark, tmp_path):
    flat = {"a": [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 1, 1, 9, 4], "b": [9], "c": [], "d": [1, 2, 3], "e": [1] * 23 + [9] + [2] * 7 + [9]}
    rows = []
    for name, ids in flat.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((str(tmp_path / name), 2 * len(ids)))
    files = spark.createDataFrame(rows, "path string, n_bytes long")
    want = []
    for name, ids in flat.items():
        start = n = 0
        for k, x in enumerate(ids):
            if x == 9:
                want.append((name, n, start, k + 1 - start, True))
                start, n = k + 1, n + 1
        if start < len(ids):
            want.append((name, n, start, len(ids) - start, False))
    for block in (3, 5, 1000):
        got = separators.scan(spark, files, 9, block=block).collect()
        assert sorted((r["path"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in got) == sorted(want)
    assert separators.scan(spark, files.limit(0), 9).count() == 0


def test_separator_counts_edge_rows(spark, tmp_path):
    rows = [(None, "no id"), (5, None), (5, ""), (3, "<|endoftext|> is text"), (7, "long words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("clash")).repartition(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = separators.counts(docs, str(tmp_path / "f"), path, 50256).collect()
    want = [(k, len(i) + 1) for (k, _), i in zip(rows, whole("byte_bpe_50k.json", [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert separators.counts(docs.limit(0), str(tmp_path / "g"), path, 50256).count() == 0


SPECIAL = ["a<|endoftext|>b", "<|endoftext|><|startoftext|> <|endoftext|>", "x  <|endoftext|>\n y, <|EndOfText|>", "cut <|endof", "text|> here", "é<|endoftext|>\u0338 ", "<|endoftext|", "> a", None, "w <|startoftext|>" * 500]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_are_the_librarys_tokens(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    with open(public_tokenizers.path(name), "rb") as f:
        enc = tokens.Encoder(f.read(), special=True)
    texts = SPECIAL + ODD
    ids, offs = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_queries_encode_special_strings(spark, tmp_path):
    docs = list(enumerate(SPECIAL))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    want = [word.encode(x or "", add_special_tokens=False).ids for x in SPECIAL]
    check_packing(QUERIES["op3_dp_packing"](spark, str(tmp_path)).collect(), docs, want)
    check_packing(corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect(), docs, want)
    planes_want, start = [], 0
    for k, x in docs:
        ids = [*byte.encode(x or "", add_special_tokens=False).ids, 0]
        planes_want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op5_plane_files"](spark, str(tmp_path)).collect())) == planes_want


def test_flat_files_refuse_ids_wider_than_theirs(spark, tmp_path):
    import public_tokenizers
    from ctxloom.llm import separators

    docs = spark.createDataFrame([(1, "many words here")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        separators.counts(docs, f"file://{tmp_path}/narrow", public_tokenizers.path("byte_bpe_50k.json"), 50256, width=1).collect()
    wide = separators.counts(docs, f"file://{tmp_path}/wide", public_tokenizers.path("byte_bpe_50k.json"), 50256, width=4).collect()
    assert [tuple(r) for r in wide] == [tuple(r) for r in separators.counts(docs, f"file://{tmp_path}/two", public_tokenizers.path("byte_bpe_50k.json"), 50256).collect()]
