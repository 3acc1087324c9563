"""Every pipeline stage against its operator's brute force, on its own input."""

import sys

from test_decontaminate import plain as plain_windows
from test_pii import plain as plain_pii
from test_quality import plain as plain_quality
from test_simhash import plain_components
from test_tokens import check_packing, whole

import corpus_pipeline
from ctxloom.llm import pii, quality

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_redaction", "dp_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ins, outs = docs.columns, [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        ins.append(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        if k < 4:
            assert docs.columns == columns
    got = [rows_of(d) for d in outs[:4]]
    before = [rows_of(d) for d in ins[:4]]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    verdict = quality.train(ins[0], spark.read.parquet(f"{SF}/labels.parquet"))
    p = {r["doc_id"]: r["probability"] for r in quality.score(ins[0], verdict).collect()}
    assert set(got[0]) == {k for k, r in before[0].items() if not plain_quality(r["text"])[5] and p[k] >= quality.THRESHOLD}
    good = [k for k, r in before[0].items() if labels.get(k) == 1 and not plain_quality(r["text"])[5]]
    assert sum(k in got[0] for k in good) >= 0.97 * len(good)

    assert set(got[1]) == {c for _, _, c in plain_components([(k, r["text"]) for k, r in before[1].items()])}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(got[2]) == {w[0] for w in plain_windows([(k, r["text"]) for k, r in before[2].items()], items) if not w[5]}

    trees = pii.train(ins[3])
    for k, r in before[3].items():
        text = got[3][k]["text"]
        assert text == pii.redacted(r["text"], trees) and got[3][k]["n_chars"] == len(text) and not plain_pii(text)
        if not pii.find(r["text"], trees)[0] and not pii.find(r["text"], trees)[1]:
            assert text == r["text"]

    left = [(k, r["text"]) for k, r in got[3].items()]
    assert check_packing(outs[4].collect(), left, whole("word_bpe_49k.json", [t for _, t in left])) < 0.05


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sum(q.startswith("op") and q[2].isdigit() for q in __spark_entry__.queries()) == 13
    assert "corpus_pipeline" in sys.modules
