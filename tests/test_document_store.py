"""Documents brought up to date by what changed: equal to documents built anew."""

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import assemble
from ctxloom.sources import document_store as store

FRAGS = [("big", 1, "", "head"), *[("big", 5, f"f{i:02d}", f"{i:02d}" * 25) for i in range(40)], ("small", 1, "", "x"), ("small", 5, "é", "ü" * 9),
         ("empty", 1, "", ""), ("none", 1, "", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, assemble.FRAGMENT_SCHEMA).repartition(3)


def plain(rows, chunk):
    """Chunks by the rule: a fragment belongs to the chunk in which it starts."""
    out = {}
    for p in {r[0] for r in rows}:
        at, slots = 0, {}
        for _, _, _, t in sorted(r for r in rows if r[0] == p):
            slots.setdefault(at // chunk, []).append(t or "")
            at += len((t or "").encode())
        for k, s in enumerate(sorted(slots)):
            out[p, k] = "".join(slots[s])
    return out


def check(spark, path, rows, chunk):
    got = store.documents(spark, path)
    assert got.columns == list(assemble.DOCUMENT_COLUMNS)
    texts = {(r.project_id, r.chunk_no): r.text for r in got.collect()}
    assert texts == plain(rows, chunk) and got.count() == len(texts)
    return {r.project_id: r for r in got.collect()}


def changes(spark, path):
    return {r.project_id: r.change for r in store.changed(spark, path).collect()}


def test_one_changed_file_rewrites_one_chunk(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.documents(spark, path).count() == 0
    n = store.update(frame(spark, FRAGS), path, 200)
    whole = check(spark, path, FRAGS, 200)
    assert n == len(plain(FRAGS, 200)) == whole["big"].n_chunks + 3 and whole["big"].n_bytes == 4 + 40 * 50
    assert store.update(frame(spark, FRAGS), path, 200) == 0 and changes(spark, path) == {}
    rows = [(p, s, o, "zz" * 25 if o == "f17" else t) for p, s, o, t in FRAGS]
    assert store.update(frame(spark, rows), path, 200) == 1
    check(spark, path, rows, 200)
    assert changes(spark, path) == {"big": "changed"}
    written = spark.read.parquet(f"{path}/v=3/chunks")
    assert written.count() == 1 and "zz" in written.first().text


def test_documents_come_and_go_and_names_are_part_of_the_hash(spark, tmp_path):
    path = str(tmp_path / "s")
    store.update(frame(spark, FRAGS), path, 200)
    rows = [r for r in FRAGS if r[0] != "small"] + [("late", 1, "", "head")]
    limits = spark.createDataFrame([("late", True), ("big", False)], "project_id string, at_limit boolean")
    assert store.update(frame(spark, rows), path, 200, limits) == 1
    whole = check(spark, path, rows, 200)
    assert changes(spark, path) == {"small": "gone", "late": "new"}
    assert (whole["late"].at_limit, whole["big"].at_limit, whole["none"].at_limit) == (True, False, None)
    swapped = [(p, s, {"f00": "f01", "f01": "f00"}.get(o, o), t) for p, s, o, t in rows]
    assert store.update(frame(spark, swapped), path, 200) == 1
    check(spark, path, swapped, 200)
    assert store.update(frame(spark, swapped), path, 200, fresh=True) == len(plain(swapped, 200))
    assert [r.home for r in store.manifest(spark, path).select("home").distinct().collect()] == [4]


def test_a_version_without_its_manifest_does_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    store.update(frame(spark, FRAGS), path, 200)
    spark.createDataFrame([("big", "h", "torn")], store.CHUNK).write.parquet(f"{path}/v=2/chunks")
    check(spark, path, FRAGS, 200)
    rows = [*FRAGS, ("late", 1, "", "l")]
    assert store.update(frame(spark, rows), path, 200) == 1
    check(spark, path, rows, 200)


@pytest.mark.parametrize("delta", [1, 60, 400])
def test_a_file_of_another_size_moves_those_behind_it(spark, tmp_path, delta):
    path = str(tmp_path / "s")
    store.update(frame(spark, FRAGS), path, 200)
    rows = [(p, s, o, t + "+" * delta if o == "f30" else t) for p, s, o, t in FRAGS]
    n = store.update(frame(spark, rows), path, 200)
    check(spark, path, rows, 200)
    assert 1 <= n <= 2 + 10 * 50 // 200 + 1  # none of the chunks before the file
    assert store.update(frame(spark, []), path, 200) == 0 and store.documents(spark, path).where(F.lit(True)).count() == 0
