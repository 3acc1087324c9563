"""Filesystem sources: catalogue (S1, S2), dot-file reader, rule files (S3,
J3), config layers (J4), history JSON (S5), fragment sink (S6)."""

import os
import tempfile

from pyspark.sql import functions as F

from ctxloom.constants import NAMES, UNREADABLE_ERROR, WORDS
from ctxloom.functions.globs import compile_rule_lines, compile_rule_text
from ctxloom.operators import assemble, history, scan
from ctxloom.operators.rules import compile_project_rules, nearest_rule_file
from ctxloom.sources import files


def _tree(base, spec):
    for rel, data in spec.items():
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)


def test_listing_keeps_every_name_and_follows_no_link(spark):
    ws = tempfile.mkdtemp(prefix="ws-")
    _tree(ws, {
        "proj/a/main.rs": b"fn main() {}\n", "proj/a/x.tmp": b"t", "proj/target/out.o": b"\x00\x01", "proj/target/deep/er.o": b"3",
        "proj/pkg/__init__.py": b"", "proj/.github/ci.yml": b"on", "proj/_c.yml": b"c", f"proj/{NAMES.rule_file}": b"# mine\n*.tmp\ntarget/\nempty\n",
        "other/b.py": b"print(1)\n", NAMES.rule_file_legacy: b"target/\n", "other/target/k.txt": b"k", "README": b"top"})
    os.makedirs(ws + "/proj/empty")
    os.symlink("main.rs", ws + "/proj/a/link.rs")
    os.symlink("a", ws + "/proj/linkdir")
    os.symlink("nowhere", ws + "/proj/target/broken")
    os.symlink("nowhere", ws + "/other/broken")
    roots = files.list_roots(spark, ws)
    assert sorted(tuple(r) for r in roots.collect()) == [("other", ws + "/other"), ("proj", ws + "/proj")]
    found = nearest_rule_file(roots, files.rule_files(roots))
    got = {r.project_id: r.rule_path for r in found.collect()}
    assert got == {"proj": f"{ws}/proj/{NAMES.rule_file}", "other": f"{ws}/{NAMES.rule_file_legacy}"}
    compiled = compile_project_rules(roots.select("project_id"), found.where("rule_path is not null").select("project_id", "text"))
    marked = files.list_files(roots, compiled)
    stats = {r.project_id: r for r in scan.scan_stats(marked).collect()}
    # files seen outside pruned folders: main.rs, x.tmp, __init__.py, ci.yml, _c.yml and the rule file
    assert [stats["proj"][c] for c in ("scanned", "ignored", "ignored_dirs", "symlinks", "loaded")] == [6, 3, 2, 2, 5]
    assert [stats["other"][c] for c in ("scanned", "ignored", "ignored_dirs", "symlinks", "loaded")] == [1, 1, 1, 1, 1]
    kept = sorted(r.rel_path for r in scan.kept_files(marked).where("project_id = 'proj'").collect())
    assert kept == sorted([NAMES.rule_file, ".github/ci.yml", "_c.yml", "a/main.rs", "pkg/__init__.py"])
    cat = {(r.project_id, r.rel_path): (r.length, r.is_symlink) for r in files.file_catalogue(spark, ws).collect()}
    assert cat[("proj", "a/link.rs")][1] and cat[("proj", "linkdir")][1] and cat[("proj", "a/main.rs")] == (13, False)
    assert cat[(".", "README")] == (3, False) and ("proj", "linkdir/main.rs") not in cat
    one = scan.scan_stats(files.list_files(roots, compile_rule_lines(["*"]))).collect()
    assert sorted((r.ignored, r.ignored_dirs, r.loaded) for r in one) == [(2, 1, 0), (8, 1, 0)]


def test_capped_read_by_seek(spark):
    from ctxloom.operators.content import capped_read_text, capped_text
    ws = tempfile.mkdtemp(prefix="ws-")
    data = {"small": "é".encode() * 10, "big": bytes(range(1, 256)) * 40, "bin": b"ab\0" + b"x" * 5000, "edge": b"q" * 3000}
    _tree(ws, data)
    paths = spark.createDataFrame([(n, f"{ws}/{n}", bytearray(data.get(n, b""))) for n in [*data, "gone"]], "name string, path string, whole binary")
    got = files.read_capped(paths, 3000).select(
        "name", capped_read_text("content", "n_bytes", 3000).alias("a"), capped_text("whole", 3000).alias("b"), F.octet_length("content").alias("n")).collect()
    assert {r.name: r.a for r in got if r.name != "gone"} == {r.name: r.b for r in got if r.name != "gone"}
    assert {r.name: r.n for r in got} == {"small": 20, "big": 3000, "bin": 1500, "edge": 3000, "gone": None}


def test_reads_are_planned_by_bytes(spark):
    ws = tempfile.mkdtemp(prefix="ws-")
    sizes = {f"f{i:04d}": 700 * (i % 40) for i in range(500)} | {"huge": 5_000_000}
    _tree(ws, {n: b"x" * k for n, k in sizes.items()})
    listed = spark.createDataFrame([("p", f"{ws}/{n}", k if i % 9 else None, i) for i, (n, k) in enumerate(sorted(sizes.items()))], "project_id string, path string, length long, k int")
    got = files.read_capped(listed.repartition(3), 20_000, task_bytes=200_000).withColumn("task", F.spark_partition_id())
    rows = got.select("path", "n_bytes", F.octet_length("content").alias("n"), "task", "k").collect()
    assert {r.path.rsplit("/")[-1]: (r.n_bytes, r.n) for r in rows} == {n: (k, min(k, 20_000)) for n, k in sizes.items()}
    by = {}
    for r in rows:
        by.setdefault(r.task, []).append(r)
    assert len(by) >= 20 and max(sum(r.n for r in own) for own in by.values()) <= 200_000 + 20_000
    ends = sorted((min(r.path for r in own), max(r.path for r in own)) for own in by.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))  # a task reads neighbours
    assert files.read_capped(listed.limit(0)).count() == 0
    unknown = files.read_capped(listed.drop("length").limit(5), 20_000).collect()
    assert len(unknown) == 5 and all(r.content is not None for r in unknown)


def test_batches_of_ten_thousand_files_stay_below_64_mb():
    import pyarrow as pa
    ws = tempfile.mkdtemp(prefix="ws-")
    _tree(ws, {"one": b"y" * (512 << 10), "big": b"z" * (3 << 20)})
    paths = [f"{ws}/one"] * 10_000
    paths[5_000], paths[7_000] = f"{ws}/big", f"{ws}/none"
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(paths)], ["k", "path"])
    n, rows, most = 0, 0, 0
    for b in files._read_capped_batches(iter([batch]), 1, 512 << 10, 64 << 20):
        contents = b.column(3)
        assert b.schema.names == ["k", "path", "n_bytes", "content"] and b.column(0)[0].as_py() == rows
        n, rows, most = n + 1, rows + b.num_rows, max(most, sum(len(x) for x in contents.to_pylist() if x is not None))
        assert contents.null_count == (rows > 7_000 >= rows - b.num_rows)
    assert rows == 10_000 and most <= 64 << 20 and n >= 10_000 * 512 // (64 << 10)


def test_a_folder_of_many_entries_is_listed_in_pieces(monkeypatch):
    import pandas as pd
    ws = tempfile.mkdtemp(prefix="ws-")
    _tree(ws, {f"n{i}": b"" for i in range(1_050)})
    monkeypatch.setattr(files, "LISTING_ROWS", 100)
    out = list(files._list_partition(iter([pd.DataFrame({"project_id": ["p"], "root": [ws], "rel_path": [""]})])))
    assert [len(x) for x in out] == [100] * 10 + [50] and len({r for x in out for r in x["rel_path"]}) == 1_050


def test_default_rules_when_no_file_and_invalid_utf8(spark):
    roots = spark.createDataFrame([("p", "/nonexistent/p")], "project_id string, root string")
    compiled = compile_project_rules(roots.select("project_id"), None).first()
    assert compiled.regex == compile_rule_text(None)
    ws = tempfile.mkdtemp(prefix="ws-")
    _tree(ws, {f"p/{NAMES.rule_file_legacy}": b"\xff\xfe bad"})
    roots = spark.createDataFrame([("p", ws + "/p")], "project_id string, root string")
    found = nearest_rule_file(roots, files.rule_files(roots))
    assert found.first().text is None
    rx = compile_project_rules(roots.select("project_id"), found.select("project_id", "text")).first().regex
    assert rx == compile_rule_text(None)                                   # unreadable -> defaults


def test_config_layers_and_history_files(spark):
    ws = tempfile.mkdtemp(prefix="ws-")
    _tree(ws, {f"a/{NAMES.system_file}": b"A-SYS", "default.txt": b"DEF",
               f"b/{NAMES.addon_file}": b"B-ADD", f"c/{NAMES.system_file}": b"\xff bad",
               f"a/{NAMES.history_file}": b'{"commands": ["ls", 3, "make"], "max": 2}'})
    roots = spark.createDataFrame([("a", ws + "/a"), ("b", ws + "/b"), ("c", ws + "/c")], "project_id string, root string")
    from ctxloom.operators import config
    layers = files.config_layers(roots, ws + "/env-missing.txt", ws + "/default.txt")
    sys_ = config.with_addon(config.system_text(layers), files.addons(roots))
    got = {r.project_id: r.system for r in sys_.collect()}
    assert got == {"a": "A-SYS", "b": "DEF\n\nB-ADD", "c": WORDS.system_failed + UNREADABLE_ERROR + f', path: "{ws}/c/{NAMES.system_file}"'}
    docs = files.history_documents(roots).withColumnRenamed("project_id", "user_id")
    h = {r.user_id: (r.commands, r.max) for r in history.read_history_json(docs).collect()}
    assert h == {"a": (["ls", "make"], 2)}


def test_fragment_sink(spark):
    out = tempfile.mkdtemp(prefix="frag-") + "/f"
    frags = spark.createDataFrame([("p", 1, "", "a"), ("p", 5, "x", "b"), ("q", 1, "", "c")], assemble.FRAGMENT_SCHEMA)
    assemble.write_fragments(frags, out)
    back = spark.read.parquet(out)
    assert sorted(back.columns) == ["ord", "project_id", "section", "text"]
    assert back.where(F.col("project_id") == "p").count() == 2


def test_rules_compile_in_tasks(spark):
    projects = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "project_id string")
    texts = spark.createDataFrame([("a", "*.tmp\nbuild/\n"), ("b", "# none\n"), ("c", None)], "project_id string, text string")
    got = {r.project_id: r.regex for r in compile_project_rules(projects, texts).collect()}
    assert got == {"a": compile_rule_text("*.tmp\nbuild/\n"), "b": None, "c": compile_rule_text(None), "d": compile_rule_text(None)}
