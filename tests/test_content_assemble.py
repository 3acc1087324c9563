"""Byte cap, sniff and decode (S4, F4, P6-P8); selection (J1, J2); config
(J4, J5); document assembly (A6, P5)."""

from pyspark.sql import functions as F

from ctxloom import constants as K
from ctxloom.operators import assemble, config, content, select


def _cap(spark, data, cap):
    df = spark.createDataFrame([(data,)], "content binary")
    return df.select(content.capped_text(F.col("content"), cap).alias("t"),
                     content.content_kind(F.col("content"), cap).alias("k")).first()


def test_cap_edges(spark):
    assert _cap(spark, b"a" * 4096, 4096).t == "a" * 4096
    r = _cap(spark, b"a" * 2047 + b"b" * 2050, 4096)
    assert r.k == "truncated" and r.t == "a" * 2047 + "b" + "\n[... truncated ...]\n" + "b" * 2048
    # a cap under two sniff windows keeps the whole sniffed prefix as head
    r = _cap(spark, bytes(range(65, 91)) * 100, 1024)
    assert r.t.startswith((bytes(range(65, 91)) * 100)[:1024].decode()) and r.t.count("\n[... truncated ...]\n") == 1


def test_sniff_window(spark):
    assert _cap(spark, b"a" * 1023 + b"\x00", 10_000).k == "binary"
    assert _cap(spark, b"a" * 1024 + b"\x00", 10_000).k == "whole"
    assert _cap(spark, b"a\x00", 10_000).t == "[binary file omitted]\n"
    assert _cap(spark, None, 10_000).t == "[error reading file]\n"


def test_lossy_decode_at_cut(spark):
    data = "é".encode() * 3000               # 2-byte characters
    r = _cap(spark, b"x" + data + b"y", 4096)  # 6002 bytes: byte 2048 and byte 3954 fall mid-character
    head, tail = r.t.split("\n[... truncated ...]\n")
    assert head.endswith("�") and tail.startswith("�")


def test_carry_over_and_ticks(spark):
    files = spark.createDataFrame([("p", "a/x"), ("p", "a/y"), ("p", "b/z"), ("q", "a/x")], "project_id string, rel_path string")
    saved = spark.createDataFrame([("p", "a/x", True), ("p", "gone", True)], "project_id string, rel_path string, selected boolean")
    kept = select.carry_over(files, saved)
    assert {(r.project_id, r.rel_path): r.selected for r in kept.collect()} == {
        ("p", "a/x"): True, ("p", "a/y"): False, ("p", "b/z"): False, ("q", "a/x"): False}
    actions = spark.createDataFrame(
        [("p", "a", True, 1), ("p", "a/x", False, 2), ("p", "", False, 0), ("q", "", True, 5)],
        "project_id string, folder string, value boolean, seq long")
    got = {(r.project_id, r.rel_path): r.selected for r in select.apply_ticks(kept, actions).collect()}
    assert got == {("p", "a/x"): False, ("p", "a/y"): True, ("p", "b/z"): False, ("q", "a/x"): True}


def test_system_text_layers(spark):
    layers = spark.createDataFrame([
        ("p", 0, "/p/system.txt", None), ("p", 1, "/env", "ENV"), ("p", 2, "/def", "DEF"),
        ("q", 0, "/q/system.txt", None), ("q", 2, "/def", None)],
        "project_id string, layer int, path string, text string")
    addons = spark.createDataFrame([("p", "ADD")], "project_id string, text string")
    got = {r.project_id: r.system for r in config.with_addon(config.system_text(layers), addons).collect()}
    assert got["p"] == "ENV\n\nADD"
    assert got["q"] == K.WORDS.system_failed + '"' + K.WORDS.system_missing + '/q/system.txt, /def"'


def test_document_golden(spark):
    projects = spark.createDataFrame([("p",)], "project_id string")
    system = spark.createDataFrame([("p", "SYS]]>")], "project_id string, system string")
    instr = spark.createDataFrame([("p", "do it")], "project_id string, text string")
    trees = spark.createDataFrame([("p", "p/\n└─ a&b\n")], "project_id string, tree string")
    files = spark.createDataFrame([("p", "a&b", bytearray(b"x<1>"))], "project_id string, rel_path string, content binary")
    frags = assemble.fragments(projects, system, instr, trees, files)
    doc = assemble.documents(frags).first()
    expected = (K.WORDS.system_open + "<![CDATA[SYS]]]]><![CDATA[>]]>" + K.WORDS.system_close +
                ""
                "<instruction><![CDATA[do it]]></instruction>\n"
                "<file_tree>\n<![CDATA[p/\n└─ a&b\n]]>\n</file_tree>\n"
                "<code>\n<file path=\"a&amp;b\"><![CDATA[x<1>]]></file>\n</code>\n\n"
                "<terminal_command><![CDATA[]]></terminal_command>\n"
                "<terminal_output><![CDATA[]]></terminal_output>\n"
                "<instruction><![CDATA[do it]]></instruction>\n")
    assert doc.text == expected
    assert doc.n_bytes == len(expected.encode()) and doc.n_tokens == len(expected.encode()) // 3
    rows = sorted(assemble.documents(frags, chunk_bytes=40).collect(), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in rows] == list(range(rows[0].n_chunks)) and len(rows) > 3
    assert "".join(r.text for r in rows) == expected and all(r.n_bytes == len(expected.encode()) for r in rows)
    extra = spark.createDataFrame([("p", "u1", "page", True), ("p", "u2", "no", False)], "project_id string, url string, content string, include boolean")
    other = assemble.documents(assemble.fragments(projects, system, instr, trees, files, emit_tree=False, emit_remotes=extra)).first().text
    assert "<file_tree>" not in other and '<file path="u1"><![CDATA[page]]></file>\n</code>' in other and "u2" not in other


def test_unreadable_layer_gives_its_error(spark):
    layers = spark.createDataFrame([("p", 0, "/p/s", False, None), ("p", 1, "/e/s", True, None), ("p", 2, "/d/s", True, "DEF")],
                                   "project_id string, layer int, path string, exists boolean, text string")
    row = config.system_text(layers).first()
    assert row.layer == 1 and row.system == K.WORDS.system_failed + K.UNREADABLE_ERROR + ', path: "/e/s"'


def test_repeated_saved_rows_do_not_repeat_files(spark):
    files = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, rel_path string")
    saved = spark.createDataFrame([("p", "a", True, 1), ("p", "a", False, 2)], "project_id string, rel_path string, selected boolean, seq long")
    assert sorted(tuple(r) for r in select.carry_over(files, saved).collect()) == [("p", "a", False), ("p", "b", False)]
