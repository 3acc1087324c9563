"""Column functions against plain-Python models (P3, P9-P13, lines)."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.functions import (cdata_wrap, escape_xml_attr, file_class, html_to_text, rust_lines,
                               strip_comments, text_tokens, file_tokens)
from tests.reference_models import text_lines as py_lines
from tests.reference_models import strip_comments as py_strip


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col(F.col("x")).alias("y")).first().y


def test_cdata_and_attr(spark):
    assert _one(spark, cdata_wrap, "a]]>b") == "<![CDATA[a]]]]><![CDATA[>b]]>"
    assert _one(spark, escape_xml_attr, "a&<>\"'b") == "a&amp;&lt;&gt;&quot;&apos;b"


def test_token_estimates(spark):
    df = spark.createDataFrame([(0, "é"), (1, "abcd"), (5, "abcde"), (16777217, "")], "n long, t string")
    got = df.select(file_tokens(F.col("n")).alias("f"), text_tokens(F.col("t")).alias("t")).collect()
    assert [(r.f, r.t) for r in got] == [(0, 1), (1, 1), (2, 2), (4194304, 0)]


ALPHABET = st.sampled_from(list("ab /#'\"\\\t\r é"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=0, max_size=6))
def test_strip_comments_matches_loop(spark, lines):
    text = "\n".join(lines)
    assert _one(spark, strip_comments, text) == py_strip(text)


def test_strip_comments_cases(spark):
    cases = ["x = 1 // c", "url = 'http://a' # c", 'say "a # b" # c', "a \\\" b // c", "  # only", "",
             "a\r\nb\r", "it's // here", "x/y /z", "tab\t\t", "a\\\\'b # c'", "#\n\n  x"]
    for c in cases:
        assert _one(spark, strip_comments, c) == py_strip(c), c


def test_strip_comments_long_line(spark):
    line = "'" + "a" * 300_000 + "\\'" * 1000
    assert _one(spark, strip_comments, line) == py_strip(line)


def test_rust_lines(spark):
    for t in ["", "a", "a\n", "a\r\nb", "a\rb\r", "\n\n", "a\n\nb\r\n"]:
        got = spark.createDataFrame([(t,)], "x string").select(rust_lines(F.col("x")).alias("y")).first().y
        assert list(got) == py_lines(t), repr(t)


def test_character_references(spark):
    import html as std

    from ctxloom.functions.text import decode_references
    from ctxloom.plans.registry import REFERENCE_CASES
    # as the standard library reads them, but for: a no-break space, a missing ;, numbers of any length, names of HTML 5
    want = {c: std.unescape(c).replace("\xa0", " ") for c in REFERENCE_CASES}
    want |= {c: c for c in ("&eacute", "&#9999999999;", "&#x;", "&#;", "", None)} | {"&#129;": "\x81", "&#x10FFFF;": "\U0010ffff"}
    df = spark.createDataFrame([(c,) for c in want], "x string")
    assert {r.x: r.y for r in df.select("x", decode_references(F.col("x")).alias("y")).collect()} == want


def test_raw_elements_have_their_own_ends(spark):
    assert _one(spark, html_to_text, "<html><head><style>p{}</style><title>T</title></head><body>x</body>") == "x"
    assert _one(spark, html_to_text, "a<script>'</style>'</script>b<style>s</script></style>c") == "abc"


def test_html_to_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><!-- ad --><nav><ul><li>A</li>"
            "<li>B</li></ul></nav><p>Hello &amp; <b>bye</b>&nbsp;now</p><script>x=1</script>"
            "<div>" + " ".join(["word"] * 30) + "</div></body></html>")
    out = _one(spark, html_to_text, html)
    lines = out.split("\n")
    assert lines[:3] == ["A", "B", "Hello & bye now"]
    assert all(len(x) <= 80 for x in lines)
    assert " ".join(lines[3:]) == " ".join(["word"] * 30)
    assert _one(spark, html_to_text, "<p>" + "x" * 100 + " y</p>") == "x" * 100 + "\ny"


def test_file_class_first_match(spark):
    names = {"a.rs": "Rust", "b.md": "Markdown/Text", "c.cuda": "CUDA", "d.o": "Object", "e.jpeg": "Images",
             "f.spvasm": "SPIR-V", "g.comp": "GLSL/Compute", "Cargo.lock": "Lock", "x.RS": "other", "noext": "other",
             "y.toml": "TOML"}
    df = spark.createDataFrame([(k,) for k in names], "x string").select("x", file_class(F.col("x")).alias("c"))
    assert {r.x: r.c for r in df.collect()} == names


def test_random_strip_fuzz(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab/#'\"\\ \n") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", strip_comments(F.col("x")).alias("y")).collect()}
    assert all(got[i] == py_strip(t) for i, t in enumerate(texts))
