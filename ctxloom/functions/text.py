"""Text functions: document escaping (P9, P10), comment stripping (P11),
HTML to text (P13), file classes (P12) and line splitting.

Every function returns a Column built from built-in expressions, so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.constants import (CDATA_CLOSE, CDATA_OPEN, CDATA_SPLIT, FILE_CLASSES, OTHER_CLASS,
                               WRAP_COLUMNS)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cdata_wrap(text) -> Column:
    """``<![CDATA[`` + text with every ``]]>`` split + ``]]>``."""
    return F.concat(F.lit(CDATA_OPEN), F.replace(_c(text), F.lit("]]>"), F.lit(CDATA_SPLIT)), F.lit(CDATA_CLOSE))


def escape_xml_attr(text) -> Column:
    """XML attribute escape, ``&`` first (P10)."""
    out = _c(text)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def trim_unicode(text) -> Column:
    """Trim Unicode white space at both ends (Rust ``str::trim``)."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+\z", "")


def trim_end(text) -> Column:
    """Trim Unicode white space at the end (Rust ``str::trim_end``)."""
    return F.regexp_replace(_c(text), r"(?U)\s+\z", "")


def rust_lines(text) -> Column:
    """Split like Rust ``str::lines``: on ``\\n`` or ``\\r\\n``; no empty last line
    after a final line break; the empty text has no lines."""
    t = _c(text)
    parts = F.split(t, "\r?\n", -1)
    return (F.when(t == F.lit(""), F.array().cast("array<string>"))
            .when(t.endswith(F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


# Longest prefix of a line that lies outside a comment: plain characters,
# escapes outside strings, single- or double-quoted strings (may run to the
# end of the line), and slashes not followed by a slash.  Possessive, so a
# long line cannot overflow the regex stack.
STRIP_LINE_RE = (r"""(?s)^(?:[^"'\\/#]++|\\["'\\]?+|"(?:[^"\\]++|\\.?+)*+"?+"""
                 r"""|'(?:[^'\\]++|\\.?+)*+'?+|/(?!/))*+""")


def strip_comments(text) -> Column:
    """Cut each line at ``//`` or ``#`` outside quotes, trim the end, drop blank
    lines, join with ``\\n`` (P11, F7)."""
    lines = F.split(_c(text), "\n", -1)
    kept = F.transform(lines, lambda l: trim_end(F.regexp_extract(l, STRIP_LINE_RE, 0)))
    return F.array_join(F.filter(kept, lambda l: l != F.lit("")), "\n")


# HTML to text contract (P13).  FIXED VALUES: block tags.
HTML_BLOCK_TAGS = ["p", "div", "br", "li", "ul", "ol", "h[1-6]", "tr", "td", "th", "table", "section",
                   "article", "header", "footer", "nav", "pre", "blockquote", "title", "main", "aside",
                   "hr", "dd", "dt", "dl", "form", "figure"]
# Character references: the names of HTML 4 and apos; a no-break space counts as a space.
HTML_NAMES = {n: " " if c == 0xA0 else chr(c) for n, c in sorted((name2codepoint | {"apos": 0x27}).items())}
HTML_REFERENCE = r"^(#0*[0-9]{1,9}|#[xX]0*[0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# Numbers 128 to 159 mean the characters of code page 1252, where it has one.
HTML_C1 = [ord(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(128, 160)]

# A tag name ends at white space, "/" or ">" (same meaning in Java regex and RE2).
_TAG_REST = r"(?:[\t\n\x0B\f\r /][^>]*)?>"
HTML_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    # each raw element has its own end: a head that holds a style does not end with it
    ("(?is)" + "|".join(rf"<{t}{_TAG_REST}.*?</{t}[\t\n\x0B\f\r ]*>" for t in ("script", "style")), ""),
    (rf"(?is)<head{_TAG_REST}.*?</head[\t\n\x0B\f\r ]*>", ""),
    (r"(?i)</?(?:" + "|".join(HTML_BLOCK_TAGS) + r")" + _TAG_REST, "\n"),
    (r"<[^>]*>", ""),
]
# Each pattern matches only text it changes (a lone space or line break is
# left alone), so the common case costs a scan and no rewrite.
HTML_SPACE_STEPS = [
    (r"[\t\x0B\f\r ]{2,}|[\t\x0B\f\r]", " "),
    (r" +\n *|\n +", "\n"),
    (r"\n{2,}", "\n"),
]
HTML_TRIM_CHARS = " \n"


def decode_references(text) -> Column:
    """Character references once, from left to right: ``&#8217;``, ``&#x2019;``
    and names; what is none stays as it is (a ``;`` must end it).  Numbers that
    name no character give U+FFFD."""
    names = F.create_map(*[F.lit(x) for pair in HTML_NAMES.items() for x in pair])
    # a transform a step: what one step finds is computed once and read by the next
    found = F.transform(F.split(_c(text), "&", -1), lambda p, i: F.struct(
        p.alias("p"), F.when(i == 0, F.lit(None)).otherwise(F.regexp_extract(p, HTML_REFERENCE, 1)).alias("name")))
    read = F.transform(found, lambda x: F.struct(
        x["p"].alias("p"), x["name"].alias("name"),
        F.when(F.startswith(F.lower(x["name"]), F.lit("#x")), F.conv(F.substring(x["name"], F.lit(3), F.length(x["name"])), 16, 10))
         .when(F.startswith(x["name"], F.lit("#")), F.substring(x["name"], F.lit(2), F.length(x["name"]))).cast("bigint").alias("n")))
    return F.array_join(F.transform(read, _reference(names)), "")


def _reference(names: Column):
    def text_of(x: Column) -> Column:
        n, rest = x["n"], F.substring(x["p"], F.length(x["name"]) + 2, F.length(x["p"]))
        code = (F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), 0xFFFD).when(n == 0xA0, 0x20)
                .when(n.between(128, 159), F.get(F.array(*map(F.lit, HTML_C1)), (n - 128).cast("int"))).otherwise(n))
        return (F.when(x["name"].isNull(), x["p"])
                .when(n.isNotNull(), F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), rest))
                .otherwise(F.coalesce(F.concat(F.try_element_at(names, x["name"]), rest), F.concat(F.lit("&"), x["p"]))))
    return text_of


def html_to_text(html, width: int = WRAP_COLUMNS) -> Column:
    """Drop comments/script/style/head, block tags to line breaks, strip tags,
    decode character references, collapse white space, then wrap greedily at
    ``width`` columns (longer words stay whole)."""
    out = _c(html)
    for pat, rep in HTML_STEPS:
        out = F.regexp_replace(out, pat, rep)
    out = decode_references(out)
    for pat, rep in HTML_SPACE_STEPS:
        out = F.regexp_replace(out, pat, rep)
    out = F.btrim(out, F.lit(HTML_TRIM_CHARS))
    wrapped = F.regexp_replace(out, r"([^\n]{1,%d})(?: +|\n|\z)" % width, "$1\n")
    return F.regexp_replace(wrapped, r"\n\z", "")


def file_class(name) -> Column:
    """File class by name suffix, first match wins, case-sensitive."""
    n = _c(name)
    expr = None
    for label, suffixes in FILE_CLASSES:
        cond = None
        for s in suffixes:
            c = n.endswith(F.lit(s))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(OTHER_CLASS))
