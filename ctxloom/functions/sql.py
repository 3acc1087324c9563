"""The pure expressions as SQL functions (P2-P5, P9-P15, L5 on text).

``register_sql_functions(spark)`` creates temporary SQL functions with SQL
bodies, so ``spark.sql`` users get the same expressions; Spark inlines the
bodies into the plan (no Python at run time).  The bodies are built from the
same fixed values and regexes as the Column functions, and
``tests/test_sql_functions.py`` checks that both forms agree.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ctxloom import constants as K
from ctxloom.functions.text import HTML_C1, HTML_NAMES, HTML_REFERENCE, HTML_SPACE_STEPS, HTML_STEPS, HTML_TRIM_CHARS, STRIP_LINE_RE


def sql_str(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslash escapes)."""
    return "'" + (s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
                  .replace("\r", "\\r").replace("\t", "\\t")) + "'"


def _file_class_body() -> str:
    whens = []
    for label, sufs in K.FILE_CLASSES:
        cond = " OR ".join(f"endswith(name, {sql_str(s)})" for s in sufs)
        whens.append(f"WHEN {cond} THEN {sql_str(label)}")
    return "CASE " + " ".join(whens) + f" ELSE {sql_str(K.OTHER_CLASS)} END"


def _html_body(width: int = K.WRAP_COLUMNS) -> str:
    out = "html"
    for pat, rep in HTML_STEPS:
        out = f"regexp_replace({out}, {sql_str(pat)}, {sql_str(rep)})"
    out = f"ctx_decode_references({out})"
    for pat, rep in HTML_SPACE_STEPS:
        out = f"regexp_replace({out}, {sql_str(pat)}, {sql_str(rep)})"
    out = f"btrim({out}, {sql_str(HTML_TRIM_CHARS)})"
    out = f"regexp_replace({out}, {sql_str('([^\\n]{1,%d})(?: +|\\n|\\z)' % width)}, {sql_str('$1' + chr(10))})"
    return f"regexp_replace({out}, {sql_str(chr(92) + 'n' + chr(92) + 'z')}, '')"


def _references_body() -> str:
    found = (f"transform(split(t, '&', -1), (p, i) -> named_struct('p', p, 'name', CASE WHEN i > 0 THEN regexp_extract(p, {sql_str(HTML_REFERENCE)}, 1) END))")
    read = (f"transform({found}, x -> named_struct('p', x.p, 'name', x.name, 'n', CAST(CASE WHEN startswith(lower(x.name), '#x') THEN conv(substring(x.name, 3), 16, 10) "
            "WHEN startswith(x.name, '#') THEN substring(x.name, 2) END AS BIGINT)))")
    code = ("CASE WHEN x.n = 0 OR x.n > 1114111 OR x.n BETWEEN 55296 AND 57343 THEN 65533 WHEN x.n = 160 THEN 32 "
            f"WHEN x.n BETWEEN 128 AND 159 THEN get(array({', '.join(map(str, HTML_C1))}), CAST(x.n - 128 AS INT)) ELSE x.n END")
    names = "map(" + ", ".join(f"{sql_str(k)}, {sql_str(v)}" for k, v in HTML_NAMES.items()) + ")"
    rest = "substring(x.p, length(x.name) + 2)"
    return (f"array_join(transform({read}, x -> CASE WHEN x.name IS NULL THEN x.p "
            f"WHEN x.n IS NOT NULL THEN concat(decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), {rest}) "
            f"ELSE coalesce(concat(try_element_at({names}, x.name), {rest}), concat('&', x.p)) END), '')")


def _lines_body(t: str) -> str:
    parts = f"split({t}, {sql_str(chr(13) + '?' + chr(10))}, -1)"
    return (f"CASE WHEN {t} = '' THEN CAST(array() AS ARRAY<STRING>) "
            f"WHEN endswith({t}, {sql_str(chr(10))}) THEN slice({parts}, 1, size({parts}) - 1) ELSE {parts} END")


FUNCTIONS = {
    "ctx_file_tokens": ("n BIGINT", "BIGINT", "CAST(ceil(CAST(n AS FLOAT) * CAST(0.25 AS FLOAT)) AS BIGINT)"),
    "ctx_text_tokens": ("t STRING", "BIGINT",
                        "coalesce(CAST(ceil(CAST(char_length(t) AS FLOAT) * CAST(0.25 AS FLOAT)) AS BIGINT), 0)"),
    "ctx_document_tokens": ("n BIGINT", "BIGINT", "CAST(floor(n / 3) AS BIGINT)"),
    "ctx_budget_pct": ("n BIGINT", "DECIMAL(12,2)",
                       f"CAST(round(CAST(n AS DECIMAL(20,0)) * 100 / {K.TOKEN_BUDGET}, 2) AS DECIMAL(12,2))"),
    "ctx_cdata": ("t STRING", "STRING",
                  f"concat({sql_str(K.CDATA_OPEN)}, replace(t, ']]>', {sql_str(K.CDATA_SPLIT)}), {sql_str(K.CDATA_CLOSE)})"),
    "ctx_xml_attr": ("t STRING", "STRING",
                     "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
                     "'\"', '&quot;'), \"'\", '&apos;')"),
    "ctx_file_class": ("name STRING", "STRING", _file_class_body()),
    "ctx_strip_comments": ("t STRING", "STRING",
                           f"array_join(filter(transform(split(t, {sql_str(chr(10))}, -1), "
                           f"l -> regexp_replace(regexp_extract(l, {sql_str(STRIP_LINE_RE)}, 0), "
                           f"{sql_str('(?U)' + chr(92) + 's+' + chr(92) + 'z')}, '')), l -> l <> ''), {sql_str(chr(10))})"),
    "ctx_decode_references": ("t STRING", "STRING", _references_body()),
    "ctx_html_to_text": ("html STRING", "STRING", _html_body()),
    "ctx_lines": ("t STRING", "ARRAY<STRING>", _lines_body("t")),
    "ctx_head_tail": ("t STRING, n INT, m INT", "STRING",
                      "array_join(transform(CASE WHEN size(ctx_lines(t)) <= n + m THEN ctx_lines(t) ELSE "
                      f"concat(slice(ctx_lines(t), 1, n), array({sql_str(K.OUTPUT_TRUNCATED_MARKER)}), "
                      "CASE WHEN m > 0 THEN slice(ctx_lines(t), size(ctx_lines(t)) - m + 1, m) "
                      "ELSE CAST(array() AS ARRAY<STRING>) END) END, x -> concat(x, '\\n')), '')"),
    "ctx_tree_tokens": ("chars BIGINT", "BIGINT", "CAST(ceil(CAST(chars + 16 AS FLOAT) * CAST(0.25 AS FLOAT)) AS BIGINT)"),
    "ctx_lossy_utf8": ("b BINARY", "STRING", "make_valid_utf8(CAST(b AS STRING))"),
    "ctx_capped_text": ("b BINARY, cap INT", "STRING",
                        f"CASE WHEN b IS NULL THEN {sql_str(K.READ_ERROR_MARKER)} "
                        f"WHEN contains(substring(b, 1, {K.SNIFF_BYTES}), X'00') THEN {sql_str(K.BINARY_MARKER)} "
                        "WHEN octet_length(b) <= cap THEN ctx_lossy_utf8(b) ELSE concat("
                        f"ctx_lossy_utf8(substring(b, 1, greatest(cap div 2, least({K.SNIFF_BYTES}, octet_length(b))))), {sql_str(K.TRUNCATED_MARKER)}, "
                        "ctx_lossy_utf8(substring(b, octet_length(b) - cap div 2 + 1, cap div 2))) END"),
    "ctx_path_prefixes": ("p STRING", "ARRAY<STRING>",
                          "transform(sequence(0, size(filter(split(replace(p, '\\\\', '/'), '/'), s -> s <> ''))), "
                          "i -> array_join(slice(filter(split(replace(p, '\\\\', '/'), '/'), s -> s <> ''), 1, i), '/'))"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
