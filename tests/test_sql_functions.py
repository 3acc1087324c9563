"""SQL forms of the pure expressions agree with the Column forms."""

from pyspark.sql import functions as F

from ctxloom.functions import (budget_pct, cdata_wrap, escape_xml_attr, file_class, file_tokens, html_to_text,
                               path_prefixes, rust_lines, strip_comments, text_tokens)
from ctxloom.functions.sql import register_sql_functions
from ctxloom.functions.tokens import chars_to_tokens
from ctxloom.operators.content import capped_text, lossy_utf8
from ctxloom.operators.lines import head_tail_text
from tests.conftest import SF001


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "n_chars")
    p = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "html", "url")
    pairs = [
        (d, "ctx_file_tokens(n_chars)", file_tokens(F.col("n_chars"))),
        (d, "ctx_text_tokens(text)", text_tokens(F.col("text"))),
        (d, "ctx_budget_pct(n_chars * 100)", budget_pct(F.col("n_chars") * 100)),
        (d, "ctx_cdata(concat(text, ']]>'))", cdata_wrap(F.concat(F.col("text"), F.lit("]]>")))),
        (d, "ctx_strip_comments(text)", strip_comments(F.col("text"))),
        (d, "ctx_lines(text)", rust_lines(F.col("text"))),
        (d, "ctx_head_tail(text, 3, 2)", head_tail_text(F.col("text"), 3, 2)),
        (p, "ctx_html_to_text(html)", html_to_text(F.col("html"))),
        (p, "ctx_strip_comments(concat(url, '\\n', html))", strip_comments(F.concat(F.col("url"), F.lit("\n"), F.col("html")))),
        (p, "ctx_xml_attr(url)", escape_xml_attr(F.col("url"))),
        (p, "ctx_file_class(url)", file_class(F.col("url"))),
        (p, "ctx_path_prefixes(url)", path_prefixes(F.col("url"))),
        (d, "ctx_tree_tokens(n_chars)", chars_to_tokens(F.col("n_chars") + 16)),
        (d, "ctx_lossy_utf8(substring(CAST(text AS BINARY), 2, 1001))", lossy_utf8(F.substring(F.col("text").cast("binary"), 2, 1001))),
        (d, "ctx_capped_text(CAST(text AS BINARY), 1500)", capped_text(F.col("text").cast("binary"), 1500)),
        (d, "ctx_capped_text(CAST(concat('a\\0', text) AS BINARY), 1500)", capped_text(F.concat(F.lit("a\0"), F.col("text")).cast("binary"), 1500)),
    ]
    for df, sql, col in pairs:
        diff = df.select(F.expr(sql).alias("a"), col.alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
        assert diff.count() == 0, sql
    plan = d.selectExpr("ctx_strip_comments(text)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
