"""Token estimates (P2-P5) and the budget share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.constants import TOKEN_BUDGET


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _f32_quarter(n: Column) -> Column:
    """``f32(n) / 4`` kept in float arithmetic: a float-by-float multiply stays
    float, so the f32 rounding of ``n`` survives (a division would widen to
    double and Catalyst would fold the two casts into one)."""
    return n.cast("float") * F.lit(0.25).cast("float")


def file_tokens(length) -> Column:
    """``ceil(f32(bytes) / 4)``; multiplying a float by 1/4 is exact."""
    return F.ceil(_f32_quarter(_c(length))).cast("bigint")


def text_tokens(text) -> Column:
    """``ceil(f32(chars) / 4)`` over characters, 0 for null text."""
    return F.coalesce(F.ceil(_f32_quarter(F.char_length(_c(text)))).cast("bigint"), F.lit(0).cast("bigint"))


def tree_estimate_chars(rel_path) -> Column:
    """Per-file share of the tree estimate: path bytes + 4 (sum, add 16, then P3 on the total)."""
    return (F.octet_length(_c(rel_path)) + F.lit(4)).cast("bigint")


def chars_to_tokens(chars) -> Column:
    return F.ceil(_f32_quarter(_c(chars))).cast("bigint")


def document_tokens(n_bytes) -> Column:
    """Final count: UTF-8 bytes of the document divided by 3 (P5)."""
    return F.floor(_c(n_bytes) / F.lit(3)).cast("bigint")


def budget_pct(tokens) -> Column:
    """Share of the budget in percent, 2 decimals, exact decimal arithmetic."""
    return F.round(_c(tokens).cast("decimal(20,0)") * F.lit(100) / F.lit(TOKEN_BUDGET), 2).cast("decimal(12,2)")
