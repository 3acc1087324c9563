"""Content normalisation (S4, F4, P6, P7, P8): binary sniff, head + tail cap,
lossy UTF-8 decode and the read-error placeholder, on a ``binary`` column.

Everything is a byte-level expression: ``substring`` on binary, so the cut
is by bytes like the original, and only the two cut points may break a
character (decoded lossily, as ``String::from_utf8_lossy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.constants import (BINARY_MARKER, MAX_PER_FILE_BYTES, READ_ERROR_MARKER, SNIFF_BYTES,
                               TRUNCATED_MARKER)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lossy_utf8(b) -> Column:
    """Bytes to text, invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(_c(b).cast("string"))


def is_binary(content) -> Column:
    """NUL byte within the first 1024 bytes."""
    return F.contains(F.substring(_c(content), 1, SNIFF_BYTES), F.lit(bytearray(b"\x00")))


def head_len(n_bytes, cap: int) -> Column:
    """Head bytes kept for a file over the cap: the sniffed prefix is always
    kept, so ``max(cap // 2, min(1024, len))``."""
    return F.greatest(F.lit(cap // 2), F.least(F.lit(SNIFF_BYTES), _c(n_bytes)))


def content_kind(content, cap: int = MAX_PER_FILE_BYTES) -> Column:
    c = _c(content)
    return (F.when(c.isNull(), F.lit("missing"))
            .when(is_binary(c), F.lit("binary"))
            .when(F.octet_length(c) <= cap, F.lit("whole"))
            .otherwise(F.lit("truncated")))


def capped_text(content, cap: int = MAX_PER_FILE_BYTES) -> Column:
    """The text a document shows for a file."""
    c = _c(content)
    n = F.octet_length(c)
    half = cap // 2
    head = F.substring(c, F.lit(1), head_len(n, cap))
    tail = F.substring(c, F.lit(-half) if half > 0 else F.lit(1), F.lit(half))
    return (F.when(c.isNull(), F.lit(READ_ERROR_MARKER))
            .when(is_binary(c), F.lit(BINARY_MARKER))
            .when(n <= cap, lossy_utf8(c))
            .otherwise(F.concat(lossy_utf8(head), F.lit(TRUNCATED_MARKER), lossy_utf8(tail))))


def capped_read_text(content, n_bytes, cap: int = MAX_PER_FILE_BYTES) -> Column:
    """``capped_text`` of a file that ``sources.files.read_capped`` read by seek:
    ``content`` is the whole file up to the cap, else its head and tail."""
    c, n = _c(content), _c(n_bytes)
    head = F.substring(c, F.lit(1), head_len(n, cap))
    tail = F.substring(c, head_len(n, cap) + 1, F.lit(cap // 2))
    return (F.when(c.isNull(), F.lit(READ_ERROR_MARKER))
            .when(is_binary(c), F.lit(BINARY_MARKER))
            .when(n <= cap, lossy_utf8(c))
            .otherwise(F.concat(lossy_utf8(head), F.lit(TRUNCATED_MARKER), lossy_utf8(tail))))


def capped_parts(files: DataFrame, cap: int) -> DataFrame:
    """Byte-level view of the cap: kind, head and tail as hex (for checks)."""
    c = F.col("content")
    n = F.octet_length(c)
    half = cap // 2
    truncated = content_kind(c, cap) == F.lit("truncated")
    head = F.when(truncated, F.substring(c, F.lit(1), head_len(n, cap))).otherwise(c)
    tail = F.when(truncated, F.substring(c, F.lit(-half) if half > 0 else F.lit(1), F.lit(half)))
    return files.select("project_id", "rel_path", content_kind(c, cap).alias("kind"),
                        n.cast("bigint").alias("n_bytes"), F.hex(head).alias("head_hex"),
                        F.hex(tail).alias("tail_hex"))
