"""Head and tail lines of command output or any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.constants import HEAD_LINES, OUTPUT_TRUNCATED_MARKER, TAIL_LINES
from ctxloom.functions.text import rust_lines
from ctxloom.session import materialize


def _kept(lines: Column, total: Column, first_n: int, last_n: int) -> Column:
    """All lines when ``total <= first_n + last_n``; else the first ``first_n``,
    a marker line, the last ``last_n``."""
    tail = F.slice(lines, total - F.lit(last_n) + 1, last_n) if last_n > 0 else F.array().cast("array<string>")
    cut = F.concat(F.slice(lines, 1, first_n), F.array(F.lit(OUTPUT_TRUNCATED_MARKER)), tail)
    return F.when(total <= first_n + last_n, lines).otherwise(cut)


def head_tail_text(text, first_n: int = HEAD_LINES, last_n: int = TAIL_LINES) -> Column:
    """Head and tail lines of a text, each ended by ``\\n``."""
    lines = rust_lines(text)
    kept = _kept(lines, F.size(lines), first_n, last_n)
    # join + final newline instead of a per-line lambda: no lambda keeps the
    # expression in generated code, where the split is computed once
    return F.concat(F.array_join(kept, "\n"), F.when(F.size(kept) > 0, F.lit("\n")).otherwise(F.lit("")))


def head_tail_rows(texts: DataFrame, first_n: int = HEAD_LINES, last_n: int = TAIL_LINES) -> DataFrame:
    """Row form over ``texts(key, text)``: ``(key, pos, line)`` with the marker at
    ``pos = first_n``.  The cut is made on the row, so only kept lines are
    exploded; no shuffle."""
    lines = rust_lines(F.col("text"))
    kept = _kept(lines, F.size(lines), first_n, last_n)
    # one string in between: generated code splits the text once, and lines hold no \n
    cut = texts.select("key", F.when(F.size(kept) > 0, F.array_join(kept, "\n")).alias("_cut"))
    return cut.select("key", F.posexplode(F.split("_cut", "\n", -1)).alias("pos", "line")).select("key", F.col("pos").cast("long").alias("pos"), "line")


def part_offsets(counts: DataFrame) -> DataFrame:
    """``counts(key, part, _n)`` with ``_off``, the sum of ``_n`` over the key's
    parts before, and ``_total``.

    Narrow rows only, and two levels for part keys of any type: ranges of
    (key, part) are summed inside first, then the few range totals of a key, so a
    key with very many parts is not sorted by one task."""
    # written once: both levels must see the same ranges
    ranged = materialize(counts.repartitionByRange("key", "part").withColumn("_b", F.spark_partition_id()), "part-counts")
    before = (Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("key", "_b").orderBy("part").rowsBetween(*before)), F.lit(0)))
    totals = ranged.groupBy("key", "_b").agg(F.sum("_n").alias("_bt"))
    by_key = Window.partitionBy("key")
    totals = totals.select("key", "_b", F.coalesce(F.sum("_bt").over(by_key.orderBy("_b").rowsBetween(*before)), F.lit(0)).alias("_boff"),
                           F.sum("_bt").over(by_key).alias("_total"))
    return inside.join(totals, ["key", "_b"]).select("key", "part", (F.col("_boff") + F.col("_in")).alias("_off"), "_total")


def _numbered(parts: DataFrame) -> DataFrame:
    """Parts with their lines ``_ls``, offset ``_off`` and the key's ``_total``."""
    split = parts.select("key", "part", rust_lines(F.col("text")).alias("_ls"))
    return split.join(part_offsets(split.select("key", "part", F.size("_ls").alias("_n"))), ["key", "part"])


def number_lines(parts: DataFrame) -> DataFrame:
    """Dense line numbers across ordered parts of one key: ``parts(key, part,
    text)`` (e.g. a conversation's turns) -> ``(key, line_no, line)``."""
    return (_numbered(parts).select("key", "_off", F.posexplode("_ls").alias("_pos", "line"))
            .select("key", (F.col("_off") + F.col("_pos")).cast("long").alias("line_no"), "line"))


def head_tail_parts(parts: DataFrame, first_n: int = HEAD_LINES, last_n: int = TAIL_LINES) -> DataFrame:
    """``(key, pos, line)`` of the head and tail over a key's ordered parts.

    A part keeps the lines at its front that fall into the head and those at its
    end that fall into the tail, by ``slice``; parts in the middle keep none."""
    p = _numbered(parts)
    off, total, size = F.col("_off"), F.col("_total"), F.size("_ls")
    short = total <= first_n + last_n
    head = F.when(short, size).otherwise(F.least(size, F.greatest(F.lit(0), first_n - off)))
    tail = F.when(short, F.lit(0)).otherwise(F.least(size, F.greatest(F.lit(0), off + size - (total - last_n))))
    cut = p.select("key", "_off", "_total", "_ls", head.cast("int").alias("_h"), tail.cast("int").alias("_t"), short.alias("_short"))
    front = cut.where("_h > 0").select("key", "_off", F.posexplode(F.slice("_ls", F.lit(1), F.col("_h"))).alias("_pos", "line")).select(
        "key", (F.col("_off") + F.col("_pos")).cast("long").alias("pos"), "line")
    start = F.col("_off") + F.size("_ls") - F.col("_t")
    back = cut.where("_t > 0").select(
        "key", (start - (F.col("_total") - last_n) + first_n + 1).alias("_from"),
        F.posexplode(F.slice("_ls", F.size("_ls") - F.col("_t") + 1, F.col("_t"))).alias("_pos", "line")).select(
        "key", (F.col("_from") + F.col("_pos")).cast("long").alias("pos"), "line")
    # the marker stands once per key: with the part that holds line 0
    marker = cut.where("NOT _short AND _off = 0 AND size(_ls) > 0").select(
        "key", F.lit(first_n).cast("long").alias("pos"), F.lit(OUTPUT_TRUNCATED_MARKER).alias("line"))
    return front.unionByName(back).unionByName(marker)
