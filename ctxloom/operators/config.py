"""Layered system text pick (J4) and the project addon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.constants import UNREADABLE_ERROR, WORDS, Wording


def debug_quote(s: Column) -> Column:
    """A string as Rust's ``{:?}`` prints it (quotes, escaped ``\\ " \\n \\r \\t``)."""
    out = s
    for ch, rep in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return F.concat(F.lit('"'), out, F.lit('"'))


def system_text(layers: DataFrame, words: Wording = WORDS) -> DataFrame:
    """First existing layer per project (lowest ``layer``); when that file
    cannot be read, the error text with its path; when none exists, the error
    text naming every path tried, in layer order (J4).

    ``layers(project_id, layer, path, text[, exists])``; without ``exists`` a
    null ``text`` means a missing file.  Candidates per project are a handful,
    so this is one small grouped pass.
    """
    exists = F.col("exists") if "exists" in layers.columns else F.col("text").isNotNull()
    agg = layers.groupBy("project_id").agg(
        F.min(F.when(exists, F.struct("layer", "path", "text"))).alias("_found"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "path"))), lambda x: x["path"]),
                     ", ").alias("_tried"))
    missing = F.concat(F.lit(words.system_failed), debug_quote(F.concat(F.lit(words.system_missing), F.col("_tried"))))
    unreadable = F.concat(F.lit(words.system_failed + UNREADABLE_ERROR + ", path: "), debug_quote(F.col("_found.path")))
    return agg.select("project_id",
                      F.when(F.col("_found").isNull(), missing).otherwise(F.coalesce(F.col("_found.text"), unreadable)).alias("system"),
                      F.col("_found.layer").alias("layer"))


def with_addon(system: DataFrame, addons: DataFrame) -> DataFrame:
    """Base + ``\\n\\n`` + addon when the project has one."""
    a = addons.select("project_id", F.col("text").alias("_addon"))
    out = system.join(a, "project_id", "left")
    return out.withColumn("system", F.when(F.col("_addon").isNotNull(),
                                           F.concat(F.col("system"), F.lit("\n\n"), F.col("_addon")))
                          .otherwise(F.col("system"))).drop("_addon")
