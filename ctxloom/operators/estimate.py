"""Size estimate per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.constants import TOKEN_BUDGET
from ctxloom.functions.tokens import budget_pct, chars_to_tokens, file_tokens, text_tokens


def estimate(projects: DataFrame, loaded: DataFrame, instructions: DataFrame | None = None,
             remotes: DataFrame | None = None, include_tree: bool = True) -> DataFrame:
    """``2 x P3(instruction) + P4(tree) + sum P2(selected files) + sum P3(included remotes)``.

    ``loaded(project_id, rel_path, length, selected)`` is every loaded file;
    ``remotes(project_id, content, include)``; ``projects`` may carry their
    instruction as ``text``.  All parts are rows of one table
    (project, its instruction, a file, a page) and one grouped sum by project,
    with map-side partials; no part is joined to another.
    """
    zero, number = F.lit(0).cast("bigint"), "bigint"
    names = ["_known", "_it", "_tree_chars", "file_tokens", "remote_tokens"]

    def part(df: DataFrame, **found: Column) -> DataFrame:
        return df.select("project_id", *[found.get(n, zero).cast(number).alias(n) for n in names])

    own = {"_it": text_tokens(F.col("text"))} if "text" in projects.columns else {}
    rows = part(projects, _known=F.lit(1), **own).unionByName(part(
        loaded, _tree_chars=F.octet_length("rel_path") + 4,
        file_tokens=F.when(F.coalesce(F.col("selected"), F.lit(False)), file_tokens(F.col("length"))).otherwise(0)))
    if instructions is not None:
        rows = rows.unionByName(part(instructions, _it=text_tokens(F.col("text"))))
    if remotes is not None:
        rows = rows.unionByName(part(remotes.where(F.col("include")), remote_tokens=text_tokens(F.col("content"))))
    out = rows.groupBy("project_id").agg(*[F.coalesce(F.sum(n), zero).cast(number).alias(n) for n in names]).where("_known > 0")
    tree = chars_to_tokens(F.col("_tree_chars") + F.lit(16)) if include_tree else zero
    out = out.select(
        "project_id",
        F.col("_it").alias("instruction_tokens"),
        tree.cast("bigint").alias("tree_tokens"),
        "file_tokens",
        "remote_tokens")
    total = (F.col("instruction_tokens") * 2 + F.col("tree_tokens") + F.col("file_tokens") + F.col("remote_tokens"))
    return out.withColumn("estimate", total.cast("bigint"))


def budget(est: DataFrame) -> DataFrame:
    """Budget share and the label the tool shows."""
    pct = budget_pct(F.col("estimate"))
    label = F.concat(F.lit("Token count (approx): "), F.format_number(F.col("estimate"), 0),
                     F.lit(" / 200,000 ("), pct.cast("string"), F.lit("%)"))
    # exact decimal rounding, reported as a double (the label keeps the decimal text)
    return est.select("project_id", "estimate", pct.cast("double").alias("budget_pct"),
                      (F.col("estimate") > TOKEN_BUDGET).alias("over_budget"), label.alias("label"))
