"""Building blocks shared by the registered queries (docs / web flows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.constants import NAMES
from ctxloom.functions.globs import compile_rule_lines
from ctxloom.operators import scan, select
from ctxloom.sources import views
from ctxloom.sources.tables import table

# Query parameters: the ignore file every docs project uses (FIXED VALUES of
# the test queries, one rule per line, including a comment and a blank).
DOC_RULES = ["# generated and scratch files", "", "*.tmp", "*.lock", "en/1/", "fr/2", "de/**/*.o",
             "*.[jp]*g", "es/{3,4}/", "/x", "{a,b}"]
WEB_RULES = ["*.html", "fr/", "de", "  # indented comment", "es/7*"]
SMALL_LIMIT = 7
SMALL_CAP = 1024
SMALL_CHUNK = 8192


def doc_rules_regex() -> str:
    return compile_rule_lines(DOC_RULES)


def web_rules_regex() -> str:
    return compile_rule_lines(WEB_RULES)


def docs_loaded(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Loaded docs files (metadata only): rules, symlinks, limit."""
    cat = views.docs_meta(spark, sf_dir)
    if limit is None:
        return scan.loaded_files(cat, doc_rules_regex())
    return scan.loaded_files(cat, doc_rules_regex(), limit)


def docs_selected_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded docs with their tick state: carried-over selection, then ticks."""
    return docs_ticked(spark, sf_dir).drop("_key", "_part", "_at", "_dirs")


def docs_ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, in path order for the rollups."""
    return select.tick_rows(docs_loaded(spark, sf_dir), views.folder_actions(spark, sf_dir), views.selection(spark, sf_dir))


def web_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.loaded_files(views.web(spark, sf_dir).drop("content"), web_rules_regex())


def with_content(files: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join content by key onto the surviving selected files: content last."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    # the chosen keys come from a written table, so Spark knows their size: few
    # are broadcast and the text column is not shuffled, more are a shuffle join
    # (right outer join: the broadcast side must be the preserved one)
    return text.join(files, "doc_id", "right")


def workspace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Project roots and rule files laid out from the docs projects.

    Root of project p: ``/ws/<lang>/<p>``.  Rule files: the preferred name
    in the project root when ``k % 4 = 0``; the legacy name there when
    ``k % 4 in (0, 1)``; the preferred name in ``/ws/en`` (comments only)
    and ``/ws/fr``.  Others find nothing and get the default rules.
    """
    p = views.projects(spark, sf_dir)
    root = F.concat(F.lit("/ws/"), F.col("lang"), F.lit("/"), F.col("project_id"))
    roots = p.select("project_id", root.alias("root"), "k", "lang")
    ext = F.element_at(F.array(*[F.lit(s) for s in views.DOC_SUFFIXES[:-1]]),
                       (F.col("k") % (len(views.DOC_SUFFIXES) - 1) + 1).cast("int"))
    new = roots.where(F.col("k") % 4 == 0).select(
        F.concat(F.col("root"), F.lit("/" + NAMES.rule_file)).alias("path"),
        F.concat(F.lit("# project rules\n*"), ext, F.lit("\n"), F.col("lang"), F.lit("/"),
                 (F.col("k") % 3).cast("string"), F.lit("/\n")).alias("text"))
    legacy = roots.where((F.col("k") % 4).isin(0, 1)).select(
        F.concat(F.col("root"), F.lit("/" + NAMES.rule_file_legacy)).alias("path"),
        F.concat(F.lit("*.tmp\n"), F.col("lang"), F.lit("/"), ((F.col("k") + 1) % 3).cast("string"),
                 F.lit("\n")).alias("text"))
    langs = table(spark, sf_dir, "documents").select("lang").distinct().where(F.col("lang").isin("en", "fr"))
    shared = langs.select(
        F.concat(F.lit("/ws/"), F.col("lang"), F.lit("/" + NAMES.rule_file)).alias("path"),
        F.when(F.col("lang") == "en", F.lit("# nothing but comments\n\n   # indented\n"))
         .otherwise(F.lit("*.md\n")).alias("text"))
    return roots.select("project_id", "root"), new.unionByName(legacy).unionByName(shared)
