"""Rule files (S3) and nearest-ancestor rule lookup.

The glob compiler runs in tasks over one row per project (a small Python
helper), never per catalogue row.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ctxloom.constants import NAMES, DiskNames
from ctxloom.functions.globs import compile_rule_text
from ctxloom.functions.paths import segments
from ctxloom.operators.intervals import END, SLASH, in_order, inside, last_set, path_key
from ctxloom.session import materialize, ship_package


@lru_cache(maxsize=4096)
def _compiled(text: str) -> str | None:
    return compile_rule_text(text)


@F.pandas_udf(StringType())
def _compile_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _compiled(t))


def compile_project_rules(projects: DataFrame, rule_files: DataFrame | None) -> DataFrame:
    """``(project_id, regex)`` for every project.

    ``rule_files(project_id, text)``: the project's chosen rule file, ``text``
    null when unreadable.  A project without a row (no rule file found) or
    with unreadable text gets the default rules (one literal); a file without
    usable lines gives no rules (``regex`` null).  Texts are compiled in tasks,
    a repeated one once per worker.
    """
    default = F.lit(compile_rule_text(None))
    if rule_files is None:
        return projects.select("project_id", default.alias("regex"))
    ship_package(projects.sparkSession)
    chosen = projects.select("project_id").join(rule_files.select("project_id", "text"), "project_id", "left")
    out = chosen.select("project_id", F.when(F.col("text").isNull(), default).otherwise(_compile_texts("text")).alias("regex"))
    # one narrow row per project, read by the folder and the file match: write once
    return materialize(out, "project-rules")


def ancestors(path_col: str) -> F.Column:
    """A folder and all its ancestors up to ``/``, nearest first, with depth."""
    segs = F.filter(F.split(F.col(path_col), "/"), lambda s: s != F.lit(""))
    return F.transform(
        F.sequence(F.size(segs), F.lit(0), F.lit(-1)),
        lambda i: F.struct(i.alias("depth"),
                           F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, i), "/")).alias("dir")))


def nearest_rule_file(roots: DataFrame, rule_files: DataFrame, names: DiskNames = NAMES) -> DataFrame:
    """Nearest rule file from each project root upward.

    ``roots(project_id, root)``; ``rule_files(path, text)`` with paths like
    ``<dir>/<names.rule_file>`` (preferred at one level) or
    ``<dir>/<names.rule_file_legacy>``.  Result ``(project_id, rule_dir,
    rule_path, text)``, with nulls when nothing is found.

    Roots and rule files are one table in path order, in which a folder comes
    right before all that is below it: a root asks the last rule folder of each
    depth whether it is still open (``operators.intervals``), and takes the
    deepest.  Nothing is joined, so a rule file above very many projects, or one
    at ``/``, is no hot key.
    """
    new, legacy = "/" + names.rule_file, "/" + names.rule_file_legacy
    is_new, path = F.col("path").endswith(new), F.col("path")
    suffix = F.when(is_new, F.lit(len(new))).when(path.endswith(legacy), F.lit(len(legacy)))
    rf = rule_files.select("path", "text", is_new.alias("is_new"), path.substr(F.lit(1), F.char_length("path") - suffix).alias("dir"))
    rf = rf.where(F.col("dir").isNotNull()).withColumn("dir", F.when(F.col("dir") == "", F.lit("/")).otherwise(F.col("dir")))
    rule = F.struct("dir", "path", "text")
    folders = rf.select(path_key(F.lit(""), segments(F.col("dir"))).alias("_key"), F.lit(0).alias("_kind"), is_new.cast("int").alias("_seq"),
                        F.lit(None).cast(roots.schema["project_id"].dataType).alias("project_id"), rule.alias("_rule"))
    asking = roots.select(path_key(F.lit(""), segments(F.col("root"))).alias("_key"), F.lit(1).alias("_kind"), F.lit(0).alias("_seq"),
                          "project_id", F.lit(None).cast(folders.schema["_rule"].dataType).alias("_rule"))
    every = in_order(folders.unionByName(asking), "_kind", "_seq", label="rule-folders")  # of one folder the preferred name comes last
    depth = f"CASE WHEN endswith(_key, '{END}') THEN 0 ELSE size(split(_key, '{SLASH}')) END"
    deepest = every.where("_kind = 0").selectExpr(f"max({depth})").first()[0]
    if deepest is None:
        return roots.select("project_id", *[F.lit(None).cast("string").alias(c) for c in ("rule_dir", "rule_path", "text")])
    levels = {f"_level{d}": f"CASE WHEN _kind = 0 AND {depth} = {d} THEN struct(_key, _rule) END" for d in range(deepest + 1)}
    still = f"filter(array({', '.join(reversed(levels))}), t -> t IS NOT NULL AND {inside('_key', 't._key')})"
    found = last_set(every, levels).where("_kind = 1").selectExpr("project_id", f"get({still}, 0)._rule AS _b")
    return found.selectExpr("project_id", "_b.dir AS rule_dir", "_b.path AS rule_path", "_b.text AS text")
