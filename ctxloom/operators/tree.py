"""Folder tree over loaded files: nodes (A5), sibling order (L3), rollups
(A2, A3) and the ASCII render (A7, P15).

Recursion becomes explode: every file contributes one row per path prefix,
and the tree questions are joins, windows and grouped sums over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.constants import TREE_BLANK, TREE_BRANCH, TREE_LAST, TREE_PIPE
from ctxloom.functions.paths import basename, root_label, segments
from ctxloom.functions.tokens import file_tokens
from ctxloom.operators.intervals import files_in_order, folder_edges
from ctxloom.session import materialize


def tree_nodes(files: DataFrame) -> DataFrame:
    """Distinct tree nodes ``(project_id, path, parent, name, depth, is_file)``.

    ``is_file`` is part of the key: URL-like data can hold a file and a folder
    of one name.  Files with no path segment are not placed (as in the tool).
    """
    segs = files.select("project_id", segments(F.col("rel_path")).alias("segs"), basename(F.col("rel_path")).alias("raw")).where(F.size("segs") > 0)
    exploded = segs.select(
        "project_id", "segs", "raw",
        F.explode(F.sequence(F.lit(1), F.size("segs"))).alias("depth"))
    nodes = exploded.select(
        "project_id",
        F.array_join(F.slice("segs", 1, F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("segs", 1, F.col("depth") - 1), "/").alias("parent"),
        # a file's label is its raw name behind the last slash, as the tool prints it
        F.when(F.col("depth") == F.size("segs"), F.col("raw")).otherwise(F.element_at("segs", F.col("depth"))).alias("name"),
        "depth",
        (F.col("depth") == F.size("segs")).alias("is_file"),
    )
    return nodes.distinct()


def with_sibling_order(nodes: DataFrame) -> DataFrame:
    """``is_last`` among siblings: folders first, then files, each by name (L3)."""
    w = Window.partitionBy("project_id", "parent").orderBy("is_file", "name")
    return nodes.withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())


def render_lines(files: DataFrame, materialize_nodes: bool = True) -> DataFrame:
    """One row per node: ``(project_id, sort_key, line)``, in tree order when
    sorted by ``sort_key`` (an array of ``(is_file, name)`` along the path).

    The node table is read three times (folders, ancestors, lines), so it is
    written once to the checkpoint folder instead of being recomputed."""
    nodes = with_sibling_order(tree_nodes(files))
    if materialize_nodes:
        nodes = materialize(nodes, "tree-nodes")
    folders = nodes.where(~F.col("is_file")).select(
        "project_id", F.col("path").alias("a_path"), F.col("depth").alias("a_depth"),
        F.col("is_last").alias("a_last"), F.col("name").alias("a_name"))
    # each node's strict ancestors (depth 1 .. depth-1)
    anc = nodes.where(F.col("depth") > 1).select(
        "project_id", "path", "is_file",
        F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("a_depth"))
    anc = anc.withColumn(
        "a_path", F.array_join(F.slice(F.split("path", "/"), 1, F.col("a_depth")), "/"))
    anc = anc.join(folders, ["project_id", "a_path", "a_depth"])
    per_node = anc.groupBy("project_id", "path", "is_file").agg(
        F.array_sort(F.collect_list(F.struct("a_depth", "a_last", "a_name"))).alias("ancestors"))
    lines = nodes.join(per_node, ["project_id", "path", "is_file"], "left")
    ancestors = F.coalesce(F.col("ancestors"), F.array().cast("array<struct<a_depth:int,a_last:boolean,a_name:string>>"))
    prefix = F.array_join(F.transform(ancestors, lambda a: F.when(a["a_last"], F.lit(TREE_BLANK)).otherwise(F.lit(TREE_PIPE))), "")
    connector = F.when(F.col("is_last"), F.lit(TREE_LAST)).otherwise(F.lit(TREE_BRANCH))
    sort_key = F.concat(
        F.transform(ancestors, lambda a: F.struct(F.lit(False).alias("f"), a["a_name"].alias("n"))),
        F.array(F.struct(F.col("is_file").alias("f"), F.col("name").alias("n"))))
    return lines.select("project_id", sort_key.alias("sort_key"),
                        F.concat(prefix, connector, F.col("name")).alias("line"))


def render_tree(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Tree text per project: ``<root>/\\n`` then one line per node.

    ``roots`` maps ``project_id`` to the project's root path; the header is its
    base name, or ``root`` (P15).  Without it the project id is the root.
    The per-project text is bounded by the file limit applied upstream.
    """
    lines = render_lines(files)
    agg = lines.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_key", "line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    projects = files.select("project_id").distinct()
    if roots is None:
        header = root_label(F.col("project_id"))
        base = projects.select("project_id", header.alias("_root"))
    else:
        base = projects.join(roots, "project_id", "left").select(
            "project_id", root_label(F.coalesce(F.col("root"), F.lit("."))).alias("_root"))
    out = base.join(agg, "project_id", "left")
    return out.select("project_id", F.concat(F.col("_root"), F.lit("/\n"), F.coalesce(body, F.lit(""))).alias("tree"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Per folder (root ``''`` included): files, tokens and selected files below
    it (A2, A3).

    A folder is an interval of the files in path order: its sums are the running
    sums where it ends minus those where it begins (``operators.intervals``), so
    what is grouped is two rows a folder, not a row for each file and folder."""
    sel = F.coalesce(F.col("selected"), F.lit(False)) if "selected" in files.columns else F.lit(False)
    toks = F.col("tokens") if "tokens" in files.columns else file_tokens(F.col("length"))
    own = [c for c in ("_key", "_part", "_at", "_dirs") if c in files.columns]
    rows = files_in_order(files.select("project_id", "rel_path", *own, F.lit(1).alias("total"), sel.cast("int").alias("selected"), toks.alias("tokens")))
    edges = folder_edges(rows, ["total", "selected", "tokens"])
    out = edges.groupBy("project_id", "folder").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("total", "selected", "tokens")])
    state = (F.when(F.col("selected") == F.col("total"), F.lit("all"))
             .when(F.col("selected") > 0, F.lit("some")).otherwise(F.lit("none")))
    return out.withColumn("state", state)
