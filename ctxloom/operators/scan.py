"""Catalogue pruning by ignore rules (F1, F3), scan statistics (A1) and the
per-project file limit (L1).

The walk of the original tool (prune a folder as soon as it matches) becomes a
column: ``hit`` = the shallowest path prefix (root ``''`` first, then each
folder, then the file itself) that matches the project's rule regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.constants import MAX_FILES
from ctxloom.functions.paths import normalize_path, parent_path, path_prefixes
from ctxloom.session import materialize

# Folders of one rule set that a task matches; a set shared by more (the defaults) is dealt over more tasks.
RULE_FOLDERS = 50_000


def _first_match(prefixes: Column, matcher) -> Column:
    return F.get(F.filter(prefixes, matcher), 0)


def _hits(path: Column, regex: Column) -> Column:
    """Match against a pattern column; Spark keeps the compiled pattern while it repeats."""
    return F.regexp_instr(path, regex) > 0


def mark_hits(files: DataFrame, rules) -> DataFrame:
    """Add ``hit`` (shallowest matching prefix or null) and ``dir_hit`` (the
    same over strict ancestors only, which decides whether a symlink is seen).

    ``rules`` is either one regex string shared by all projects (a literal,
    compiled once per task) or a DataFrame ``(project_id, regex)`` with one
    compiled rule set per project (see ``ctxloom.operators.rules``).
    """
    if rules is None or isinstance(rules, str):
        matcher = (lambda p: F.lit(False)) if rules is None else (lambda p: p.rlike(rules))
        pre = files.withColumn("_prefixes", path_prefixes(F.col("rel_path")))
        out = pre.withColumn("hit", _first_match(F.col("_prefixes"), matcher))
        # dir_hit: the hit when it is a strict ancestor (the file itself excluded)
        out = out.withColumn("dir_hit", F.when(F.col("hit") != F.element_at("_prefixes", -1), F.col("hit")))
        return out.drop("_prefixes")
    return _mark_hits_per_project(files, rules)


def _mark_hits_per_project(files: DataFrame, rules: DataFrame) -> DataFrame:
    """One plan for any number of rule sets: distinct folders first, clustered
    by rule set so that a pattern is compiled once per run of rows, then the
    file's own path for files below unmatched folders only.

    Folders carry the name of their rule set, not its pattern: patterns, one
    row a set (and task), are joined where they are used.  Each set is dealt
    over as many tasks as its folders fill."""
    keyed = files.withColumn("_dir", parent_path(F.col("rel_path"))).withColumn("_path", normalize_path(F.col("rel_path")))
    known = rules.where("regex IS NOT NULL").select("project_id", F.sha2("regex", 256).alias("_set"), F.col("regex").alias("_regex"))
    folders = keyed.select("project_id", "_dir").distinct()
    per_project = folders.groupBy("project_id").agg(F.count("*").alias("_folders"))
    shares = (known.join(per_project, "project_id").groupBy("_set").agg(F.sum("_folders").alias("_folders"), F.any_value("_regex").alias("_regex"))
              .withColumn("_shares", (F.floor(F.col("_folders") / RULE_FOLDERS) + 1).cast("int")))
    shares = materialize(shares.select("_set", "_shares", "_regex"), "rule-sets")  # a row a set: read for its shares and its pattern
    patterns = shares.select("_set", "_regex", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    named = known.select("project_id", "_set").join(shares.select("_set", "_shares"), "_set")
    dealt = folders.join(named, "project_id").withColumn("_share", F.pmod(F.xxhash64("_dir"), F.col("_shares")).cast("int"))
    marked = (dealt.join(patterns, ["_set", "_share"]).sortWithinPartitions("_set")
              .select("project_id", "_dir", "_set", "_shares", _first_match(path_prefixes(F.col("_dir")), lambda p: _hits(p, F.col("_regex"))).alias("dir_hit")))
    # a file's own path is tested below unmatched folders of projects with rules; other files go their way evenly
    out = keyed.join(marked, ["project_id", "_dir"], "left")
    test = F.col("_set").isNotNull() & F.col("dir_hit").isNull() & (F.col("_path") != "")
    out = out.withColumn("_share", F.pmod(F.xxhash64("_path"), F.when(test, F.col("_shares")).otherwise(1 << 16)).cast("int")).withColumn("_set", F.when(test, F.col("_set")).otherwise(""))
    out = out.join(patterns, ["_set", "_share"], "left").sortWithinPartitions("_set")
    return out.withColumn("hit", F.coalesce("dir_hit", F.when(_hits(F.col("_path"), F.col("_regex")), F.col("_path")))).select(*files.columns, "hit", "dir_hit")


def _symlink(df: DataFrame) -> Column:
    """The optional ``is_symlink`` flag (F3); false when the catalogue has none."""
    return F.coalesce(F.col("is_symlink"), F.lit(False)) if "is_symlink" in df.columns else F.lit(False)


def scan_stats(marked: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """Counters per project (A1, F3):

    * ``scanned``: files seen outside pruned folders,
    * ``ignored``: files matching, plus every file under a pruned folder,
    * ``ignored_dirs``: topmost matching folders,
    * ``symlinks``: symlinks seen outside pruned folders,
    * ``loaded``: files kept, ``at_limit``: kept count reached the limit.

    Two aggregation levels: (project, hit) first with map-side partial sums,
    so a project holding a third of all rows is still spread over every task;
    then per project over the few (project, hit) rows.
    """
    sym = _symlink(marked)
    # a listing also has rows for folders (``is_dir``): an ignored one counts even when empty
    folder = F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in marked.columns else F.lit(False)
    file = ~sym & ~folder
    per_hit = marked.withColumn("dir_hit", F.when(folder & ~sym, F.col("hit")).otherwise(F.col("dir_hit"))).groupBy("project_id", "hit", "dir_hit").agg(
        F.count_if(file & (F.col("dir_hit").isNull())).alias("n_scanned"),
        F.count_if(file & F.col("hit").isNotNull()).alias("n_ignored"),
        F.count_if(sym & F.col("dir_hit").isNull()).alias("n_symlinks"),
        F.count_if(file & F.col("hit").isNull()).alias("n_loaded"),
    )
    out = per_hit.groupBy("project_id").agg(
        F.sum("n_scanned").cast("bigint").alias("scanned"),
        F.sum("n_ignored").cast("bigint").alias("ignored"),
        F.count_distinct("dir_hit").cast("bigint").alias("ignored_dirs"),
        F.sum("n_symlinks").cast("bigint").alias("symlinks"),
        F.least(F.sum("n_loaded"), F.lit(limit)).cast("bigint").alias("loaded"),
    )
    return out.withColumn("at_limit", F.col("loaded") >= F.lit(limit))


def kept_files(marked: DataFrame) -> DataFrame:
    """Files that survive the rules and are not symlinks."""
    keep = F.col("hit").isNull() & ~_symlink(marked)
    if "is_dir" in marked.columns:
        keep = keep & ~F.col("is_dir")
    return marked.where(keep).drop("hit", "dir_hit", "is_dir")


def limit_files(files: DataFrame, limit: int = MAX_FILES, salt_buckets: int = 64) -> DataFrame:
    """At most ``limit`` files per project, first by ``rel_path`` (L1).

    Two-stage top-N so that one project holding a third of all rows is never
    sorted by one task: first per (project, salt) with ``salt`` a hash of the
    path, then per project over at most ``limit x salt_buckets`` survivors.
    ``row_number() <= limit`` lets Spark cut each group to ``limit`` rows per
    map task before each shuffle (window group limit); Spark does so only up to
    a threshold of its own, which is raised to the limit in use.
    """
    conf, name = files.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(name)) < limit:
        conf.set(name, str(limit))
    salt = F.pmod(F.xxhash64("rel_path"), F.lit(salt_buckets))
    w1 = Window.partitionBy("project_id", "_salt").orderBy("rel_path")
    stage1 = (files.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
              .where(F.col("_rn") <= limit).drop("_rn", "_salt"))
    w2 = Window.partitionBy("project_id").orderBy("rel_path")
    return stage1.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= limit).drop("_rn")


def loaded_files(catalogue: DataFrame, rules, limit: int = MAX_FILES) -> DataFrame:
    """Rules, then the limit: the files a project loads (refresh, section 3.1)."""
    return limit_files(kept_files(mark_hits(catalogue, rules)), limit)
