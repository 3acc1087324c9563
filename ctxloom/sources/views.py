"""Views over the driver tables in the shapes the operators take.

Each view is a lazy DataFrame derived from the parquet tables, so its work
grows with them.  The definitions are the contract that the DuckDB oracle
queries in ``ctxloom.plans.registry`` restate in SQL (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.constants import FILE_CLASSES, NAMES
from ctxloom.functions.paths import normalize_path
from ctxloom.functions.text import html_to_text
from ctxloom.sources.tables import table

# FIXED VALUES of the fixture layout: every suffix of the file classes, in
# order, then a name without suffix; doc_id % 27 picks one.
DOC_SUFFIXES = [s for _, sufs in FILE_CLASSES for s in sufs] + [""]
N_PROJECT_SLOTS = 20          # pages are spread over projects src0..src19
URL_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
ENV_SYSTEM_FILE, DEFAULT_SYSTEM_FILE = "/etc/ctx/system.txt", "/opt/ctx/config/system.txt"
EPOCH_2024 = 1704067200       # 2024-01-01 00:00:00 UTC


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File catalogue from ``documents``: one project per ``source``.

    ``project_id, rel_path, length, is_symlink, content(binary), doc_id``
    """
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(s) for s in DOC_SUFFIXES]),
                       (F.col("doc_id") % F.lit(len(DOC_SUFFIXES)) + 1).cast("int"))
    rel = F.concat(F.col("lang"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"),
                   F.col("doc_id").cast("string"), ext)
    return d.select(
        F.col("source").alias("project_id"),
        rel.alias("rel_path"),
        F.octet_length("text").cast("bigint").alias("length"),
        (F.col("doc_id") % 101 == 100).alias("is_symlink"),
        F.col("text").cast("binary").alias("content"),
        F.col("doc_id"),
    )


def docs_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` without content: a scan that prunes the text column."""
    return docs(spark, sf_dir).drop("content")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File catalogue from ``pages``: project = URL host, rel_path = URL path
    without query, fragment and empty segments; largest ``page_id`` per path."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", URL_SCHEME + r"([^/?#]*)", 1)
    path = F.regexp_extract("url", URL_SCHEME + r"[^/?#]*([^?#]*)", 1)
    keyed = p.select(host.alias("project_id"), normalize_path(path).alias("rel_path"), "page_id", "html")
    latest = keyed.groupBy("project_id", "rel_path").agg(
        F.max("page_id").alias("page_id"), F.max_by("html", "page_id").alias("html"))
    return latest.select(
        "project_id", "rel_path",
        F.octet_length("html").cast("bigint").alias("length"),
        F.lit(False).alias("is_symlink"),
        F.col("html").cast("binary").alias("content"),
        "page_id",
    )


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved selection: labelled documents, ``selected = quality = 1``."""
    d = docs_meta(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("project_id", "rel_path", (F.col("quality") == 1).alias("selected"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per docs project with its smallest doc id ``k`` and main language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("project_id")).agg(
        F.min("doc_id").alias("k"), F.min_by("lang", "doc_id").alias("lang"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project the ``benchmark`` text with item ``k % n_items``."""
    return _numbered_text(spark, sf_dir, 0)


def instructed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project with its instruction (null where it has none)."""
    return _numbered_text(spark, sf_dir, 0, "left")


def _numbered_text(spark: SparkSession, sf_dir: str, offset: int, how: str = "inner") -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    n_items = b.select(F.count(F.lit(1))).scalar()          # scalar subquery, no join
    p = projects(spark, sf_dir).withColumn("item_id", F.pmod(F.col("k") + F.lit(offset), n_items))
    return p.join(b, "item_id", how).select("project_id", "text")


def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate system text files per project (J4 input).

    ``layer`` 0 = project file, 1 = environment override, 2 = fixed default.
    ``text`` null = the file does not exist.  Project file exists when
    ``k % 3 = 0`` (benchmark item k+1), the environment file when ``k % 3 = 1``
    (item k+2); the default never does, so ``k % 3 = 2`` gets the error text.
    """
    p = projects(spark, sf_dir)
    t1 = _numbered_text(spark, sf_dir, 1).withColumnRenamed("text", "t1")
    t2 = _numbered_text(spark, sf_dir, 2).withColumnRenamed("text", "t2")
    p = p.join(t1, "project_id", "left").join(t2, "project_id", "left")
    root = F.concat(F.lit("/ws/"), F.col("project_id"))
    layers = F.array(
        F.struct(F.lit(0).alias("layer"), F.concat(root, F.lit("/" + NAMES.system_file)).alias("path"),
                 F.when(F.col("k") % 3 == 0, F.col("t1")).alias("text")),
        F.struct(F.lit(1).alias("layer"), F.lit(ENV_SYSTEM_FILE).alias("path"),
                 F.when(F.col("k") % 3 == 1, F.col("t2")).alias("text")),
        F.struct(F.lit(2).alias("layer"), F.lit(DEFAULT_SYSTEM_FILE).alias("path"),
                 F.lit(None).cast("string").alias("text")),
    )
    return p.select("project_id", F.inline(layers)).withColumn("exists", F.col("text").isNotNull())


def addons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project addon text (J5): exists when ``k % 2 = 0``, benchmark item k+3."""
    p = projects(spark, sf_dir).filter(F.col("k") % 2 == 0)
    t3 = _numbered_text(spark, sf_dir, 3)
    return p.join(t3, "project_id").select("project_id", "text")


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote pages per project: ``src<page_id % 20>``, text = HTML to text,
    ``include = page_id % 3 <> 0``."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.concat(F.lit("src"), (F.col("page_id") % N_PROJECT_SLOTS).cast("string")).alias("project_id"),
        "url", html_to_text(F.col("html")).alias("content"), (F.col("page_id") % 3 != 0).alias("include"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command uses from ``events`` (not ``error``): command = type + props."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return e.select("user_id", F.concat_ws(" ", "event_type", "props").alias("command"), "ts",
                    F.col("event_id").alias("seq"))


def forgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forget actions from ``error`` events: forget ``view <props>``."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select("user_id", F.concat_ws(" ", F.lit("view"), "props").alias("command"), "ts",
                    F.col("event_id").alias("seq"))


def raw_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page updates keyed by host and full path, two per page: the raw page and
    its text (``as_text``), with event times that are not in arrival (``seq``)
    order and whose order within a page varies."""
    p = table(spark, sf_dir, "pages")
    key = F.regexp_extract("url", URL_SCHEME + r"([^?#]*)", 1)
    sides = F.array(*[F.struct(F.timestamp_seconds(F.lit(EPOCH_2024) + (F.col("page_id") * step) % 10007).alias("ts"),
                               (2 * F.col("page_id") + number).alias("seq"), F.lit(bool(number)).alias("as_text"))
                      for step, number in ((7919, 0), (6007, 1))])
    return p.select(key.alias("url_key"), "html", F.inline(sides))


def update_content() -> Column:
    """Content of a ``raw_updates`` row."""
    return F.when(F.col("as_text"), html_to_text(F.col("html"))).otherwise(F.col("html"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_updates`` with their content: ``url_key, content, ts, seq``."""
    return raw_updates(spark, sf_dir).select("url_key", update_content().alias("content"), "ts", "seq")


def repeated_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates as an unreliable channel delivers them: keyed by host (none for
    every 41st page), sequence numbers that pages share, times of which a few
    are missing, every seventh record delivered twice."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    host = F.regexp_extract("url", URL_SCHEME + r"([^/?#]*)", 1)
    one = p.select(F.when(k % 41 != 0, host).alias("url_key"), F.concat("url", F.lit(" "), F.col("html")).alias("content"),
                   F.when(k % 13 != 0, F.timestamp_seconds(F.lit(EPOCH_2024) + k * 7919 % 5)).alias("ts"), (k % 50).alias("seq"),
                   F.array_repeat(F.lit(0), F.when(k % 7 == 0, 2).otherwise(1)).alias("copies"))
    return one.withColumn("copy", F.explode("copies")).drop("copy", "copies")


def folder_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder and file ticks derived from ``labels`` (J2 input).

    Every labelled document ticks its parent folder with ``quality = 1`` at
    ``seq = doc_id``; toxic documents then untick their own file at
    ``seq = 10^9 + doc_id``.
    """
    d = docs_meta(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    folder = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    fold = j.select("project_id", folder.alias("folder"), (F.col("quality") == 1).alias("value"),
                    F.col("doc_id").alias("seq"))
    files = j.filter(F.col("toxic") == 1).select("project_id", F.col("rel_path").alias("folder"),
                                                  F.lit(False).alias("value"),
                                                  (F.lit(1_000_000_000) + F.col("doc_id")).alias("seq"))
    return fold.unionByName(files)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents.text`` as lines: ``key, line_no, line``."""
    from ctxloom.functions.text import rust_lines
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("key"), F.posexplode(rust_lines(F.col("text"))).alias("line_no", "line"))
