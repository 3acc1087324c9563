"""Filesystem sources and sinks.

* ``list_files`` / ``file_catalogue``: every file, folder and link below project
  folders, listed by tasks level by level (Spark's own file listing skips names
  starting with ``.`` or ``_`` and follows links).  Sizes only; no file is opened.
* ``read_capped``: head and tail of files, read by seek; tasks and batches are planned by bytes.
* ``read_small_files``: the tool's own files (rules, configuration, history; see
  ``constants.DiskNames``): candidate paths are a DataFrame and each task reads
  its share with ``pyarrow.fs`` (local, HDFS, S3, GCS URIs).  Missing files give
  ``exists = false``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.constants import MAX_PER_FILE_BYTES, NAMES, SNIFF_BYTES, DiskNames
from ctxloom.operators.intervals import in_order, running
from ctxloom.session import materialize, ship_package

#: Bytes that a task reads, that it hands on at a time, that opening a file counts as, and rows of a listing handed on.
TASK_BYTES, BATCH_BYTES, OPEN_BYTES, LISTING_ROWS = 256 << 20, 64 << 20, 4 << 10, 10_000
SMALL_FILE_SCHEMA = "path string, exists boolean, content binary"


def _strip_scheme(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") and not p.startswith("file://") else p


LISTING_SCHEMA = "project_id string, root string, rel_path string, length long, is_dir boolean, is_symlink boolean"


def entries_of(folder: str) -> Iterator[tuple[str, int, bool, bool]]:
    """(name, size, is a folder, is a link) of what is in a folder; links are not followed."""
    if "://" in folder:
        from pyarrow import fs as pafs

        filesystem, path = pafs.FileSystem.from_uri(folder)
        for i in filesystem.get_file_info(pafs.FileSelector(path)):
            if i.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield i.base_name, i.size or 0, i.type == pafs.FileType.Directory, False
        return
    with os.scandir(folder) as entries:
        for e in entries:
            link = e.is_symlink()
            folder_, file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
            if link or folder_ or file:  # sockets and devices are neither
                yield e.name, e.stat(follow_symlinks=False).st_size if file else 0, folder_ and not link, link


def place_of(root: str, rel: str) -> str:
    """Where an entry below a root is: a local path, or a URI of another store."""
    where = _strip_scheme(root).rstrip("/") + ("/" + rel if rel else "")
    return (where.removeprefix("file://") if where.startswith("file:///") else where) or "/"


def _list_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of folders, links not followed; an unreadable folder has none."""
    columns, rows = ["project_id", "root", "rel_path", "length", "is_dir", "is_symlink"], []
    for pdf in batches:
        for project, root, folder in zip(pdf["project_id"], pdf["root"], pdf["rel_path"]):
            try:
                for name, size, is_dir, link in entries_of(place_of(root, folder)):
                    rows.append((project, root, f"{folder}/{name}" if folder else name, size, is_dir, link))
                    if len(rows) >= LISTING_ROWS:  # a folder of any size is handed on in pieces
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except OSError:
                continue
    yield pd.DataFrame(rows, columns=columns)


def list_roots(spark: SparkSession, base: str) -> DataFrame:
    """``(project_id, root)``: one project per child folder of ``base``."""
    ship_package(spark)
    top = spark.createDataFrame([("", base.rstrip("/") or "/", "")], "project_id string, root string, rel_path string")
    return top.mapInPandas(_list_partition, LISTING_SCHEMA).where("is_dir").select(
        F.col("rel_path").alias("project_id"), F.concat_ws("/", "root", "rel_path").alias("root"))


def list_files(roots: DataFrame, rules=None) -> DataFrame:
    """Every file, folder and link below each ``roots(project_id, root)`` with the
    ignore rules applied: ``(project_id, path, rel_path, length, is_dir,
    is_symlink, hit, dir_hit)``, the shape that ``scan.scan_stats`` and
    ``scan.kept_files`` take.

    Folders are listed by tasks, one level of all projects at a time; the driver
    loops over the depth only.  Rules are tested on an entry's own path, as its
    parents did not match; a folder below a matched one inherits the match and is
    listed without tests, for the count of ignored files.  Links are entries,
    never followed.  A listing opens no file.
    """
    spark = roots.sparkSession
    ship_package(spark)
    levels, one = [], isinstance(rules, str) or rules is None
    level = roots.select("project_id", "root", F.lit("").alias("rel_path"), F.lit(None).cast("string").alias("dir_hit"))
    regex = (lambda d: d.withColumn("_regex", F.lit(rules).cast("string"))) if one else (
        lambda d: d.join(rules.select("project_id", F.col("regex").alias("_regex")), "project_id", "left"))
    # the root itself is tested too: a rule that matches it prunes the project
    level = regex(level).withColumn("dir_hit", F.when(F.expr("regexp_like('', _regex)"), F.lit(""))).drop("_regex")
    seed = level.select("project_id", "root", F.lit("").alias("rel_path"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("is_dir"),
                        F.lit(False).alias("is_symlink"), F.col("dir_hit").alias("hit"), F.lit(None).cast("string").alias("dir_hit"))
    levels.append(seed.where("hit IS NOT NULL"))
    while True:
        folders = level.repartition("project_id", "rel_path")
        found = folders.select("project_id", "root", "rel_path").mapInPandas(_list_partition, LISTING_SCHEMA)
        parent = F.when(F.instr("rel_path", "/") > 0, F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("")
        inherited = level.select("project_id", F.col("rel_path").alias("_parent"), "dir_hit")
        entries = regex(found.withColumn("_parent", parent)).join(inherited, ["project_id", "_parent"])
        own = F.when(F.col("_regex").isNotNull() & (F.regexp_instr("rel_path", F.col("_regex")) > 0), F.col("rel_path"))
        entries = materialize(entries.withColumn("hit", F.coalesce("dir_hit", own)).drop("_parent", "_regex"), "listing")
        levels.append(entries.select("project_id", "root", "rel_path", "length", "is_dir", "is_symlink", "hit", "dir_hit"))
        level = entries.where("is_dir").select("project_id", "root", "rel_path", F.col("hit").alias("dir_hit"))
        if level.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.withColumn("path", F.concat_ws("/", "root", "rel_path")).drop("root")


def file_catalogue(spark: SparkSession, base: str, rules=None) -> DataFrame:
    """Files and links below ``base``, one project per child folder; files
    directly in ``base`` are project ``.``:
    ``(project_id, path, rel_path, length, is_symlink)``, sizes only (S1, S2)."""
    below = list_files(list_roots(spark, base), rules).where("NOT is_dir")
    top = spark.createDataFrame([(".", base.rstrip("/") or "/", "")], "project_id string, root string, rel_path string")
    own = top.mapInPandas(_list_partition, LISTING_SCHEMA).where("NOT is_dir").withColumn("path", F.concat_ws("/", "root", "rel_path"))
    columns = ["project_id", "path", "rel_path", "length", "is_symlink"]
    return below.select(*columns).unionByName(own.select(*columns))


def plan_reads(files: DataFrame, cap: int = MAX_PER_FILE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` in path order, dealt so that a task reads about ``task_bytes``.

    What a file costs is its listed ``length`` up to the cap (the cap where the
    length is not known) and a little for opening it; the running cost over the
    listing says which task reads it.  One project of any size is read by as
    many tasks as it needs, and small ones share a task."""
    length = F.coalesce(F.col("length"), F.lit(cap)) if "length" in files.columns else F.lit(cap)
    cost = (F.least(F.greatest(length, F.lit(0)), F.lit(cap)) + OPEN_BYTES).cast("bigint")
    ordered = in_order(files.withColumn("_key", F.coalesce("path", F.lit(""))).withColumn("_cost", cost), label="reads")
    dealt = running(ordered, ["_cost"], ["path"]).withColumn("_task", F.expr(f"CAST(__cost div {task_bytes} AS INT)"))
    last = ordered.agg(F.sum("_cost")).first()[0]
    return dealt.repartitionById(1 if last is None else int(last // task_bytes) + 1, F.col("_task")).select(*files.columns)


def _capped(path: str | None, cap: int):
    """(size, a function that reads what is shown) of a file, or (None, None)."""
    from pyarrow import fs as pafs

    try:
        p = _strip_scheme(path or "")
        filesystem, place = pafs.FileSystem.from_uri(p) if "://" in p else (pafs.LocalFileSystem(), p)
        f = filesystem.open_input_file(place)
        n = f.size()
    except (OSError, ValueError):
        return None, None

    def read() -> bytes | None:
        try:
            with f:
                if n <= cap:
                    return f.read()
                first = f.read(max(cap // 2, min(SNIFF_BYTES, n)))
                if b"\0" not in first[:SNIFF_BYTES] and cap // 2:
                    f.seek(n - cap // 2)
                    first += f.read(cap // 2)
                return first
        except (OSError, ValueError):
            return None
    return n, read


def _read_capped_batches(batches: Iterator[pa.RecordBatch], at: int, cap: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``n_bytes`` and ``content``; a batch ends before its contents
    would pass ``batch_bytes`` (one larger file is a batch of its own)."""
    for b in batches:
        paths, start, held, sizes, total = b.column(at).to_pylist(), 0, [], [], 0

        def out(end: int) -> pa.RecordBatch:
            own = b.slice(start, end - start)
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], [*b.schema.names, "n_bytes", "content"])

        for i, path in enumerate(paths):
            n, read = _capped(path, cap)
            most = 0 if n is None else min(n, max(cap, SNIFF_BYTES))
            if held and total + most > batch_bytes:
                yield out(i)
                start, held, sizes, total = i, [], [], 0
            data = read() if read else None
            held.append(data)
            sizes.append(None if data is None else n)
            total += len(data or b"")
        if held:
            yield out(len(paths))


def read_capped(files: DataFrame, cap: int = MAX_PER_FILE_BYTES, task_bytes: int = TASK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``files`` (with ``path``, and ``length`` if the listing has it), ``n_bytes``
    and ``content``: the bytes that a document shows, read by seek.

    A file over the cap is read at its head and tail only; its content is head +
    tail with ``n_bytes`` its size, for ``capped_read_text``.  Missing or
    unreadable files have null content.  Reads are planned by bytes
    (``plan_reads``), and a task hands its files on in batches of bounded bytes,
    so neither a project's size nor the number of its files sets what a task
    holds.  The files' columns go with them: content is not joined or shuffled."""
    ship_package(files.sparkSession)
    planned = plan_reads(files, cap, task_bytes)
    at = planned.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_capped_batches(batches, at, cap, batch_bytes)

    schema = planned.withColumns({"n_bytes": F.lit(None).cast("long"), "content": F.lit(None).cast("binary")}).schema
    return planned.mapInArrow(run, schema)


def _read_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    cache: dict = {}  # one filesystem per scheme://authority (namenode, bucket)
    found, total = [], 0
    for pdf in batches:
        for p in pdf["path"]:
            exists, data = False, None
            try:
                if "://" in p:
                    key = "/".join(p.split("/", 3)[:3])
                    if key not in cache:
                        cache[key] = pafs.FileSystem.from_uri(p)[0]
                    filesystem, local = cache[key], pafs.FileSystem.from_uri(p)[1]
                else:
                    filesystem = cache.setdefault("local", pafs.LocalFileSystem())
                    local = _strip_scheme(p)
                if filesystem.get_file_info(local).type == pafs.FileType.File:
                    exists = True
                    with filesystem.open_input_stream(local) as f:
                        data = f.read()
            except (OSError, ValueError):
                data = None  # unreadable: exists as found, no content
            if found and total + len(data or b"") > BATCH_BYTES:
                yield pd.DataFrame(found, columns=["path", "exists", "content"])
                found, total = [], 0
            found.append((p, exists, data))
            total += len(data or b"")
    yield pd.DataFrame(found, columns=["path", "exists", "content"])


def read_small_files(paths: DataFrame) -> DataFrame:
    """``paths(path)`` -> ``(path, exists, content)``; content null when the
    file is missing or unreadable.  For small files (rules, config, history)."""
    ship_package(paths.sparkSession)
    return paths.select("path").distinct().mapInPandas(_read_partition, SMALL_FILE_SCHEMA)


def utf8_text(content) -> F.Column:
    """Text of a file read like ``read_to_string``: null unless valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def rule_file_candidates(roots: DataFrame, names: DiskNames = NAMES) -> DataFrame:
    """Both rule file names in each project root and every folder above (J3 input)."""
    from ctxloom.operators.rules import ancestors
    up = roots.select(F.inline(ancestors("root"))).select("dir").distinct()
    d = F.when(F.col("dir") == "/", F.lit("")).otherwise(F.col("dir"))
    return up.select(F.explode(F.array(F.concat(d, F.lit("/" + names.rule_file)),
                                       F.concat(d, F.lit("/" + names.rule_file_legacy)))).alias("path"))


def rule_files(roots: DataFrame, names: DiskNames = NAMES) -> DataFrame:
    """Existing rule files above the project roots: ``(path, text)``; text
    null when not valid UTF-8 (the tool then uses the default rules)."""
    found = read_small_files(rule_file_candidates(roots, names)).where(F.col("exists"))
    return found.select("path", utf8_text(F.col("content")).alias("text"))


def config_layers(roots: DataFrame, env_path: str | None, default_path: str | None, names: DiskNames = NAMES) -> DataFrame:
    """System text candidates per project (J4 input): project file, then the
    environment override, then the fixed default; ``exists`` apart from ``text``
    (null when missing or unreadable).  The two shared files are read once and
    broadcast as two rows."""
    own = roots.select("project_id", F.lit(0).alias("layer"), F.concat(F.col("root"), F.lit("/" + names.system_file)).alias("path"))
    own = own.join(read_small_files(own.select("path")), "path", "left")
    shared = [(layer, path) for layer, path in ((1, env_path), (2, default_path)) if path]
    out = own.select("project_id", "layer", "path", "exists", "content")
    if shared:
        two = roots.sparkSession.createDataFrame(shared, "layer int, path string")
        two = two.join(read_small_files(two.select("path")), "path", "left").agg(
            F.collect_list(F.struct("layer", "path", "exists", "content")).alias("_two"))  # two rows at most
        out = out.unionByName(roots.select("project_id", F.inline(two.scalar())))
    return out.select("project_id", "layer", "path", F.coalesce("exists", F.lit(False)).alias("exists"),
                      F.when(F.col("exists"), utf8_text(F.col("content"))).alias("text"))


def addons(roots: DataFrame, names: DiskNames = NAMES) -> DataFrame:
    cand = roots.select("project_id", F.concat(F.col("root"), F.lit("/" + names.addon_file)).alias("path"))
    read = read_small_files(cand.select("path")).where(F.col("exists"))
    return cand.join(read, "path").select("project_id", utf8_text(F.col("content")).alias("text")).where(
        F.col("text").isNotNull())


def history_documents(roots: DataFrame, names: DiskNames = NAMES) -> DataFrame:
    """``(project_id, json)`` of each project's saved history (S5 source)."""
    cand = roots.select("project_id", F.concat(F.col("root"), F.lit("/" + names.history_file)).alias("path"))
    read = read_small_files(cand.select("path")).where(F.col("exists"))
    return cand.join(read, "path").select("project_id", utf8_text(F.col("content")).alias("json"))


def write_history(docs: DataFrame, path: str) -> None:
    """Sink (S5): ``(key..., json)`` rows as JSON lines, one object per key."""
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.mode("overwrite").text(path)
