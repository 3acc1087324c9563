"""Catalogue snapshots: a refresh that lists only the folders that changed.

A snapshot is two tables under a folder of the shared store, one version after
another: ``folders`` (project_id, root, folder, mtime) and ``entries`` (what was
in them).  A refresh looks at the time of every known folder at once, by tasks,
and lists a folder only if its time is another one; folders found that were not
known are listed next, level by level of what is new.  Entries of unchanged
folders come from the version before, with their sizes looked up again
(``restat``), since writing to a file does not change its folder.

A folder whose time is within ``settle_ms`` of its listing may change again
without another time: it is stored without one and listed next time.  Stores
whose folders have no times (object stores) are listed whole each time.
Folders that are gone, and all that was below them, leave the snapshot.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.session import materialize, ship_package
from ctxloom.sources.files import LISTING_ROWS, entries_of, place_of

FOLDER = "project_id string, root string, folder string, mtime long"
ENTRY = "project_id string, root string, folder string, rel_path string, length long, is_dir boolean, is_symlink boolean"
_FOUND = ENTRY + ", mtime long, listed boolean"


def _look(settle_ms: int):
    """A row for each folder that is there (``rel_path`` null), then its entries if it was listed."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _FOUND.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for project, root, folder, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, now = place_of(root, folder), None
                if "://" not in where:
                    try:  # a root may be a link, a folder below it may not
                        info = os.lstat(where) if folder else os.stat(where)
                    except OSError:
                        continue
                    if not stat.S_ISDIR(info.st_mode):
                        continue
                    now = info.st_mtime_ns
                same = now is not None and known == now
                settled = same or (now is not None and now <= time.time_ns() - settle_ms * 1_000_000)
                try:
                    found = [] if same else entries_of(where)
                    rows.append((project, root, folder, None, None, None, None, now if settled else None, not same))
                    for name, size, is_dir, link in found:
                        rows.append((project, root, folder, f"{folder}/{name}" if folder else name, size, is_dir, link, None, True))
                        if len(rows) >= LISTING_ROWS:
                            yield batch(rows)
                            rows = []
                except OSError:
                    continue
        if rows:
            yield batch(rows)
    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
        out = []
        for root, rel, length, is_dir, link in zip(*(col[c] for c in ("root", "rel_path", "length", "is_dir", "is_symlink")), strict=True):
            try:
                out.append(length if is_dir or link else os.lstat(place_of(root, rel)).st_size)
            except OSError:  # gone since its folder was looked at
                out.append(length)
        at = b.schema.get_field_index("length")
        yield b.set_column(at, b.schema.field(at), pa.array(out, pa.int64()))


def latest_version(spark: SparkSession, store: str, last: str = "entries") -> int:
    """Number of the last whole version (``last`` is the part that is written last); 0 without any."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(store)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(path)]
    whole = [int(n[2:]) for n in names if n.startswith("v=") and system.exists(fs.Path(f"{store}/{n}/{last}/_SUCCESS"))]
    return max(whole, default=0)


def entries(spark: SparkSession, store: str) -> DataFrame:
    """The last version's entries, as ``files.list_files`` gives them without rules."""
    v = latest_version(spark, store)
    out = spark.read.schema(ENTRY).parquet(f"{store}/v={v}/entries") if v else spark.createDataFrame([], ENTRY)
    return out.withColumn("path", F.concat_ws("/", "root", "rel_path")).select("project_id", "path", "rel_path", "length", "is_dir", "is_symlink")


def refresh(roots: DataFrame, store: str, restat: bool = True, settle_ms: int = 2000) -> int:
    """Bring the snapshot in ``store`` up to date for ``roots(project_id, root)``;
    returns the number of folders that were listed."""
    spark = roots.sparkSession
    ship_package(spark)
    v = latest_version(spark, store)
    known = spark.read.schema(FOLDER).parquet(f"{store}/v={v}/folders") if v else spark.createDataFrame([], FOLDER)
    old = spark.read.schema(ENTRY).parquet(f"{store}/v={v}/entries") if v else spark.createDataFrame([], ENTRY)
    places = ["project_id", "root", "folder"]
    wanted = roots.select("project_id", "root")
    level = (known.join(wanted, ["project_id", "root"], "left_semi")
             .unionByName(wanted.withColumn("folder", F.lit("")).withColumn("mtime", F.lit(None).cast("long")).join(known, places, "left_anti")))
    found, listed = [], 0
    while True:
        here = materialize(level.repartition(*places).mapInArrow(_look(settle_ms), _FOUND), "snapshot-level")
        found.append(here)
        listed += here.where("rel_path IS NULL AND listed").count()
        # folders that nobody knew: only below folders that were listed
        inside = here.where("is_dir").select("project_id", "root", F.col("rel_path").alias("folder"))
        level = materialize((inside.join(known, places, "left_anti") if len(found) == 1 else inside).withColumn("mtime", F.lit(None).cast("long")), "snapshot-new")
        if level.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    folders = every.where("rel_path IS NULL")
    kept = old.join(folders.where("NOT listed"), places, "left_semi")
    if restat:
        kept = kept.mapInArrow(_sizes, ENTRY)
    fresh = every.where("rel_path IS NOT NULL").select(*[c.split()[0] for c in ENTRY.split(", ")])
    folders.select(*places, "mtime").write.mode("overwrite").parquet(f"{store}/v={v + 1}/folders")
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{store}/v={v + 1}/entries")  # the last one makes the version whole
    return listed
