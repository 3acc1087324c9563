"""Catalogue as a data source, and refreshes that list only what changed."""

import os
import shutil
import tempfile

from ctxloom.sources import datasource, files, snapshot


def _write(path, n):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * n)


def _tree():
    ws = tempfile.mkdtemp(prefix="ws-")
    for p in range(3):
        for d in ("src", "src/deep", "src/deep/er", "_pkg", ".hidden"):
            for i in range(4):
                _write(f"{ws}/p{p}/{d}/f{i}.rs", 10 * i + p)
    os.makedirs(f"{ws}/p0/empty")
    _write(f"{ws}/top.txt", 5)
    os.symlink("src", f"{ws}/p1/link")
    os.symlink("nowhere", f"{ws}/p1/src/broken")
    _settle(ws)
    return ws


def _settle(ws):
    """Folders look as if they had been left alone for a while."""
    for at, _, _ in os.walk(ws):
        _older(at)


def _older(*folders):
    for at in folders:
        t = os.stat(at).st_mtime_ns
        os.utime(at, ns=(t, t - 10_000_000_000))


def _rows(df):
    return sorted(map(tuple, df.select("project_id", "path", "rel_path", "length", "is_symlink").collect()))


def test_format_equals_the_catalogue(spark):
    ws = _tree()
    datasource.register(spark)
    want = _rows(files.file_catalogue(spark, ws))
    for partitions in (1, 4, 1000):
        got = spark.read.format(datasource.FORMAT).option("partitions", partitions).load(ws)
        assert _rows(got) == want
    many = spark.read.format(datasource.FORMAT).option("partitions", 12).load(ws)
    assert many.rdd.getNumPartitions() >= 12
    one = spark.read.format(datasource.FORMAT).load(ws).where("project_id = 'p1' AND length > 11")
    assert _rows(one) == [r for r in want if r[0] == "p1" and r[3] > 11]
    reader = datasource.PushingReader(ws, 1000)
    assert list(reader.pushFilters([datasource.EqualTo(("project_id",), "p1"), datasource.EqualTo(("length",), 3)])) == [datasource.EqualTo(("length",), 3)]
    assert {p.value[0] for p in reader.partitions()} == {"p1"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        datasource.register(spark)
        assert _rows(spark.read.format(datasource.FORMAT).load(ws)) == want
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_refresh_lists_changed_folders_only(spark):
    ws, store = _tree(), tempfile.mkdtemp(prefix="snap-") + "/s"
    roots = files.list_roots(spark, ws)

    def same():
        want = files.list_files(roots).where("NOT is_dir")
        assert _rows(snapshot.entries(spark, store).where("NOT is_dir")) == _rows(want)

    everything = snapshot.refresh(roots, store)
    assert everything == 3 * 6 + 1  # 3 projects with 5 folders, and an empty one
    same()
    assert snapshot.refresh(roots, store) == 0
    same()
    _write(f"{ws}/p0/src/deep/new.rs", 7)            # one folder changes
    _write(f"{ws}/p2/src/f1.rs", 99)                  # a file grows: its folder does not
    _older(f"{ws}/p0/src/deep")
    assert snapshot.refresh(roots, store) == 1
    same()
    _write(f"{ws}/p1/fresh/a/b/c.rs", 3)              # new folders: their parent and themselves
    shutil.rmtree(f"{ws}/p2/src/deep")                # a subtree goes: its parent is listed
    os.remove(f"{ws}/p0/_pkg/f0.rs")
    _settle(ws + "/p1/fresh")
    _older(f"{ws}/p1", f"{ws}/p2/src", f"{ws}/p0/_pkg")
    assert snapshot.refresh(roots, store) == 1 + 3 + 1 + 1
    same()
    assert snapshot.refresh(roots, store) == 0 and snapshot.latest_version(spark, store) == 5


def test_a_folder_that_may_still_change_is_listed_again(spark):
    ws, store = _tree(), tempfile.mkdtemp(prefix="snap-") + "/s"
    roots = files.list_roots(spark, ws).where("project_id = 'p0'")
    snapshot.refresh(roots, store)
    _write(f"{ws}/p0/src/now.rs", 1)
    assert snapshot.refresh(roots, store, settle_ms=3_600_000) == 1
    assert snapshot.refresh(roots, store, settle_ms=3_600_000) == 1   # its time is too fresh to be trusted
    assert snapshot.refresh(roots, store, settle_ms=0) == 1 and snapshot.refresh(roots, store, settle_ms=0) == 0
