"""Folders as intervals: ticks and rollups against plain loops, over many parts and one hot project."""

import random

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import intervals, select, tree

NAMES = ["a", "a-1", "a.b", "a0", "A", "é", "b b", "b", "zz"]


@pytest.fixture
def many_parts(spark):
    """Sorted parts of a few rows each."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _paths(rnd, n):
    return ["/".join(rnd.choices(NAMES, k=rnd.randint(1, 5))) for _ in range(n)]


def _above(path):
    segs = [s for s in path.replace("\\", "/").split("/") if s]
    return ["/".join(segs[:i]) for i in range(len(segs) + 1)]


def plain_ticks(files, actions, saved):
    out = []
    for p, path in files:
        own = _above(path)
        told = [(s, v) for q, folder, v, s in actions if q == p and "/".join(x for x in folder.split("/") if x) in own]
        kept = [(s, v) for q, r, v, s in saved if q == p and _above(r)[-1] == own[-1]]
        out.append((p, path, max(told)[1] if told else max(kept)[1] if kept else False))
    return out


def test_ticks_match_a_plain_loop(spark, many_parts):
    rnd = random.Random(3)
    files, actions, saved = [], [], []
    for p in ("hot", "x", "", "hot2"):
        own = _paths(rnd, 400 if p == "hot" else 25) + (["", "/"] if p == "x" else [])
        files += [(p, f) for f in own] + [(p, own[0])]
        for _ in range(60):
            up = _above(rnd.choice(own))
            actions.append((p, rnd.choice(up), rnd.random() < 0.5, rnd.randint(0, 40)))
        saved += [(p, rnd.choice(own), rnd.random() < 0.5, rnd.randint(0, 5)) for _ in range(40)]
    df = spark.createDataFrame(files, "project_id string, rel_path string").withColumn("n", F.length("rel_path")).repartition(5)
    act = spark.createDataFrame(actions, "project_id string, folder string, value boolean, seq long")
    sav = spark.createDataFrame(saved, "project_id string, rel_path string, selected boolean, seq long")
    got = select.apply_ticks(df, act, sav)
    assert set(got.columns) == {"project_id", "rel_path", "n", "selected"}
    assert sorted((r.project_id, r.rel_path, r.selected) for r in got.collect()) == sorted(plain_ticks(files, actions, saved))
    assert {r.n == len(r.rel_path) for r in got.collect()} == {True}
    none = select.apply_ticks(df.withColumn("selected", F.lit(True)), act.limit(0))
    assert none.count() == len(files) and none.where("selected").count() == len(files)
    assert select.apply_ticks(df.limit(0), act, sav).count() == 0


def test_rollup_matches_a_plain_loop(spark, many_parts):
    rnd = random.Random(4)
    rows = [(p, f, rnd.randint(0, 9), rnd.random() < 0.4) for p in ("hot", "x", None, "") for f in _paths(rnd, 300 if p == "hot" else 20)]
    rows += [("slash", "\\a\\\\b//c", 8, True), ("slash", "/a/b/d", None, False), ("top", "f", 4, None)]
    want = {}
    for p, f, n, s in rows:
        for folder in _above(f)[:-1]:
            t = want.setdefault((p, folder), [0, 0, 0])
            t[0] += 1
            t[1] += bool(s)
            t[2] += -(-(n or 0) // 4)
    df = spark.createDataFrame(rows, "project_id string, rel_path string, length long, selected boolean").repartition(6)
    out = tree.folder_rollup(df).collect()
    assert {(r.project_id, r.folder): [r.total, r.selected, r.tokens] for r in out} == want and len(out) == len(want)
    assert all(r.state == ("all" if r.selected == r.total else "some" if r.selected else "none") for r in out)
    assert tree.folder_rollup(df.limit(0)).count() == 0


def test_a_hot_project_is_spread_and_a_folder_is_two_rows(spark, many_parts):
    hot = spark.range(20_000).selectExpr("'hot' AS project_id", "concat('d', id % 3, '/deep/er/still/e', id % 50, '/f', id) AS rel_path", "id % 7 AS length")
    cold = spark.range(400).selectExpr("concat('c', id % 20) AS project_id", "concat('x/f', id) AS rel_path", "id AS length")
    ordered = intervals.files_in_order(hot.unionByName(cold).withColumn("total", F.lit(1)))
    sizes = [r["count"] for r in ordered.groupBy("_part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * sum(sizes) / len(sizes) + 400
    edges = intervals.folder_edges(ordered, ["total"])
    folders = 1 + 3 * 4 + 150 + 20 * 2
    assert edges.count() == 2 * folders  # not files times depth
    totals = {(r.project_id, r.folder): r.total for r in edges.groupBy("project_id", "folder").agg(F.sum("total").alias("total")).collect()}
    assert totals["hot", ""] == 20_000 and totals["hot", "d0/deep/er/still/e0"] == sum(i % 150 == 0 for i in range(20_000)) and len(totals) == folders
    act = spark.createDataFrame([("hot", "d1", True, 1), ("hot", "d1/deep/er/still/e4", False, 2), ("c3", "", True, 1)], "project_id string, folder string, value boolean, seq long")
    state = select.tick_rows(hot.unionByName(cold), act)
    n = {r.project_id: r.n for r in state.where("selected").groupBy("project_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"hot": sum(i % 3 == 1 and i % 50 != 4 for i in range(20_000)), "c3": 20}
    rolled = tree.folder_rollup(state.withColumn("length", F.lit(4)))
    assert rolled.where("folder = 'd1/deep/er/still/e4'").first().selected == 0 and rolled.where("project_id = 'c3' AND folder = ''").first().state == "all"


def test_nearest_rule_files_match_a_plain_walk(spark, many_parts):
    from ctxloom.constants import NAMES
    from ctxloom.operators.rules import nearest_rule_file
    rnd = random.Random(12)
    roots = [(f"p{i}", "/" + "/".join(rnd.choices(NAMES_UP, k=rnd.randint(0, 6)))) for i in range(300)]
    folders = {""} | {r[:r.rfind("/")] for _, r in rnd.sample(roots, 60)} | {r for _, r in rnd.sample(roots, 40) if r != "/"}
    rules = [(f"{d}/{n}", f"{d}{n}") for d in sorted(folders) for n in (NAMES.rule_file, NAMES.rule_file_legacy) if rnd.random() < 0.6]
    by = dict(rules)

    def walk(root):
        at = root.rstrip("/")
        while True:
            for n in (NAMES.rule_file, NAMES.rule_file_legacy):
                if f"{at}/{n}" in by:
                    return at or "/", f"{at}/{n}", by[f"{at}/{n}"]
            if not at:
                return None, None, None
            at = at[:at.rfind("/")]

    files = spark.createDataFrame(rules, "path string, text string")
    got = nearest_rule_file(spark.createDataFrame(roots, "project_id string, root string"), files).collect()
    assert sorted(map(tuple, got)) == sorted((p, *walk(r)) for p, r in roots)
    none = nearest_rule_file(spark.createDataFrame(roots[:3], "project_id string, root string"), files.limit(0)).collect()
    assert [tuple(r)[1:] for r in none] == [(None, None, None)] * 3


def test_many_roots_below_one_rule_file_are_spread(spark, many_parts, monkeypatch):
    from ctxloom.constants import NAMES
    from ctxloom.operators import rules
    seen = []
    monkeypatch.setattr(rules, "last_set", lambda rows, values: seen.append(rows) or intervals.last_set(rows, values))
    roots = spark.range(100_000).selectExpr("concat('p', id) AS project_id", "concat('/ws/team', id % 7, '/p', id) AS root")
    one = spark.createDataFrame([(f"/{NAMES.rule_file}", "*.top"), (f"/ws/{NAMES.rule_file}", "*.tmp")], "path string, text string")
    out = rules.nearest_rule_file(roots, one)
    assert out.where("rule_dir = '/ws' AND text = '*.tmp'").count() == 100_000
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * 100_000 / len(sizes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "_part" in plan  # parts' borders only, no join on a folder


NAMES_UP = ["a", "a-1", "a.b", "b", "zz"]
