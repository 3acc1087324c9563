"""Rule pruning, counters and limit (F1, F3, A1, L1) against a simulated
walk; tree render (A5, A7, L3) against the recursive renderer; rollups."""

import random


from ctxloom.functions.globs import compile_rule_lines
from ctxloom.operators import scan, tree
from tests.reference_models import counters, tree_text


def _catalogue(spark, projects):
    rows = [(pid, p, len(p) * 10, p in syms) for pid, (paths, syms) in projects.items() for p in paths]
    return spark.createDataFrame(rows, "project_id string, rel_path string, length long, is_symlink boolean")


def _random_paths(rnd, n):
    names = ["a", "b", "src", "build", "x.tmp", "m.rs", "n.py", "lib", "é", "t.lock", "deep"]
    out = set()
    while len(out) < n:
        depth = rnd.randint(1, 4)
        out.add("/".join(rnd.choice(names) + (str(rnd.randint(0, 2)) if i < depth - 1 else "") for i in range(depth)))
    # no path may be both a file and a folder in a real tree
    return sorted(p for p in out if not any(q.startswith(p + "/") for q in out))


def test_counters_match_walk(spark):
    rnd = random.Random(3)
    rule_sets = [["*.tmp", "build0/"], ["src1", "*.lock"], ["lib*/"], ["deep2/b0"], []]
    projects, expected = {}, {}
    for i in range(12):
        paths = _random_paths(rnd, 25)
        syms = {p for p in paths if rnd.random() < 0.1}
        projects[f"p{i}"] = (paths, syms)
    for rules in rule_sets:
        rx = compile_rule_lines(rules)
        for pid, (paths, syms) in projects.items():
            expected[pid] = counters(paths, syms, rx)
        cat = _catalogue(spark, projects)
        marked = scan.mark_hits(cat, rx)
        got = {r.project_id: r for r in scan.scan_stats(marked).collect()}
        loaded = {}
        for r in scan.loaded_files(cat, rx).collect():
            loaded.setdefault(r.project_id, []).append(r.rel_path)
        for pid, e in expected.items():
            g = got[pid]
            assert (g.scanned, g.ignored, g.ignored_dirs, g.symlinks) == \
                (e["scanned"], e["ignored"], e["ignored_dirs"], e["symlinks"]), (rules, pid)
            assert sorted(loaded.get(pid, [])) == e["loaded"]
            assert g.loaded == len(e["loaded"])


def test_star_prunes_root(spark):
    cat = _catalogue(spark, {"p": (["a/b", "c"], set())})
    r = scan.scan_stats(scan.mark_hits(cat, compile_rule_lines(["*"]))).first()
    assert (r.scanned, r.ignored, r.ignored_dirs, r.loaded) == (0, 2, 1, 0)


def test_limit_is_first_by_path_and_flags(spark):
    paths = [f"d/{i:03d}.rs" for i in range(30)]
    cat = _catalogue(spark, {"big": (paths, set()), "small": (paths[:3], set())})
    got = scan.loaded_files(cat, None, limit=10)
    by = {}
    for r in got.collect():
        by.setdefault(r.project_id, []).append(r.rel_path)
    assert sorted(by["big"]) == paths[:10]
    assert sorted(by["small"]) == paths[:3]
    stats = {r.project_id: r for r in scan.scan_stats(scan.mark_hits(cat, None), limit=3).collect()}
    assert stats["small"].at_limit and stats["small"].loaded == 3   # warning fires at exactly the limit
    assert stats["big"].loaded == 3


def test_limit_survives_one_hot_project(spark):
    rows = [("hot", f"f/{i:05d}") for i in range(5000)] + [("cold", "a")]
    df = spark.createDataFrame(rows, "project_id string, rel_path string").repartition(16)
    got = scan.limit_files(df, 100, salt_buckets=8)
    hot = sorted(r.rel_path for r in got.where("project_id = 'hot'").collect())
    assert hot == [f"f/{i:05d}" for i in range(100)]


def test_tree_render_matches_recursive(spark):
    rnd = random.Random(11)
    projects = {f"p{i}": _random_paths(rnd, rnd.randint(1, 30)) for i in range(15)}
    rows = [(pid, p) for pid, ps in projects.items() for p in ps]
    df = spark.createDataFrame(rows, "project_id string, rel_path string")
    got = {r.project_id: r.tree for r in tree.render_tree(df).collect()}
    for pid, ps in projects.items():
        assert got[pid] == tree_text(ps, pid), pid


def test_tree_root_label_and_file_folder_clash(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "a/b"), ("p", "c")], "project_id string, rel_path string")
    roots = spark.createDataFrame([("p", ".")], "project_id string, root string")
    out = tree.render_tree(df, roots).first().tree
    assert out == "root/\n├─ a\n│   └─ b\n├─ a\n└─ c\n"


def test_folder_rollup_and_tristate(spark):
    rows = [("p", "a/x.rs", 8, True), ("p", "a/y.rs", 4, False), ("p", "b/z.rs", 1, True)]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, length long, selected boolean")
    got = {r.folder: (r.total, r.selected, r.tokens, r.state) for r in tree.folder_rollup(df).collect()}
    assert got == {"": (3, 2, 4, "some"), "a": (2, 1, 3, "some"), "b": (1, 1, 1, "all")}


def test_tree_label_is_the_raw_name(spark):
    df = spark.createDataFrame([("p", "a\\b"), ("p", "c/d\\e")], "project_id string, rel_path string")
    assert tree.render_tree(df).first().tree == tree_text(["a\\b", "c/d\\e"], "p")


def test_many_rule_sets_on_one_plan(spark):
    from ctxloom.functions.globs import matches
    from ctxloom.operators import scan as scan_mod
    rnd = random.Random(17)
    projects = {f"p{i:03d}": _random_paths(rnd, 8) for i in range(150)}
    names = ["a", "b", "src", "build", "lib", "deep", "m.rs", "n.py", "x.tmp", "t.lock"]
    rule_of = {p: compile_rule_lines([f"{names[i % len(names)]}{i % 3}", f"*.{['rs', 'py', 'tmp'][i % 3]}", f"q{i}"])
               for i, p in enumerate(sorted(projects))}
    assert len(set(rule_of.values())) > 64
    cat = spark.createDataFrame([(pid, p) for pid, ps in projects.items() for p in ps], "project_id string, rel_path string")
    rules = spark.createDataFrame(list(rule_of.items()), "project_id string, regex string")

    def expected(pid, path):
        parts = path.split("/")
        for i in range(len(parts) + 1):
            pre = "/".join(parts[:i])
            if matches(rule_of[pid], pre):
                return pre
        return None

    want = {(pid, p): expected(pid, p) for pid, ps in projects.items() for p in ps}
    marked = scan_mod.mark_hits(cat, rules)
    assert {(r.project_id, r.rel_path): r.hit for r in marked.collect()} == want

    def shape(df):
        return [line.strip(" +-:").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n")]

    many = spark.range(5000).selectExpr("concat('r', id) AS project_id", "concat('(?s)^(?:x', id, ')\\\\z') AS regex")
    files = spark.range(5000).selectExpr("concat('r', id) AS project_id", "concat('x', id, '/a') AS rel_path")
    assert scan_mod.mark_hits(files, many).where("hit = dir_hit AND hit = concat('x', substr(project_id, 2))").count() == 5000
    few = rules.limit(2)
    assert [x for x in shape(scan_mod.mark_hits(cat, few)) if x == "Join"] == [x for x in shape(scan_mod.mark_hits(files, many)) if x == "Join"]
