"""One project holding a third of all rows goes through rules, limit, rollup,
tree and document assembly with whole results; its document comes
in chunks."""

from pyspark.sql import functions as F

from ctxloom.functions.globs import compile_rule_lines
from ctxloom.operators import assemble, scan, tree


def test_hot_project_end_to_end(spark):
    hot = [("hot", f"d{i % 7}/f{i:05d}.rs", 40) for i in range(3000)]
    cold = [(f"c{p}", f"x/f{i}.py", 10) for p in range(20) for i in range(300)]
    junk = [("hot", f"d1/g{i}.tmp", 5) for i in range(50)]
    cat = spark.createDataFrame(hot + cold + junk, "project_id string, rel_path string, length long").repartition(16)
    rx = compile_rule_lines(["*.tmp"])
    stats = {r.project_id: r for r in scan.scan_stats(scan.mark_hits(cat, rx), limit=1000).collect()}
    assert (stats["hot"].scanned, stats["hot"].ignored, stats["hot"].loaded, stats["hot"].at_limit) == (3050, 50, 1000, True)
    assert all(stats[f"c{p}"].loaded == 300 for p in range(20))

    loaded = scan.loaded_files(cat, rx, limit=1000)
    hot_loaded = sorted(r.rel_path for r in loaded.where("project_id = 'hot'").collect())
    assert hot_loaded == sorted(p for _, p, _ in hot)[:1000]
    assert loaded.count() == 1000 + 20 * 300

    roll = {r.folder: r.total for r in tree.folder_rollup(loaded.where("project_id = 'hot'")).collect()}
    assert roll[""] == 1000 and sum(v for k, v in roll.items() if k) == 1000

    trees = {r.project_id: r.tree for r in tree.render_tree(loaded).collect()}
    folders = {p.split("/")[0] for p in hot_loaded}
    assert trees["hot"].count("\n") == 1 + len(folders) + 1000 and len(trees) == 21

    projects = loaded.select("project_id").distinct()
    system = projects.select("project_id", F.lit("S").alias("system"))
    files = loaded.select("project_id", "rel_path", F.lit(bytearray(b"x" * 200)).alias("content"))
    frags = assemble.fragments(projects, system, None, trees=tree.render_tree(loaded), files=files)
    rows = {}
    for r in assemble.documents(frags, chunk_bytes=20_000).collect():
        rows.setdefault(r.project_id, {})[r.chunk_no] = r
    whole = {p: "".join(c[k].text for k in range(len(c))) for p, c in rows.items()}
    assert rows["hot"][0].n_chunks == len(rows["hot"]) > 10 and rows["hot"][0].n_fragments == 8 + 1000
    assert all(len(whole[p].encode()) == c[0].n_bytes for p, c in rows.items()) and len(whole) == 21
    assert whole["hot"].count("<file path=") == 1000 and whole["hot"].endswith("</instruction>\n")
