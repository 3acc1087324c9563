"""Summarise the physical plan of every registered query (PLANS.md).

For each query: parquet scans with their read columns and pushed filters,
shuffles, join strategies, window group limits and Python nodes.  Run after
the query has executed once so AQE shows its final plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    # an executed adaptive plan prints "Final Plan" then "Initial Plan": keep the first
    if "== Initial Plan ==" in plan:
        plan = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan (\w+) \[([^\]]*)\].*?(?:PushedFilters: \[([^\]]*)\])?, ReadSchema", plan)
    return {
        "scans": [(fmt, re.sub(r"#\d+L?", "", cols), re.sub(r"#\d+L?", "", pf or "")) for fmt, cols, pf in scans],
        "shuffles": max(len(re.findall(r"ShuffleQueryStage", plan)),
                        len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))),
        "smj": plan.count("SortMergeJoin"), "bhj": plan.count("BroadcastHashJoin"),
        "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "wgl": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)),
        "codegen": len(re.findall(r"\*\(\d+\)", plan)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    from ctxloom.plans.registry import QUERIES
    from ctxloom.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    lines = [f"# Physical plans ({sf_dir.rsplit('/', 1)[-1]}, final AQE plans)", "",
             "Generated by `python tools/plan_report.py`. Per query: scans (format, columns read, pushed filters), "
             "shuffles, sort-merge / broadcast-hash / nested-loop joins, window group limits, Python nodes, "
             "whole-stage-codegen stages.", "",
             "| Query | Shuffles | SMJ | BHJ | NLJ | WGL | Python | Codegen stages |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    details = []
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        df = fn(spark, sf_dir)
        # run the DataFrame's own physical plan (nothing is collected) so that
        # the adaptive plan is final when printed
        qe = df._jdf.queryExecution()
        qe.executedPlan().execute().count()
        s = summarise(qe.executedPlan().toString())
        lines.append(f"| `{name}` | {s['shuffles']} | {s['smj']} | {s['bhj']} | {s['bnlj']} | {s['wgl']} | {s['python']} | {s['codegen']} |")
        details.append(f"### `{name}`\n")
        for fmt, cols, pf in s["scans"]:
            details.append(f"- {fmt} `[{cols}]`" + (f" pushed: `{pf}`" if pf else ""))
        details.append("")
    with open(out, "w") as f:
        f.write("\n".join(lines + ["", "## Scans", ""] + details) + "\n")
    print("wrote", out)


if __name__ == "__main__":
    main()
