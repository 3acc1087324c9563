"""Stage and job times from a Spark event log (no UI needed).

Usage: python tools/stage_times.py <event-log-file-or-folder> [top_n]
Prints per job group (description) the number of stages, tasks and the summed
stage time, then the slowest stages.
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def events(path: str):
    """Events of a log file, or of every log under a folder (Spark 4 writes
    rolling logs as ``eventlog_v2_<app>/events_<n>_<app>``)."""
    if os.path.isdir(path):
        files = sorted(os.path.join(root, f) for root, _, fs in os.walk(path) for f in fs
                       if not f.startswith("appstatus") and not f.startswith("."))
    else:
        files = [path]
    for f in files:
        if f.endswith(".zstd"):
            import io

            import zstandard
            with open(f, "rb") as raw:
                fh = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True),
                                      encoding="utf-8")
                for line in fh:
                    yield json.loads(line)
        else:
            with open(f) as fh:
                for line in fh:
                    yield json.loads(line)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stage_job, job_desc, stages = {}, {}, []
    for e in events(path):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (e.get("Properties") or {}).get("spark.job.description") or \
                (e.get("Properties") or {}).get("callSite.short", "?")
            job_desc[e["Job ID"]] = desc
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = e["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                stages.append((info["Completion Time"] - info["Submission Time"], info["Stage ID"],
                               info["Number of Tasks"], info.get("Stage Name", "")))
    by_job = defaultdict(lambda: [0, 0, 0])
    for ms, sid, ntasks, _ in stages:
        d = job_desc.get(stage_job.get(sid), "?")
        by_job[d][0] += 1
        by_job[d][1] += ntasks
        by_job[d][2] += ms
    print(f"{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.1f} s summed stage time")
    for d, (n, t, ms) in sorted(by_job.items(), key=lambda kv: -kv[1][2])[:top]:
        print(f"{ms / 1000:8.2f} s  {n:4d} stages {t:6d} tasks  {d[:80]}")
    print("slowest stages:")
    for ms, sid, ntasks, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms / 1000:8.2f} s  stage {sid:5d} {ntasks:5d} tasks  {name[:70]}")


if __name__ == "__main__":
    main()
