"""T1 and T3 with keyed state: repeated arrivals, time-to-live, restart from the checkpoint."""

import time
import uuid

from pyspark.sql import functions as F

from ctxloom.operators import updates
from ctxloom.plans.replay import stage_arrivals
from ctxloom.session import scratch_path
from ctxloom.sources import views
from ctxloom.streaming import jobs, keyed_state
from tests.conftest import SF001


def _new(spark, label):
    return scratch_path(spark, "streams", f"{label}-{uuid.uuid4().hex[:8]}")


def test_newest_equals_batch(spark):
    upd = views.repeated_updates(spark, SF001)
    path = stage_arrivals(upd, "seq", 2, "t-ks")
    got = keyed_state.latest_content(spark, path, upd.schema, max_files=1)
    want = updates.latest_by_key(upd)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_newest_resumes_and_forgets(spark):
    schema = "url_key string, content string, ts timestamp, seq long"

    def arrive(path, *rows):
        spark.createDataFrame(rows, "url_key string, content string, t long, seq long").select(
            "url_key", "content", F.timestamp_seconds("t").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(path)

    for ttl, kept in ((None, "new"), (400, "late")):
        path, base = _new(spark, "in"), _new(spark, "base")
        arrive(path, ("a", "new", 9, 1), ("b", "x", 1, 1))
        first = keyed_state.latest_content(spark, path, schema, ttl_ms=ttl, base=base).collect()
        assert sorted(tuple(r) for r in first) == [("a", "new", 1, 1), ("b", "x", 1, 1)]
        time.sleep(1.2)
        arrive(path, ("a", "late", 5, 2), ("b", "y", 2, 2))  # older than what was there: passes only if that is forgotten
        again = {r.url_key: (r.content, r.n_versions) for r in keyed_state.latest_content(spark, path, schema, ttl_ms=ttl, base=base).collect()}
        assert again == {"a": (kept, 1 if ttl else 2), "b": ("y", 1 if ttl else 2)}


FILES = "project_id string, rel_path string, length long, selected boolean, n long"


def test_a_file_that_arrives_again_replaces_its_size(spark):
    path, base = _new(spark, "files"), _new(spark, "sizes")

    def arrive(*rows):
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(path)

    def both():
        got = keyed_state.running_estimate(spark, path, FILES, base=base, order="n")
        want = jobs.running_estimate(spark, path, FILES, order="n")
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect()))
        return {r[0]: r[1:3] for r in rows}

    arrive(("p", "a", 40, True, 1), ("p", "b", 8, True, 1), ("p", "c", 400, False, 1), ("q", "a", 4, True, 1))
    assert both() == {"p": (3, 12), "q": (1, 1)}
    arrive(("p", "a", 80, True, 2), ("p", "a", 4, True, 0), ("p", "c", 400, True, 2), ("p", "b", 8, False, 3))  # bigger, late, ticked, unticked
    assert both() == {"p": (3, 120), "q": (1, 1)}
    arrive(("q", "a", 4, True, 1), ("r", "z", 4, True, 1))  # the same again
    assert both() == {"p": (3, 120), "q": (1, 1), "r": (1, 1)}


def test_files_not_seen_for_long_are_taken_out(spark):
    path, base = _new(spark, "files"), _new(spark, "sizes")
    spark.createDataFrame([("p", "a", 40, True, 1), ("q", "b", 8, True, 1)], FILES).coalesce(1).write.mode("append").parquet(path)
    assert keyed_state.running_estimate(spark, path, FILES, ttl_ms=500, base=base).count() == 2
    time.sleep(1.5)
    spark.createDataFrame([("p", "c", 4, True, 2)], FILES).coalesce(1).write.mode("append").parquet(path)
    out = keyed_state.running_estimate(spark, path, FILES, ttl_ms=3_600_000, base=base).collect()
    assert [(r.project_id, r.n_files, r.file_tokens) for r in out] == [("p", 1, 1)]
