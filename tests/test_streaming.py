"""Streaming = batch (T1-T3), also with the arrival order reversed."""

import uuid

from pyspark.sql import functions as F

from ctxloom.operators import history, updates
from ctxloom.plans.replay import stage_arrivals
from ctxloom.session import scratch_path
from ctxloom.sources import views
from ctxloom.streaming import jobs
from tests.conftest import SF001


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_latest_update_stream_equals_batch(spark):
    upd = views.updates(spark, SF001)
    path = stage_arrivals(upd, "seq", 5, "t-upd")
    got = jobs.latest_content(spark, path, upd.schema)
    assert _same(got.select("url_key", "content", "last_seq", "n_versions"),
                 updates.latest_by_key(upd).select("url_key", "content", "last_seq", "n_versions"))


def test_latest_update_late_files_first(spark):
    # newest event times arrive first: the result must not change
    upd = views.updates(spark, SF001)
    path = scratch_path(spark, "streams", f"rev-{uuid.uuid4().hex[:8]}")
    for i, part in enumerate([upd.where(F.col("seq") % 3 == r) for r in (2, 1, 0)]):
        part.write.mode("append").parquet(path)
    got = jobs.latest_content(spark, path, upd.schema)
    assert _same(got.select("url_key", "content", "last_seq"),
                 updates.latest_by_key(upd).select("url_key", "content", "last_seq"))


def test_repeated_records_leave_one_newest_row(spark):
    upd = views.repeated_updates(spark, SF001)
    want = updates.latest_by_key(upd)
    path = stage_arrivals(upd, "seq", 3, "t-rep")
    assert _same(jobs.latest_content(spark, path, upd.schema, max_files=1), want)
    rows = spark.createDataFrame([("a", "old", 1, 7), ("a", "new", 2, 7), ("a", "new", 2, 7), (None, "x", 1, 1), (None, "y", None, 9), ("b", "p", 3, 3), ("b", "q", 3, 3),
                                  ("c", None, 1, None)], "k string, content string, t long, seq long")
    got = updates.latest_by_key(rows.select("k", "content", F.timestamp_seconds("t").alias("ts"), "seq"), "k").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", "new", 7, 3), ("b", "q", 3, 2), ("c", None, None, 1), (None, "x", 1, 2)]


def test_recent_commands_stream_equals_batch(spark):
    h = views.history(spark, SF001)
    path = stage_arrivals(h, "seq", 4, "t-hist")
    got = jobs.recent_commands(spark, path, h.schema, cap=3)
    want = history.recent_commands(h, cap=3).select("user_id", "rank", "command", "last_seq")
    assert _same(got, want)


def test_empty_input_gives_empty_result(spark):
    upd = views.updates(spark, SF001)
    path = scratch_path(spark, "streams", f"empty-{uuid.uuid4().hex[:8]}")
    upd.limit(0).write.mode("overwrite").parquet(path)
    assert jobs.latest_content(spark, path, upd.schema).count() == 0


def test_history_list_stream_matches_list_model(spark):
    from ctxloom.streaming import history_list
    ev = history_list.history_events(views.history(spark, SF001), views.forgets(spark, SF001))
    path = stage_arrivals(ev, "seq", 4, "t-hl", ordered=True)
    got = {}
    for r in history_list.history_lists(spark, path, ev.schema, cap=5).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.command)
    rows = ev.orderBy("ts", "seq").collect()
    expected = {}
    for r in rows:
        expected[r.user_id] = history_list.apply_events(expected.get(r.user_id, []), [r.kind], [r.command], 5)
    assert {u: v for u, v in expected.items() if v} == got


def test_apply_events_forget_leaves_a_hole():
    from ctxloom.streaming.history_list import apply_events
    lst = apply_events([], ["add"] * 3, ["a", "b", "c"], 2)          # c, b  (a evicted)
    assert lst == ["c", "b"]
    assert apply_events(lst, ["forget"], ["b"], 2) == ["c"]          # a does not come back
    assert apply_events(lst, ["add", "clear", "add"], [" b ", None, "z"], 2) == ["z"]


def test_history_list_ttl(spark):
    from ctxloom.streaming import history_list
    ev = history_list.history_events(views.history(spark, SF001))
    path = stage_arrivals(ev, "seq", 2, "t-hl-ttl", ordered=True)
    plain = history_list.history_lists(spark, path, ev.schema, cap=3)
    long_ttl = history_list.history_lists(spark, path, ev.schema, cap=3, ttl_ms=10 * 365 * 86_400_000)
    assert _same(long_ttl, plain)
    ttl = 6 * 3_600_000
    short = {r.user_id for r in history_list.history_lists(spark, path, ev.schema, cap=3, ttl_ms=ttl).collect()}
    last = {r.user_id: r.t for r in ev.groupBy("user_id").agg(F.max("ts").alias("t")).collect()}
    end = max(last.values())
    import datetime
    kept = {u for u, t in last.items() if end - t <= datetime.timedelta(milliseconds=ttl)}
    assert short == kept and 0 < len(kept) < len(last)


def test_compacted_changelog_reads_the_same(spark):
    h = views.history(spark, SF001)
    path = stage_arrivals(h, "seq", 3, "t-cl")
    agg = jobs.file_stream(spark, path, h.schema, 1).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    log = jobs.run_to_changelog(agg, "t-cl")
    small = jobs.compact(spark, log, ["user_id"], scratch_path(spark, "streams", f"compact-{uuid.uuid4().hex[:8]}"))
    assert _same(jobs.read_latest(spark, log, ["user_id"]), jobs.read_latest(spark, small, ["user_id"]))
    assert spark.read.parquet(small).count() < spark.read.parquet(log).count()
