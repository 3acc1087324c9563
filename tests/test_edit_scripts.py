"""Scripts of edits: what they do, that they compose, and one user over many tasks."""

import random
import tracemalloc
import types

import pyarrow as pa
import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ctxloom.operators import edit_scripts as es
from ctxloom.operators import history
from ctxloom.streaming.history_list import apply_events
from tests.reference_models import edited_list

KINDS = {es.ADD: "add", es.FORGET: "forget", es.CLEAR: "clear"}
EVENT = st.tuples(st.sampled_from([es.ADD] * 6 + [es.FORGET] * 4 + [es.CLEAR]), st.sampled_from("abcdefgh"))


def timed(events, start=0, step=1):
    return [(k, None if k == es.CLEAR else c, start + step * i, i) for i, (k, c) in enumerate(events)]


def names(entries):
    return [e[0] for e in entries]


@settings(max_examples=400, deadline=None)
@given(st.lists(EVENT, max_size=30), st.lists(EVENT, max_size=30), st.integers(0, 5))
def test_a_script_does_what_its_events_do(before, events, cap):
    old = apply_events([], [KINDS[k] for k, _ in before], [c for _, c in before], cap)
    want = apply_events(old, [KINDS[k] for k, _ in events], [c for _, c in events], cap)
    s = es.script(iter(timed(events)), cap)
    assert names(es.apply_script([(c, 0, 0) for c in old], 0, s, cap)) == want
    assert len(s.front) <= cap and len({c for c, _ in s.touches}) == len(s.touches)


@settings(max_examples=400, deadline=None)
@given(st.lists(EVENT, max_size=40), st.lists(st.integers(0, 40), min_size=2, max_size=2), st.integers(1, 5))
def test_scripts_compose_to_the_script_of_all_events(events, cuts, cap):
    rows = timed(events)
    i, j = sorted(cuts)
    a, b, c = (es.script(iter(x), cap) for x in (rows[:i], rows[i:j], rows[j:]))
    whole = es.script(iter(rows), cap)
    assert es.compose(es.compose(a, b, cap), c, cap) == whole
    assert es.compose(a, es.compose(b, c, cap), cap) == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(EVENT, st.integers(0, 4)), max_size=30), st.integers(0, 30), st.integers(1, 4))
def test_a_gap_longer_than_the_ttl_empties_the_list(events, cut, cap):
    rows, t, want = [], 0, []
    for i, ((k, c), gap) in enumerate(events):
        t += gap
        rows.append((k, None if k == es.CLEAR else c, t, i))
        want = apply_events([] if gap > 2 else want, [KINDS[k]], [c], cap)
    a, b = es.script(iter(rows[:cut]), cap, 2), es.script(iter(rows[cut:]), cap, 2)
    assert names(es.apply_script([], None, es.compose(a, b, cap, 2), cap, 2)) == want
    assert names(es.apply_script(es.apply_script([], None, a, cap, 2), a.last_ts, b, cap, 2)) == want


@pytest.fixture
def many_tasks(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "150"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_users_over_many_tasks(spark, many_tasks):
    rnd = random.Random(8)
    uses, forgets, want = [], [], {}
    for user in range(12):
        events = []
        for seq in range(rnd.choice([1, 3, 40, 600])):
            kind = rnd.choices(["add", "forget", "clear"], [8, 3, 0.05])[0]
            cmd = None if kind == "clear" else f"c{rnd.randint(0, 14)}"
            events.append((kind, cmd))
            (uses if kind == "add" else forgets).append((user, cmd, seq // 3, seq))
        want[user] = edited_list(events, 6)
    schema = "user_id long, command string, ts long, seq long"
    out = history.recent_commands(spark.createDataFrame(uses, schema), 6, spark.createDataFrame(forgets, schema)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.user_id, r.rank)):
        got.setdefault(r.user_id, []).append(r.command)
    assert got == {u: v for u, v in want.items() if v}
    last = {(u, c): s for u, c, _, s in uses}
    assert all(r.last_seq == last[r.user_id, r.command] and r.last_ts == r.last_seq // 3 for r in out)


def test_one_user_of_a_million_events_is_spread(spark, many_tasks, monkeypatch):
    n = 1_000_000
    e = spark.range(n).select(F.lit(7).cast("long").alias("user_id"), F.concat(F.lit("c"), (F.col("id") * 7919 % 1013).cast("string")).alias("command"),
                              F.col("id").alias("ts"), F.col("id").alias("seq"))
    forgotten = F.col("seq") % 5 == 3
    seen = []
    monkeypatch.setattr(es, "materialize", lambda df, label: seen.append((label, df)) or materialize(df, label))
    from ctxloom.session import materialize
    out = history.recent_commands(e.where(~forgotten), 50, e.where(forgotten)).orderBy("rank").collect()
    events = [("forget" if i % 5 == 3 else "add", f"c{i * 7919 % 1013}") for i in range(n - 3000, n)]  # the list turns over many times in 3,000 events
    assert [r.command for r in out] == apply_events([], *zip(*events), 50)
    runs = [df for label, df in seen if label == "edit-scripts"][0]
    assert 140 <= runs.count() <= 150 and [label for label, _ in seen].count("edit-scripts-joined") >= 1


def test_equal_times_are_settled_by_kind_and_command(spark):
    schema = "user_id long, command string, ts long, seq long"
    uses = spark.createDataFrame([(1, "b", 1, 1), (1, "a", 1, 1), (2, "x", 5, 5), (None, "n", 1, 1)], schema)
    out = history.recent_commands(uses, 3, spark.createDataFrame([(2, "x", 5, 5)], schema)).collect()
    assert sorted((r.user_id or 0, r.rank, r.command) for r in out) == [(0, 1, "n"), (1, 1, "b"), (1, 2, "a")]
    plain = history.recent_commands(uses.where("user_id = 1"), 3).orderBy("rank").collect()
    assert [r.command for r in plain] == ["b", "a"]
    assert history.recent_commands(uses.limit(0), 3, uses.limit(0)).count() == 0


class Lists:
    """Stands for the rows of ``applied``: gives back what its tasks run."""
    schema = {"user_id": types.SimpleNamespace(dataType=LongType())}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def traced(batches):
    """Rows that come out, and the MB of Python objects that were held for them (Arrow's own memory apart)."""
    tables = []
    tracemalloc.start()
    for b in batches:
        tables.append(b)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return pa.Table.from_batches(tables), most


def script_rows(users, commands, width):
    found = [es.script(iter([(es.FORGET if j % 5 == 4 else es.ADD, f"u{u} c{j}".ljust(width), j, j) for j in range(commands)]), 50) for u in range(users)]
    old = es._arrays([es.Script(front=[(f"u{u} c{j * 2}".ljust(width), -j, -j) for j in range(50)]) for u in range(users)])[3]
    names = ["user_id", *es._COLUMNS, "old", "old_ts"]
    return pa.RecordBatch.from_arrays([pa.array(range(users), pa.int64()), *es._arrays(found), old, pa.array([0] * users, pa.int64())], names)


@pytest.mark.parametrize("users, commands, width", [(1200, 60, 10), (300, 40, 1000)])
def test_lists_of_a_batch_are_python_objects_a_piece_at_a_time(users, commands, width):
    b = script_rows(users, commands, width)
    out, most = traced(es.applied(Lists(), 50)(iter([b, b.slice(0, 0), b.slice(7, 3)])))
    assert most < 20  # all rows at once: over 50 MB
    want = [[{"command": c, "ts": t, "seq": q} for c, t, q in es.apply_script([tuple(e.values()) for e in r["old"]], 0, es._read(r), 50)] for r in b.to_pylist()]
    assert out.column("entries").to_pylist() == want + want[7:10]
    assert out.column("user_id").to_pylist() == [*range(users), 7, 8, 9] and set(out.column("last_ts").to_pylist()) == {commands - 1}


@pytest.mark.parametrize("piece", [1, es.PIECE])
def test_scripts_leave_a_task_a_piece_at_a_time(monkeypatch, piece):
    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(es, "PIECE", piece)
    rows = [(u, es.ADD, f"u{u} c{j}".ljust(3000), j, j) for u in range(200) for j in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["user_id", "_kind", "command", "ts", "seq"])
    out, most = traced(es._runs(50, None)(iter([batch.slice(i, 1000) for i in range(0, len(rows), 1000)])))
    assert most < 15  # the task's commands are 24 MB
    assert out.column("user_id").to_pylist() == [*range(200)] and set(out.column("_run").to_pylist()) == {3}
    assert out.column("_edge").to_pylist() == [True, *[False] * 198, True]
    assert all([e["command"].strip() for e in r["front"]] == [f"u{r['user_id']} c{j}" for j in reversed(range(40))] for r in out.to_pylist())
