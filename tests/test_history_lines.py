"""History (L4, J6, F9, S5) and head/tail lines."""

import random

from pyspark.sql import functions as F

from ctxloom.operators import history, lines
from tests.reference_models import edited_list, head_tail, last_uses


def test_mru_matches_list_model(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for user in range(6):
        cmds = [rnd.choice(["ls", " ls ", "make", "cargo run", "", "  ", "git status", "make test", "ls -l"])
                for _ in range(rnd.randint(0, 40))]
        for seq, c in enumerate(cmds):
            rows.append((user, c, seq, seq))
        expected[user] = last_uses(cmds, 4)
    df = spark.createDataFrame(rows, "user_id long, command string, ts long, seq long")
    got = {}
    for r in history.recent_commands(df, cap=4).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.command)
    assert {u: v for u, v in expected.items() if v} == got


def test_forget_and_clear(spark):
    uses = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (1, "a", 5, 5), (2, "x", 1, 1), (2, "y", 3, 3)],
                                 "user_id long, command string, ts long, seq long")
    forgets = spark.createDataFrame([(1, "a", 3, 3), (1, "b", 4, 4), (2, None, 2, 2)],
                                    "user_id long, command string, ts long, seq long")
    got = sorted((r.user_id, r.command) for r in history.recent_commands(uses, forgets=forgets).collect())
    assert got == [(1, "a"), (2, "y")]


def test_history_json_round_trip_and_tolerance(spark):
    docs = spark.createDataFrame([
        (1, '{"commands": ["a", 1, {"x": 1}, "b", null], "max": 7}'),
        (2, '{"commands": "nope", "max": -3}'),
        (3, 'not json'),
        (4, '{"max": 2.5}'),
        (5, '{"commands": [], "max": 0}')], "user_id long, json string")
    got = {r.user_id: (r.commands, r.max) for r in history.read_history_json(docs).collect()}
    assert got[1] == (["a", "b"], 7)
    assert got[2] == (None, 50) and got[3] == (None, 50) and got[4] == (None, 50)
    assert got[5] == ([], 0)
    uses = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2)], "user_id long, command string, ts long, seq long")
    js = history.history_json(history.recent_commands(uses)).first().json
    assert js == '{"commands":["b","a"],"max":50}'


def test_head_tail_text_matches_model(spark):
    rnd = random.Random(9)
    texts = ["", "a", "a\n", "a\r\nb\r\n", "\n\n\n"] + [
        "\n".join(str(i) for i in range(rnd.randint(0, 12))) + rnd.choice(["", "\n"]) for _ in range(30)]
    for n, m in [(3, 2), (0, 2), (2, 0), (0, 0)]:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r.i: r.o for r in df.select("i", lines.head_tail_text(F.col("t"), n, m).alias("o")).collect()}
        assert all(got[i] == head_tail(t, n, m) for i, t in enumerate(texts)), (n, m)


def test_exact_list_with_forgets(spark):
    rnd = random.Random(23)
    uses, forgets, expected = [], [], {}
    for user in range(60):
        events = []
        for seq in range(rnd.randint(1, 60)):
            kind = rnd.choices(["add", "forget", "clear"], [8, 3, 0.3])[0]
            cmd = None if kind == "clear" else f"c{rnd.randint(0, 8)}"
            events.append((kind, cmd))
            (uses if kind == "add" else forgets).append((user, cmd, seq, seq))
        expected[user] = edited_list(events, 4)
    schema = "user_id long, command string, ts long, seq long"
    got = {}
    for r in history.recent_commands(spark.createDataFrame(uses, schema), 4, spark.createDataFrame(forgets, schema)).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.command)
    assert got == {u: v for u, v in expected.items() if v}


def test_evicted_command_does_not_come_back(spark):
    schema = "user_id long, command string, ts long, seq long"
    uses = spark.createDataFrame([(1, c, i, i) for i, c in enumerate("abc")], schema)
    forgets = spark.createDataFrame([(1, "b", 9, 9)], schema)
    assert [r.command for r in history.recent_commands(uses, 2, forgets).collect()] == ["c"]


def test_head_tail_rows(spark):
    texts = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(10))), (2, "m0\nm1\nm2\nm3\n"), (3, "")], "key long, text string")
    got = {}
    for r in lines.head_tail_rows(texts, 3, 2).orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append((r.pos, r.line))
    assert got[1] == [*enumerate(["l0", "l1", "l2", "[... output truncated ...]", "l8", "l9"])]
    assert got[2] == [*enumerate(["m0", "m1", "m2", "m3"])] and 3 not in got


def test_head_tail_parts_equal_the_joined_text(spark):
    rnd = random.Random(4)
    rows, whole = [], {}
    for key in range(40):
        parts = ["".join(f"k{key}p{p}l{i}\n" for i in range(rnd.choice([0, 0, 1, 2, 7]))) for p in range(rnd.randint(1, 6))]
        rows += [(key, f"{p:02d}", t) for p, t in enumerate(parts)]
        whole[key] = "".join(parts)
    df = spark.createDataFrame(rows, "key long, part string, text string").repartition(5)
    for n, m in [(3, 2), (0, 2), (2, 0), (1, 1)]:
        got = {}
        for r in lines.head_tail_parts(df, n, m).orderBy("key", "pos").collect():
            assert r.pos == len(got.setdefault(r.key, []))
            got[r.key].append(r.line)
        assert {k: "".join(x + "\n" for x in v) for k, v in got.items()} == {k: head_tail(t, n, m) for k, t in whole.items() if t}, (n, m)


def test_number_lines_across_parts(spark):
    parts = spark.createDataFrame([(1, 2, "c\nd\n"), (1, 0, "a"), (1, 1, ""), (2, 5, "x\r\ny")],
                                  "key long, part long, text string")
    got = sorted((r.key, r.line_no, r.line) for r in lines.number_lines(parts).collect())
    assert got == [(1, 0, "a"), (1, 1, "c"), (1, 2, "d"), (2, 0, "x"), (2, 1, "y")]


def test_number_lines_any_part_type(spark):
    parts = spark.createDataFrame([(1, p, f"l{p}a\nl{p}b") for p in [7, 0, 3, 1, 4, 2]] + [(2, 9, "z")],
                                  "key long, part long, text string").repartition(4)
    want = [(1, 2 * i + j, f"l{p}{'ab'[j]}") for i, p in enumerate([0, 1, 2, 3, 4, 7]) for j in range(2)] + [(2, 0, "z")]
    for df in (parts, parts.withColumn("part", parts["part"].cast("string"))):
        assert sorted((r.key, r.line_no, r.line) for r in lines.number_lines(df).collect()) == sorted(want)
