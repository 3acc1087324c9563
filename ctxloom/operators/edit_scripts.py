"""Edits of command lists as scripts that compose.

A list is edited by *add* (to the front, no duplicates, at most ``cap``
entries), *forget* and *clear*.  A run of edits is reduced to a script that says
what the run does to any list before it:

* ``front``: what the run itself leaves at the front, newest first (at most ``cap``);
* ``touches``: the commands that it added or forgot, in the order of their first
  time, which leave the list before it then; with each the ``peak``, the most
  commands that stood in front of that list since the touch before;
* ``peak`` after the last touch;
* ``cleared``: nothing of the list before it is left (a clear, or a front that
  filled the list), in which case there are no touches.

An entry is pushed out once the commands in front of it reach ``cap``, and does
not come back when a forget makes room later; the peaks are all that is needed
to tell.  Two scripts compose into one, associatively, so a user's events can be
cut anywhere: into tasks, and into micro-batches.  A script is at most as large
as its run's distinct commands, and mostly not much over ``cap``.

Edits count in the order of (ts, seq); of equal ones adds come first, then
forgets, then clears, each in the order of their commands.  With a time-to-live
a gap longer than it between two events of a user empties the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ctxloom.functions.text import trim_unicode
from ctxloom.session import materialize, ship_package

ADD, FORGET, CLEAR = 0, 1, 2
#: Runs of one user that a task composes at a time.
FAN = 64
#: Bytes of lists that a task has as Python objects at a time, about (one user may have more).
PIECE = 1 << 20
SCRIPT = ("_run long, _edge boolean, cleared boolean, touches array<struct<command:string,peak:int>>, peak int, "
          "front array<struct<command:string,ts:bigint,seq:bigint>>, first_ts bigint, last_ts bigint")
_COLUMNS = ["cleared", "touches", "peak", "front", "first_ts", "last_ts"]


@dataclass
class Script:
    cleared: bool = False
    touches: list[tuple[str, int]] = field(default_factory=list)
    peak: int = 0
    front: list[tuple[str, int, int]] = field(default_factory=list)  # (command, ts, seq), newest first
    first_ts: int | None = None
    last_ts: int | None = None


def script(events: Iterator[tuple[int, str | None, int, int]], cap: int, ttl: int | None = None) -> Script:
    """Script of ordered (kind, command, ts, seq)."""
    out, front, touched = Script(cleared=cap <= 0), {}, set()
    for kind, command, ts, seq in events:
        if out.first_ts is None:
            out.first_ts = ts
        elif ttl is not None and ts - out.last_ts > ttl:
            front, out.cleared = {}, True
        out.last_ts = ts
        if kind == CLEAR:
            front, out.cleared = {}, True
            continue
        if not out.cleared and command not in touched:
            touched.add(command)
            out.touches.append((command, out.peak))
            out.peak = 0
        front.pop(command, None)
        if kind == ADD:
            front[command] = (ts, seq)
            if len(front) > cap:
                del front[next(iter(front))]
        if len(front) >= cap:
            out.cleared = True
        out.peak = max(out.peak, len(front))
    if out.cleared:
        out.touches, out.peak = [], 0
    out.front = [(c, *v) for c, v in reversed(front.items())]
    return out


def _left(entries: list, s: Script, cap: int, on_touch=None) -> list:
    """What ``s`` leaves of the entries before it; ``on_touch(command, most in front)`` sees every stretch."""
    alive, own = list(entries), {e[0] for e in entries}
    for command, peak in s.touches:
        del alive[max(0, cap - peak):]
        if on_touch:
            on_touch(command, peak + len(alive))
        if command in own:
            alive = [e for e in alive if e[0] != command]
    del alive[max(0, cap - s.peak):]
    if on_touch:
        on_touch(None, s.peak + len(alive))
    return alive


def apply_script(entries: list, last_ts: int | None, s: Script, cap: int, ttl: int | None = None) -> list:
    """The list after ``s``."""
    gap = ttl is not None and last_ts is not None and s.first_ts is not None and s.first_ts - last_ts > ttl
    return s.front + ([] if s.cleared or gap else _left(entries, s, cap))


def compose(a: Script, b: Script, cap: int, ttl: int | None = None) -> Script:
    """One script for ``a``, then ``b``."""
    if a.first_ts is None or b.first_ts is None:
        return b if a.first_ts is None else a
    if b.cleared or (ttl is not None and b.first_ts - a.last_ts > ttl):
        return Script(True, [], 0, b.front, a.first_ts, b.last_ts)
    touches, touched, peak = list(a.touches), {c for c, _ in a.touches}, a.peak

    def seen(command: str | None, most: int) -> None:
        nonlocal peak
        peak = max(peak, most)
        if command is not None and command not in touched:
            touched.add(command)
            touches.append((command, peak))
            peak = 0

    front = b.front + _left(a.front, b, cap, seen)
    if a.cleared or peak >= cap or any(p >= cap for _, p in touches):
        return Script(True, [], 0, front, a.first_ts, b.last_ts)
    return Script(False, touches, peak, front, a.first_ts, b.last_ts)


def edits(uses: DataFrame, forgets: DataFrame | None = None) -> DataFrame:
    """``user_id, _kind, command, ts (microseconds or a number), seq`` of uses and
    forgets (``command`` null: all); trimmed, without blank commands (F9)."""
    def moment(df: DataFrame) -> Column:
        kind = df.schema["ts"].dataType
        return F.unix_micros(F.col("ts").cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType)) else F.col("ts").cast("bigint")

    def rows(df: DataFrame, kind: Column) -> DataFrame:
        return df.select("user_id", kind.cast("int").alias("_kind"), trim_unicode(F.col("command")).alias("command"), moment(df).alias("ts"), F.col("seq").cast("bigint").alias("seq"))

    out = rows(uses, F.lit(ADD)).where("command <> ''")
    if forgets is not None:
        out = out.unionByName(rows(forgets, F.when(F.col("command").isNull(), CLEAR).otherwise(FORGET)))
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` halved until a piece has ``PIECE`` bytes at most or is one row."""
    if batch.num_rows > 1 and batch.nbytes > PIECE:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    else:
        yield batch


def _size(s: Script) -> int:
    """About the bytes of a script's row."""
    return sum(len(t[0]) + 16 for t in s.touches) + sum(len(e[0]) + 24 for e in s.front)


def _runs(cap: int, ttl: int | None):
    """Sorted edits of a task to one script a user; the first and the last user may go on in other tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyspark import TaskContext

        part, kind = TaskContext.get().partitionId(), pa.int64()
        users: list = []
        found: list[Script] = []
        held = 0

        def events():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                for p in _pieces(b):
                    yield from zip(*(c.to_pylist() for c in p.columns), strict=True)

        def out(first: bool, last: bool) -> pa.RecordBatch:
            n = len(users)
            edge = [first] + [False] * (n - 1)
            edge[-1] |= last
            return pa.RecordBatch.from_arrays([pa.array(users, kind), pa.array([part] * n, pa.int64()), pa.array(edge), *_arrays(found)], ["user_id", "_run", "_edge", *_COLUMNS])

        first = True
        for user, rows in groupby(events(), key=lambda r: r[0]):
            if len(users) >= 1000 or held > PIECE:
                yield out(first, False)
                first, users, found, held = False, [], [], 0
            users.append(user)
            found.append(script((r[1:] for r in rows), cap, ttl))
            held += _size(found[-1])
        if users:
            yield out(first, True)
    return run


def _arrays(found: list[Script]) -> list[pa.Array]:
    touch = pa.list_(pa.struct([("command", pa.string()), ("peak", pa.int32())]))
    entry = pa.list_(pa.struct([("command", pa.string()), ("ts", pa.int64()), ("seq", pa.int64())]))
    return [pa.array([s.cleared for s in found]), pa.array([[{"command": c, "peak": p} for c, p in s.touches] for s in found], touch),
            pa.array([s.peak for s in found], pa.int32()), pa.array([[{"command": c, "ts": t, "seq": q} for c, t, q in s.front] for s in found], entry),
            pa.array([s.first_ts for s in found], pa.int64()), pa.array([s.last_ts for s in found], pa.int64())]


def _read(row: dict) -> Script:
    return Script(row["cleared"], [(t["command"], t["peak"]) for t in row["touches"]], row["peak"],
                  [(e["command"], e["ts"], e["seq"]) for e in row["front"]], row["first_ts"], row["last_ts"])


def scripts(events: DataFrame, cap: int, ttl: int | None = None) -> DataFrame:
    """One script a user from ``edits``: ``user_id`` and the script's columns.

    The edits are sorted by (user, time) over range partitions, so one user's
    events are spread over as many tasks as they fill.  Only users at a part's
    ends (two a part at most) have several scripts; these are composed, ``FAN``
    at a time.
    """
    spark = events.sparkSession
    ship_package(spark)
    user = f"user_id {events.schema['user_id'].dataType.simpleString()}"
    order = ["user_id", "ts", "seq", "_kind", "command"]
    runs = materialize(events.select("user_id", "_kind", "command", "ts", "seq").repartitionByRange(*order).sortWithinPartitions(*order)
                       .mapInArrow(_runs(cap, ttl), f"{user}, {SCRIPT}"), "edit-scripts")
    whole, parts = runs.where("NOT _edge"), runs.where("_edge")

    def join_up(t: pa.Table) -> pa.Table:
        rows = t.sort_by("_run").to_pylist()
        s = _read(rows[0])
        for r in rows[1:]:
            s = compose(s, _read(r), cap, ttl)
        return pa.table([t.column("user_id").slice(0, 1), pa.array([rows[0]["_run"] // FAN], pa.int64()), pa.array([True]), *_arrays([s])],
                        names=["user_id", "_run", "_edge", *_COLUMNS])

    step = parts.withColumn("_group", F.expr(f"_run div {FAN}"))
    last = parts.agg(F.max("_run")).first()[0]
    while True:  # each round leaves a FANth of a user's scripts
        step = step.groupBy("user_id", "_group").applyInArrow(join_up, f"{user}, {SCRIPT}")
        if last is None or last < FAN:
            break
        last //= FAN
        step = materialize(step.withColumn("_group", F.expr(f"_run div {FAN}")), "edit-scripts-joined")
    return whole.unionByName(step).select("user_id", *_COLUMNS)


def applied(lists: DataFrame, cap: int, ttl: int | None = None) -> DataFrame:
    """``user_id, entries, last_ts`` of rows with a script and what was there
    before (``old`` entries and ``old_ts``, null for a new user)."""
    user = f"user_id {lists.schema['user_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for b in batches for p in _pieces(b)):
            rows = p.to_pylist()
            new = []
            for r in rows:
                old = [(e["command"], e["ts"], e["seq"]) for e in r["old"] or []]
                new.append(Script(front=apply_script(old, r["old_ts"], _read(r), cap, ttl)))
            yield pa.RecordBatch.from_arrays([p.column(0), _arrays(new)[3], p.column("last_ts")], ["user_id", "entries", "last_ts"])

    return lists.select("user_id", *_COLUMNS, "old", "old_ts").mapInArrow(
        run, f"{user}, entries array<struct<command:string,ts:bigint,seq:bigint>>, last_ts bigint")
