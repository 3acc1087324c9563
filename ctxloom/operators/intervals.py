"""Folders as intervals of path order.

Rows of all projects are sorted once by (project, path) over range partitions.
With ``/`` below every other character a folder comes right before all that is
below it, so a folder is an interval of rows, whatever its depth:

* a sum over a folder is the running sum at its end minus the one at its
  beginning; a folder begins where its path is new and ends where the next row
  leaves it, one row each, so no file is spelled out along its depth;
* a value set on a folder holds for the rows behind it until the interval ends:
  of each depth the last value set is remembered, and holds while its path is
  a prefix.

Both go over a sorted part at a time.  What crosses a part's border is one row
a part: the running sums, the row before, and the values last set at each depth.
So a project of any size is spread over as many parts as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.paths import segments
from ctxloom.session import materialize

#: Ends the project in a key; stands for the slash behind a folder.
END, SLASH = "\x00", "\x01"

#: A part's rows up to one, or before it; the parts before one, over one row a part.
_UP_TO = "OVER (PARTITION BY _part ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "OVER (PARTITION BY _part ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PARTS_BEFORE = "OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def path_key(project: Column, segs: Column) -> Column:
    """Key of a path (array of segments): its folders are prefixes of it."""
    return F.concat(F.coalesce(project.cast("string"), F.lit("")), F.lit(END), F.array_join(segs, SLASH))


def inside(key: str, folder: str) -> str:
    """SQL text: ``key`` is the folder, or a path below it."""
    return f"(startswith({key}, {folder}) AND (substring({key}, length({folder}) + 1, 1) IN ('', '{SLASH}') OR endswith({folder}, '{END}')))"


def in_order(rows: DataFrame, *then: str, label: str = "path-order") -> DataFrame:
    """Rows sorted by ``_key`` (and ``then`` within a key), written once, with
    their part ``_part`` and place ``_at``, ascending over all parts."""
    keys = ["_key", *then]
    return materialize(rows.repartitionByRange("_key").sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_part", F.shiftright("_at", 33)), label)


def last_set(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Each value (SQL text) as it was last set (not null) at or before a row, over all parts."""
    if not values:
        return rows
    ends = rows.groupBy("_part").agg(*[F.expr(f"max_by({v}, CASE WHEN {v} IS NOT NULL THEN _at END) AS {n}") for n, v in values.items()])
    before = ends.selectExpr("_part", *[f"last({n}, true) {_PARTS_BEFORE} AS _in{n}" for n in values])
    out = rows.selectExpr("*", *[f"last({v}, true) {_UP_TO} AS {n}" for n, v in values.items()]).join(before, "_part")
    return out.selectExpr(*rows.columns, *[f"coalesce({n}, _in{n}) AS {n}" for n in values])


def running(rows: DataFrame, sums: list[str], tail: list[str]) -> DataFrame:
    """With the sums of columns over all rows before a row (``_<name>``), the
    ``tail`` columns of the row before it (struct ``_prev``, null at the start)
    and whether it is the last row of all (``_final``)."""
    row = f"struct({', '.join(tail)})"
    parts = rows.groupBy("_part").agg(*[F.expr(f"sum({n}) AS {n}") for n in sums], F.expr(f"max_by({row}, _at) AS _tail"), F.expr("max(_at) AS _end"))
    before = parts.selectExpr("_part", *[f"coalesce(sum({n}) {_PARTS_BEFORE}, 0) AS _in_{n}" for n in sums], f"last(_tail) {_PARTS_BEFORE} AS _intail",
                              "lead(1) OVER (ORDER BY _part) IS NULL AS _lastpart", "_end")
    out = rows.selectExpr("*", *[f"sum({n}) {_BEFORE} AS _own_{n}" for n in sums], f"lag({row}) OVER (PARTITION BY _part ORDER BY _at) AS _lag").join(before, "_part")
    return out.selectExpr(*rows.columns, *[f"coalesce(_own_{n}, 0) + _in_{n} AS _{n}" for n in sums], "coalesce(_lag, _intail) AS _prev", "_lastpart AND _at = _end AS _final")


def folder_edges(rows: DataFrame, sums: list[str]) -> DataFrame:
    """One row where a folder begins and one where it ends: ``project_id, folder,
    depth, begins`` and each sum over the rows before, negative at the beginning.

    ``rows`` in order with ``project_id`` and ``_dirs`` (the folders above a row)."""
    shared = ("size(filter(sequence(1, least(size(_dirs), size(_prev._dirs))), i -> slice(_dirs, 1, i) = slice(_prev._dirs, 1, i)))")
    # folders down to this depth (0 is the root) go on; -1: none does
    on = (f"CASE WHEN _prev IS NULL OR NOT (_prev.project_id <=> project_id) THEN -1 WHEN size(_dirs) = 0 OR size(_prev._dirs) = 0 THEN 0 ELSE {shared} END AS _on")

    def edges(project: str, dirs: str, lowest: str, begins: bool, own: bool = False) -> str:
        values = ", ".join(f"'{n}', CAST({'-' if begins else ''}(_{n}{f' + coalesce({n}, 0)' if own else ''}) AS BIGINT)" for n in sums)
        return (f"transform(filter(sequence(0, size({dirs})), d -> d > {lowest}), d -> named_struct('project_id', {project}, "
                f"'folder', array_join(slice({dirs}, 1, d), '/'), 'depth', d, 'begins', {begins}, {values}))")

    end = edges("_prev.project_id", "_prev._dirs", "_on", False)
    close = edges("project_id", "_dirs", "-1", False, own=True)
    return (running(rows, sums, ["project_id", "_dirs"]).selectExpr("*", on)
            .selectExpr(f"inline(concat({edges('project_id', '_dirs', '_on', True)}, CASE WHEN _prev IS NOT NULL THEN {end} ELSE array() END, "
                        f"CASE WHEN _final THEN {close} ELSE array() END))"))


def files_in_order(files: DataFrame) -> DataFrame:
    """Files by path, with ``_dirs``; files that are in order already stay so."""
    if {"_key", "_part", "_at", "_dirs"} <= set(files.columns):
        return files
    segs = F.col("_segs")
    dirs = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    keyed = files.withColumn("_segs", segments(F.col("rel_path"))).select(*files.columns, path_key(F.col("project_id"), segs).alias("_key"), dirs.alias("_dirs"))
    return in_order(keyed, "rel_path")
