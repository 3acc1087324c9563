"""Selection: carry-over across refreshes (J1), folder ticks (J2) and the
selected-file filter (F5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.paths import segments
from ctxloom.operators.intervals import END, SLASH, in_order, inside, last_set, path_key


def carry_over(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Keep the earlier tick by path; new files start unticked.

    Several saved rows of a path count as the one with the largest ``seq``
    (without that column: as ticked when any is)."""
    last = F.max_by("selected", "seq") if "seq" in saved.columns else F.max("selected")
    s = saved.groupBy("project_id", "rel_path").agg(last.alias("_saved"))
    return (files.drop("selected").join(s, ["project_id", "rel_path"], "left")
            .withColumn("selected", F.coalesce(F.col("_saved"), F.lit(False))).drop("_saved"))


def tick_rows(files: DataFrame, actions: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """``apply_ticks`` with the rows in path order (``_key``, ``_part``, ``_at``,
    ``_dirs`` as ``tree.folder_rollup`` takes them)."""
    def rows(df: DataFrame, path: str, kind: int, seq: Column, value: Column, file: Column) -> DataFrame:
        return df.select(path_key(F.col("project_id"), segments(F.col(path))).alias("_key"), F.lit(kind).alias("_kind"), seq.cast("bigint").alias("_seq"),
                         value.alias("_value"), file.alias("_file"))

    file = F.struct(*files.columns)
    none = F.lit(None).cast(files.select(file.alias("f")).schema["f"].dataType)
    base = F.coalesce(F.col("selected"), F.lit(False)) if "selected" in files.columns else F.lit(False)
    every = rows(files, "rel_path", 2, F.lit(0), base, file).unionByName(rows(actions, "folder", 1, F.col("seq"), F.col("value"), none))
    if saved is not None:
        seq = F.col("seq") if "seq" in saved.columns else F.lit(0)
        every = every.unionByName(rows(saved, "rel_path", 0, seq, F.col("selected"), none))
    every = in_order(every.withColumn("_dirs", F.split(F.element_at(F.split("_key", END, 2), 2), SLASH)), "_kind", "_seq", "_value", label="ticks")
    depth = f"CASE WHEN endswith(_key, '{END}') THEN 0 ELSE size(_dirs) END"
    deepest = every.where("_kind = 1").selectExpr(f"max({depth})").first()[0]
    # of each depth the action last seen: open as long as its folder is a prefix
    ticks = {f"_tick{d}": f"CASE WHEN _kind = 1 AND {depth} = {d} THEN struct(_key, _seq, _value) END" for d in range(0 if deepest is None else deepest + 1)}
    carried = last_set(every, ticks | ({} if saved is None else {"_saved": "CASE WHEN _kind = 0 THEN struct(_key, _value) END"})).where("_kind = 2")
    value = "_value" if saved is None else "CASE WHEN _saved._key = _key THEN coalesce(_saved._value, _value) ELSE _value END"
    if ticks:
        still = f"t -> t IS NOT NULL AND {inside('_key', 't._key')}"
        value = f"coalesce(array_max(transform(filter(array({', '.join(ticks)}), {still}), t -> struct(t._seq, t._value)))._value, {value})"
    kept = [F.col("_file")[c].alias(c) for c in files.columns if c != "selected"]
    return carried.select(*kept, F.expr(value).alias("selected"), "_key", "_part", "_at", F.expr("slice(_dirs, 1, greatest(size(_dirs) - 1, 0))").alias("_dirs"))


def apply_ticks(files: DataFrame, actions: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Apply folder/file tick actions; the latest action above a file wins.

    ``actions(project_id, folder, value, seq)``: ``folder = ''`` is clear-all,
    a folder path sets everything below it, a file path sets that file; of
    equal ``seq`` a tick wins over an untick.  ``saved`` are earlier ticks to
    carry over first (J1, as ``carry_over``).  Files, saved ticks and actions
    are one table in path order; an action is an interval of it, and a file
    asks the last action of each depth whether it is still open.  Every row of
    ``files`` comes back, rows that repeat a path each by itself.
    """
    return tick_rows(files, actions, saved).drop("_key", "_part", "_at", "_dirs")


def selected_only(files: DataFrame) -> DataFrame:
    """Ticked files only."""
    return files.where(F.col("selected"))
