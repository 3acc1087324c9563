"""``spark.read.format("ctxloom_catalogue")``: the file catalogue as a data source.

``load(base)`` gives what ``files.file_catalogue`` gives without rules: a project
for each child folder of ``base``, and the files directly in it as project ``.``.
A partition is a folder with all below it, or a folder's own entries: the planner
opens folders, widest first, until there are ``partitions`` of them (an option),
and every partition is listed by its task.  Filters on ``project_id`` are pushed
down to the planner (with ``spark.sql.python.filterPushdown.enabled``), so that
other projects are not listed.  Sizes only; no file is opened, no link followed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ctxloom.session import ship_package
from ctxloom.sources.files import entries_of, place_of

SCHEMA = "project_id string, path string, rel_path string, length bigint, is_symlink boolean"
FORMAT = "ctxloom_catalogue"


class Part(InputPartition):
    def __init__(self, project: str, root: str, folder: str, deep: bool):
        super().__init__((project, root, folder, deep))


class CatalogueReader(DataSourceReader):
    def __init__(self, base: str, partitions: int):
        self.base, self.wanted, self.projects = base.rstrip("/") or "/", partitions, None

    def partitions(self) -> list[Part]:
        keep = lambda p: self.projects is None or p in self.projects
        top = entries_of(place_of(self.base, ""))
        todo = deque((name, f"{self.base}/{name}", "") for name, _, is_dir, _ in top if is_dir and keep(name))
        parts = [Part(".", self.base, "", False)] if keep(".") else []
        while todo and len(parts) + len(todo) < self.wanted:
            project, root, folder = todo.popleft()
            parts.append(Part(project, root, folder, False))
            try:
                below = [name for name, _, is_dir, _ in entries_of(place_of(root, folder)) if is_dir]
            except OSError:
                below = []
            todo.extend((project, root, f"{folder}/{name}" if folder else name) for name in below)
        return parts + [Part(*x, True) for x in todo] or [Part(".", self.base, "", False)][:keep(".")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:
            return
        project, root, folder, deep = partition.value
        todo = [folder]
        while todo:
            at = todo.pop()
            try:
                for name, size, is_dir, link in entries_of(place_of(root, at)):
                    rel = f"{at}/{name}" if at else name
                    if not is_dir:
                        yield project, f"{root}/{rel}", rel, size, link
                    elif deep:
                        todo.append(rel)
            except OSError:  # an unreadable folder has no entries
                continue


class PushingReader(CatalogueReader):
    """With filters on the project pushed down; Spark refuses such a reader where that is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and column == ("project_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.projects = names if self.projects is None else self.projects & names
            else:
                yield f


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options["path"], int(self.options.get("partitions", "256")))


class PushingSource(CatalogueSource):
    def reader(self, schema) -> PushingReader:
        return PushingReader(self.options["path"], int(self.options.get("partitions", "256")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session (as it is set up now: with or without pushdown)."""
    ship_package(spark)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(PushingSource if pushes else CatalogueSource)
