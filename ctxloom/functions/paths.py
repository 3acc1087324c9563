"""Path parts (P1, F8, P15) and path prefixes, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.constants import TREE_ROOT_FALLBACK


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def segments(path) -> Column:
    """Path segments: backslashes become slashes, empty segments dropped (F8)."""
    return F.filter(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), lambda s: s != F.lit(""))


def normalize_path(path) -> Column:
    """Segments joined by ``/``: the path as the tree and the rules see it."""
    return F.array_join(segments(path), "/")


def basename(path) -> Column:
    """Last ``/`` piece of the raw path (the tree's file label)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_path(path) -> Column:
    segs = segments(path)
    return F.array_join(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), "/")


def depth(path) -> Column:
    return F.size(segments(path))


def path_prefixes(path) -> Column:
    """``['', s1, s1/s2, ..., full]``: the root, every folder, then the path itself."""
    segs = segments(path)
    return F.transform(F.sequence(F.lit(0), F.size(segs)),
                       lambda i: F.array_join(F.slice(segs, 1, i), "/"))


def dir_prefixes(path) -> Column:
    """Strict ancestors of a file path, root (``''``) first."""
    segs = segments(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(segs) - 1, F.lit(0))),
                       lambda i: F.array_join(F.slice(segs, 1, i), "/"))


def root_label(root_path) -> Column:
    """Tree header name: base folder name, or ``root`` when it has none."""
    name = F.element_at(F.split(F.regexp_replace(_c(root_path), "/+$", ""), "/"), -1)
    name = F.when(name.isin(".", ".."), F.lit("")).otherwise(name)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(TREE_ROOT_FALLBACK))
