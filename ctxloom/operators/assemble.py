"""Context-document assembly.

The primary result is the fragment table ``(project_id, section, ord, text)``;
sorting by ``(section, ord)`` gives the document.  ``documents`` joins fragments
to text in ordered chunks, so a document of any size is whole and no task or row
holds more than a chunk and one fragment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom import constants as K
from ctxloom.functions.text import cdata_wrap, escape_xml_attr
from ctxloom.functions.tokens import document_tokens
from ctxloom.operators.content import capped_text
from ctxloom.session import materialize

CHUNK_BYTES = 64 * 1024 * 1024

DOCUMENT_COLUMNS = ("project_id", "chunk_no", "n_chunks", "n_bytes", "n_tokens", "n_fragments", "at_limit", "text")
FRAGMENT_SCHEMA = "project_id string, section int, ord string, text string"


def _frag(section: int, text) -> F.Column:
    return F.struct(F.lit(section).alias("section"), F.lit("").alias("ord"), text.alias("text"))


def fragments(projects: DataFrame, system: DataFrame, instructions: DataFrame | None, trees: DataFrame,
              files: DataFrame, terminal: DataFrame | None = None, cap: int = K.MAX_PER_FILE_BYTES,
              emit_tree: bool = True, emit_remotes: DataFrame | None = None, words: K.Wording = K.WORDS) -> DataFrame:
    """Ordered document pieces.

    * ``projects(project_id)``: every project that gets a document;
    * ``system(project_id, system)``; ``instructions(project_id, text)``;
    * ``trees(project_id, tree)``: the rendered tree of all loaded files;
    * ``files(project_id, rel_path, content binary)``: selected files;
    * ``terminal(project_id, command, output)``: last command and its output.
    Missing parts are empty strings.  ``emit_tree=False`` leaves the tree section
    out; ``emit_remotes(project_id, url, content, include)`` adds the included
    remote pages behind the files (the original never writes either choice).
    ``words`` names the system text's tag.
    """
    p = projects.select("project_id").join(system.select("project_id", "system"), "project_id", "left")
    if instructions is not None:
        p = p.join(instructions.select("project_id", F.col("text").alias("_instr")), "project_id", "left")
    else:
        p = p.withColumn("_instr", F.lit(None).cast("string"))
    p = p.join(trees.select("project_id", "tree"), "project_id", "left")
    if terminal is not None:
        p = p.join(terminal.select("project_id", "command", "output"), "project_id", "left")
    else:
        p = p.withColumn("command", F.lit(None).cast("string")).withColumn("output", F.lit(None).cast("string"))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    instr = F.concat(F.lit(K.TAG_INSTRUCTION_OPEN), cdata_wrap(e("_instr")), F.lit(K.TAG_INSTRUCTION_CLOSE))
    pieces = F.array(
        _frag(1, F.concat(F.lit(words.system_open), cdata_wrap(e("system")), F.lit(words.system_close))),
        _frag(2, instr),
        _frag(3, F.concat(F.lit(K.TAG_TREE_OPEN), cdata_wrap(e("tree")), F.lit(K.TAG_TREE_CLOSE))),
        _frag(4, F.lit(K.TAG_CODE_OPEN)),
        _frag(6, F.lit(K.TAG_CODE_CLOSE)),
        _frag(7, F.concat(F.lit(K.TAG_COMMAND_OPEN), cdata_wrap(e("command")), F.lit(K.TAG_COMMAND_CLOSE))),
        _frag(8, F.concat(F.lit(K.TAG_OUTPUT_OPEN), cdata_wrap(e("output")), F.lit(K.TAG_OUTPUT_CLOSE))),
        _frag(9, instr),
    )
    fixed = p.select("project_id", F.inline(pieces))
    if not emit_tree:
        fixed = fixed.where(F.col("section") != 3)
    file_frags = files.select(
        "project_id", F.lit(5).alias("section"), F.col("rel_path").alias("ord"),
        F.concat(F.lit(K.TAG_FILE_OPEN), escape_xml_attr(F.col("rel_path")), F.lit('">'),
                 cdata_wrap(capped_text(F.col("content"), cap)), F.lit(K.TAG_FILE_CLOSE)).alias("text"))
    out = fixed.unionByName(file_frags)
    if emit_remotes is not None:
        out = out.unionByName(emit_remotes.where(F.col("include")).select(
            "project_id", F.lit(5).alias("section"), F.concat(F.lit("\U0010FFFF"), F.col("url")).alias("ord"),
            F.concat(F.lit(K.TAG_FILE_OPEN), escape_xml_attr(F.col("url")), F.lit('">'),
                     cdata_wrap(F.coalesce("content", F.lit(""))), F.lit(K.TAG_FILE_CLOSE)).alias("text")))
    return out


def documents(frags: DataFrame, chunk_bytes: int = CHUNK_BYTES, limits: DataFrame | None = None) -> DataFrame:
    """Documents in ordered chunks: ``(project_id, chunk_no, n_chunks, n_bytes,
    n_tokens, n_fragments, at_limit, text)``; the texts of a project in chunk
    order are its document, whatever its size.

    ``n_bytes``, ``n_tokens`` (bytes div 3, P5) and ``n_fragments`` are the whole
    document's.  ``limits(project_id, at_limit)`` says which projects the file
    limit cut (L1).  A fragment belongs to the chunk in which it starts; the
    running offset is over narrow rows, so text meets only the tasks of its own
    chunk.  Callers that reuse ``frags`` should write it first.
    """
    placed, whole = place(frags.select("project_id", "section", "ord", F.octet_length("text").cast("bigint").alias("_n")), chunk_bytes, limits)
    out = (frags.join(placed, ["project_id", "section", "ord"], "left")
           .groupBy("project_id", F.coalesce("chunk_no", F.lit(0)).cast("int").alias("chunk_no")).agg(joined_text().alias("text"))
           .join(whole, "project_id"))
    return out.select(*DOCUMENT_COLUMNS)


def joined_text() -> F.Column:
    """A group's fragments in document order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "text"))), lambda x: x["text"]), "")


def place(narrow: DataFrame, chunk_bytes: int, limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``(project_id, section, ord, _n bytes)``: the chunk number of each
    fragment of documents above a chunk (others are chunk 0), and a row a document
    (``n_chunks, n_bytes, n_tokens, n_fragments, at_limit``); both are written."""
    sizes = narrow.groupBy("project_id").agg(F.sum("_n").alias("n_bytes"), F.count(F.lit(1)).alias("n_fragments"))
    # only documents above a chunk need offsets; written, so that Spark knows how small they are
    large = narrow.join(sizes.where(F.col("n_bytes") > chunk_bytes).select("project_id"), "project_id", "left_semi")
    order = Window.partitionBy("project_id").orderBy("section", "ord")
    start = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = large.withColumn("_slot", F.floor(start / F.lit(chunk_bytes)))
    placed = materialize(slots.select("project_id", "section", "ord", (
        F.dense_rank().over(Window.partitionBy("project_id").orderBy("_slot")) - 1).alias("chunk_no")), "chunks")
    whole = sizes.join(placed.groupBy("project_id").agg((F.max("chunk_no") + 1).alias("n_chunks")), "project_id", "left")
    whole = whole.withColumn("at_limit", F.lit(None).cast("boolean")) if limits is None else whole.join(
        limits.select("project_id", "at_limit"), "project_id", "left")
    whole = whole.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)).cast("int")).withColumn("n_tokens", document_tokens(F.col("n_bytes")))
    return placed, materialize(whole, "document-sizes")


def write_fragments(frags: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink (S6): fragments in document order, cut into files by range, so a large
    project spans as many files as it needs."""
    (frags.repartitionByRange("project_id", "section", "ord").sortWithinPartitions("project_id", "section", "ord")
     .write.mode(mode).parquet(path))
