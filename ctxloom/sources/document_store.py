"""Documents kept on disk and brought up to date by what changed.

A store has a folder a version: ``v=N/chunks`` holds the texts that this version
wrote, ``v=N/manifest`` a row for each chunk of every document, with the version
that holds its text (``home``).  Hashes form a tree of two levels: a chunk's is
made of its fragments' places and hashes, a document's of its chunks'.  An update
hashes all fragments (their text is read, nothing of it is shuffled), compares
the chunks' hashes with the last manifest and joins to text only the chunks that
it does not have.  The manifest is written last: a version without it does not
exist for readers, and the next update writes that version anew.

One update at a time.  Chunks are cut at fixed offsets (``assemble.place``), so a
fragment of another size moves those behind it, and a chunk is written again where
one of them crosses a border.  Old versions stay: ``fresh`` writes all chunks into
the new version, after which those before it can go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.operators.assemble import CHUNK_BYTES, DOCUMENT_COLUMNS, joined_text, place
from ctxloom.session import materialize
from ctxloom.sources.snapshot import latest_version

CHUNK = "project_id string, hash string, text string"
MANIFEST = ("project_id string, chunk_no int, hash string, root string, home int, n_chunks int, n_bytes bigint, n_tokens bigint, "
            "n_fragments bigint, at_limit boolean")


def _in_order(*fields: str) -> F.Column:
    """One hash of a group's rows, by their leading fields; the fields stand with their lengths."""
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(*[
        x for f in fields for x in (F.length(r[f].cast("string")), F.lit(":"), r[f].cast("string"))])), ","), 256)


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, of the last one by default; empty without any."""
    v = latest_version(spark, store, "manifest") if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{store}/v={v}/manifest") if v else spark.createDataFrame([], MANIFEST)


def update(frags: DataFrame, store: str, chunk_bytes: int = CHUNK_BYTES, limits: DataFrame | None = None, fresh: bool = False) -> int:
    """Write a new version with the documents of ``frags`` (all their fragments, written
    by the caller); returns how many chunks were joined and written.

    A null text counts as empty.  Documents without fragments any more are gone."""
    spark = frags.sparkSession
    v = latest_version(spark, store, "manifest")
    known = manifest(spark, store, v).groupBy("project_id", "hash").agg(F.min("home").alias("home"))
    text = F.coalesce("text", F.lit(""))
    narrow = materialize(frags.select("project_id", "section", F.coalesce("ord", F.lit("")).alias("ord"), F.octet_length(text).cast("bigint").alias("_n"),
                                      F.sha2(text, 256).alias("_hash")), "fragment-hashes")
    placed, whole = place(narrow.drop("_hash"), chunk_bytes, limits)
    at = ["project_id", "section", "ord"]
    chunk_no = F.coalesce("chunk_no", F.lit(0)).cast("int").alias("chunk_no")
    chunks = (narrow.join(placed.distinct(), at, "left").groupBy("project_id", chunk_no).agg(_in_order("section", "ord", "_hash").alias("hash"))
              .join(known.where(F.lit(not fresh)), ["project_id", "hash"], "left"))
    chunks = materialize(chunks, "chunk-hashes")
    new = chunks.where("home IS NULL").select("project_id", F.col("chunk_no").alias("_chunk"), "hash")
    dealt = frags.withColumn("ord", F.coalesce("ord", F.lit(""))).join(placed.distinct(), at, "left")
    dealt = dealt.withColumn("_chunk", F.coalesce("chunk_no", F.lit(0)).cast("int")).drop("chunk_no")
    texts = dealt.join(new, ["project_id", "_chunk"]).groupBy("project_id", "hash").agg(joined_text().alias("text"))
    texts.write.mode("overwrite").parquet(f"{store}/v={v + 1}/chunks")
    roots = chunks.groupBy("project_id").agg(_in_order("chunk_no", "hash").alias("root"))
    rows = chunks.withColumn("home", F.coalesce("home", F.lit(v + 1))).join(roots, "project_id").join(whole, "project_id")
    rows.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in MANIFEST.split(", ")]).write.mode("overwrite").parquet(
        f"{store}/v={v + 1}/manifest")
    return new.count()


def documents(spark: SparkSession, store: str) -> DataFrame:
    """The last version's documents in chunks, as ``assemble.documents`` gives them."""
    rows = manifest(spark, store)
    texts = spark.createDataFrame([], CHUNK).withColumn("home", F.lit(0))
    for r in rows.select("home").distinct().orderBy("home").collect():  # a row a version
        texts = texts.unionByName(spark.read.schema(CHUNK).parquet(f"{store}/v={r['home']}/chunks").withColumn("home", F.lit(r["home"])))
    return rows.join(texts, ["home", "project_id", "hash"]).select(*DOCUMENT_COLUMNS)


def changed(spark: SparkSession, store: str) -> DataFrame:
    """Documents that differ between the last two versions: ``project_id, change``
    (``new``, ``changed`` or ``gone``), by their roots alone."""
    v = latest_version(spark, store, "manifest")
    now, then = (manifest(spark, store, max(n, 0)).select("project_id", F.col("root").alias(c)).distinct() for n, c in ((v, "now"), (v - 1, "then")))
    out = now.join(then, "project_id", "full").where("NOT now <=> then")
    return out.select("project_id", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("change"))
