"""Training corpus pipeline: the stages in order, each over all that the one before kept.

Every stage gets (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and reads it again as the next one's docs.  All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import decontaminate, packing, pii, quality, simhash
from ctxloom.session import ensure_checkpoint_dir, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the n-gram model rejects, go."""
    ensure_checkpoint_dir(spark)
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4-word shingles, at most 4 bits apart) stays."""
    ensure_checkpoint_dir(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    ensure_checkpoint_dir(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes <KIND> in every text; ``n_chars`` follows the text."""
    ensure_checkpoint_dir(spark)
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, in sequences of at most 4096 ids: a row for each piece."""
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), special=True)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("pii_redaction", redact_pii), ("dp_packing", pack_sequences)]

#: The trained models and the tokenizer have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
