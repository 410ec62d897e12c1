"""A corpus pipeline of five stages, each an operator of ``proselab.llm`` on what its predecessor kept.

Quality classifier (documents that it rejects go), exact dedup (one row of equal texts stays), near-dedup (one
document of each class stays), mixing to target weights (documents are taken as often as their source's weight
asks, at least once), and byte-level BPE encoding, whose rows are the result. All stages but the last return
the columns of documents. Every stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.llm import bpe, exact_dedup, mixing, near_dedup, quality
from proselab.llm.common import configure, materialise


def _one_each(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, digest) names, one where rows repeat both, with all columns."""
    ids, digests = (kept[f"`{c}`"] for c in kept.columns)
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(ids) & (digest == digests), "left_semi")
    # rows that repeat both id and text all match the one that stays
    if docs.groupBy("doc_id", digest).count().where("count > 1").isEmpty():
        return rows
    name = "digest of the pipeline"
    return rows.withColumn(name, digest).dropDuplicates(["doc_id", name]).select(*(f"`{c}`" for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on ``docs`` themselves, scores 0.5 or more; empty and null texts go."""
    configure(spark)
    return quality.keep(docs, quality.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id; a null text equals an empty one."""
    configure(spark)
    kept = exact_dedup.classes(docs).where("kept").select("doc_id", "text_sha256").toDF("id that stays", "digest that stays")
    return _one_each(docs, materialise(kept, "kept"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id, which a null one is."""
    configure(spark)
    kept = near_dedup.classes(docs).where("kept").select("doc_id", "print").toDF("id that stays", "digest that stays")
    return _one_each(docs, materialise(kept, "kept"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, and as often as the weight of its source asks; a null source is one of its own."""
    configure(spark)
    return mixing.realise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text has no tokens."""
    import public_tokenizers

    configure(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The classifier and the signatures are not for SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
