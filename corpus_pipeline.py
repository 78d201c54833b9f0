"""The corpus pipeline: toxic documents, recurring lines, near duplicates and benchmark leaks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm.common import removed, written
from cohortspark.llm.nearjoin import near_classes
from cohortspark.llm.packing import pack
from cohortspark.llm.queries import table, tokenizer
from cohortspark.llm.templates import without_repeats
from cohortspark.llm.tiling import decontaminated
from cohortspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, each row by its own text.

    Null and empty texts score 0 and stay; repeated rows go or stay together; a null doc_id is scored like others; an
    empty table stays empty; all columns stay, whatever their names.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Templates that recur across documents are dropped from all but the first; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are; of repeated rows and of documents that lose most of their words the first stays;
    an empty table stays empty; other columns stay, whatever their names.
    """
    kept = without_repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one of the least doc_id, a null one last.

    A row is known by a 64-bit hash of its doc_id and text, so rows of one doc_id or of none with different texts are told
    apart, and rows that repeat both stay once. Null texts and texts without words are near nothing and stay. An empty
    table stays empty; all columns stay, whatever their names.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    named = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    classes = near_classes(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "class_id").distinct()
    owners = named.select(row, F.col("doc_id").alias("owner")).distinct()
    first = F.min(F.struct(F.col("owner").isNull().alias("none"), "owner", row))
    stays = owners.join(classes, row).groupBy("class_id").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return named.join(stays, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; an empty table stays empty; all columns
    stay, whatever their names.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences, a row per piece.

    Null and empty texts are documents of their end alone; repeated rows are packed each; an empty table gives no pieces;
    other columns play no part.
    """
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the stages; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if k:
                removed(before)
            before = docs
    return docs
