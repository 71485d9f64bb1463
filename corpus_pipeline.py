"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.llm.decontaminate import drop_leaks
from slopeworks.llm.jaccard import drop_near_copies
from slopeworks.llm.language import UNKNOWN, fit_languages, predict_language
from slopeworks.llm.lines import drop_shared_lines
from slopeworks.llm.packing import pack_documents
from slopeworks.llm.queries import table, vocabulary
from slopeworks.session import shared_folder

ARROW_ROWS = "1000"  # documents that pass between Spark and Python at once: they can be long
LEAST_LIFT = 1.6  # times the score that chance gives the predicted language


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those of no clear language; a missing lang is filled in.

    Null texts go, repeated rows are judged alike. Without any labelled text nothing can be told, and all texts with letters stay.
    """
    _small_batches(spark)
    network = fit_languages(docs)
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    clear = F.col("score") >= min(LEAST_LIFT / len(network.classes), 0.5)
    known = predict_language(docs, network).filter((F.col("lang_pred") != UNKNOWN) & clear)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many sources share; a document left without any visible character goes."""
    freed = drop_shared_lines(docs)
    left = freed.filter((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of alike ones, that of the smallest doc_id."""
    _small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with passages of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null doc_ids and repeated rows are documents like others."""
    _small_batches(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]

# A trained network and a packing plan have no SQL; tests/llm compares the run with plain loops on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is stored in the shared folder and read by the next.

    Empty tables of documents or benchmark items, repeated and null ids, and null texts run through; an empty corpus gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
