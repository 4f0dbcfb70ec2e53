"""The training corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  A
stage's result is written as Parquet and read again as the next one's docs.

In every stage a null text counts as empty and stays null where its row stays; null ids and extra columns are kept; an
empty table gives an empty result.  Repeated rows (equal id and text): the classifier keeps or rejects all of them, line
dedup leaves shared runs in the first of them, the near-duplicate stage keeps one, packing packs each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.llm.common import read_table, text_or_empty, write_table
from webgauge.llm.jaccard_join import keep_one_of_each
from webgauge.llm.line_dedup import dedup_lines
from webgauge.llm.packing import pack_documents
from webgauge.llm.quality import keep_good
from webgauge.runtime import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The results of learned, hashed and greedy stages aren't expressible in SQL; tests hold each against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on ``labels``, doesn't reject."""
    return keep_good(docs, read_table(ship(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without line runs that repeat earlier ones; n_chars follows the text."""
    ship(spark)
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("lines_removed") > 0, F.char_length(text_or_empty()).cast(kind)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least doc_id."""
    ship(spark)
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in the training sequences."""
    ship(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
