"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table, written
from corvane.llm.line_templates import drop_recurring_lines
from corvane.llm.ngram_join import keep_first
from corvane.llm.packing import pack_documents
from corvane.llm.quality import keep_good
from corvane.llm.winnow import drop_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go. Null and empty texts have no words and fail;
    rows that repeat a doc_id, or have none, are judged one by one; an empty table stays one."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in distinct texts go; n_chars follows the text. A document stays even if no line
    does, as an empty text; a null text stays null. Repeated rows count as one text and lose the same lines."""
    out = drop_recurring_lines(docs).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) the row of smallest doc_id stays, one of
    rows that repeat it. Rows without words stay, and so does a row that shares only its doc_id with another."""
    return keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with a benchmark item go, or all the words of a shorter item. Null and
    empty texts share nothing and stay; repeated rows go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stay, packed into sequences of 2048 tokens. A null or empty text is its end
    token; every row is packed, repeated ones too."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens and learnt thresholds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
