"""A training corpus from raw documents in five stages, each written as Parquet and read again as the next one's input.

1. quality_classifier: documents whose posterior quality is too low or that are toxic go.
2. line_dedup: lines that repeat an earlier line go, and so do documents of which no letter or digit is left; ``n_chars`` is
   counted anew.
3. minhash_near_dedup: one document of each group of near copies stays.
4. source_mix: sources are brought to their target weights; documents of sources above their share go, those of sources
   below it are repeated, and the rows stand in training order.
5. sentencepiece: texts become token ids; ids, n_ids and round_trip are added.

Null or empty texts do not pass stage 1; documents that stage 2 empties are copies of earlier ones and do not reach stage 3.
Tables may be empty. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import line_dedup, mixing, near_dedup, quality, sentence_pieces
from matchweave.llm.common import free_name, saved, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = free_name(docs.columns, "removed")
    out = line_dedup.dedup_lines(docs, removed, min_words=1)
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    return _counted(out.where(~emptied).drop(removed))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mixed(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Classifier, similarity joins and tokenizer have no SQL form; tests/llm compares the operators with brute force, and holds what
#: the stages do to planted documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
