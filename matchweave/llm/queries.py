"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, chat_format, embedding_join, html_text, image_copies, language_id, line_dedup, mixing, near_dedup, quality, sentence_pieces, spelling, whitening
from .common import table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from the assembled tokens."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat_format.digests(chat_format.format_turns(rows.unionByName(probe)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first copy), range-sorted by position."""
    mix = mixing.curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    ordered = mixing.by_first_position(mix.select("doc_id", "size", "source_size", "target", "taken", "positions"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, class_id, component_id, kept, for the pictures drawn from all embeddings and the edited copies planted among them."""
    return image_copies.image_copies(image_copies.rendered(table(spark, sf_dir, "embeddings")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip."""
    return sentence_pieces.encoded_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_ids", "round_trip")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the lines that repeat an earlier one, removed: how many lines went."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "removed", min_words=1)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, component_id, kept."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, evidence, site_quality, path_quality, quality, toxic, keep."""
    return quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, for the first eight components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.whitened(vectors, model).withColumn("identity_error", F.lit(whitening.identity_error(vectors, model)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them."""
    return byte_pairs.digests(byte_pairs.decode(byte_pairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": op1_html_main_text,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_image_copies": op5_image_copies,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_posterior": op10_quality_posterior,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_pairs": op13_byte_pairs,
}
ORACLE_SQL: dict[str, str] = {
    "op4_source_mix": mixing.SQL,
}
