"""One query per operator, with production parameters, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable
from os import environ

from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.llm import (
    op1_warc,
    op2_language,
    op3_substring_dedup,
    op4_decontaminate,
    op5_chat,
    op6_sentencepiece,
    op7_repetition,
    op8_line_dedup,
    op9_jaccard_join,
    op10_toxicity,
    op11_hard_negatives,
    op12_spelling,
    op13_nearest,
)
from runscope.llm.common import read


def tokenizer_model() -> str:
    """The model file: ``RUNSCOPE_TOKENIZER`` or the public package's."""
    import public_tokenizers

    return environ.get("RUNSCOPE_TOKENIZER") or str(public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentencepiece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_sentencepiece.token_digests(read(spark, sf_dir, "documents"), tokenizer_model())


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_warc.archive_round_trip(spark, read(spark, sf_dir, "pages"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_substring_dedup.remove_repeats_digest(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    found = op4_decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score")


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op8_line_dedup.line_report(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_chat.formatted_digests(read(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_language.identify(read(spark, sf_dir, "documents"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_repetition.repetition_rules(read(spark, sf_dir, "documents")).drop("covered_chars", "longest_repeat")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_nearest.nearest_neighbours(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc_round_trip,
    "op5_chat_format": op5_chat_format,
    "op2_language_id": op2_language_id,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_decontamination": op4_decontamination,
    "op8_line_templates": op8_line_templates,
    "op6_sentencepiece": op6_sentencepiece_digests,
    "op7_repetition_rules": op7_repetition_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity_scores,
    "op11_hard_negatives": op11_hard_negatives_,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
