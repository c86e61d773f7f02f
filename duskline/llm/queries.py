"""The operators' registered queries: (session, table folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskline.llm import (
    bpe,
    decontaminate,
    embeddings,
    language,
    near_duplicates,
    negatives,
    quality,
    quotes,
    repeats,
    spelling,
    suffix_tree,
    token_files,
    toxicity,
)
from duskline.llm.common import documents
from duskline.llm.oracle import ORACLE as ORACLE



def tokenizer() -> str:
    """The tokenizer file; only the queries that use it need its package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(
        documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_offsets(
        spark, documents(spark, sf_dir), tokenizer()
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked_vectors(documents(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations_in_reply_order(documents(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(documents(spark, sf_dir), tokenizer())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(
        documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(documents(spark, sf_dir, "embeddings"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_repeats": op3_repeats,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_embeddings": op5_embeddings,
    "op6_language": op6_language,
    "op7_quotes": op7_quotes,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_negatives": op11_negatives,
    "op12_suffix_tree": op12_suffix_tree,
    "op13_spelling": op13_spelling,
}
