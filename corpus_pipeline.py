"""From raw documents to token ids: the stages of a training corpus, one after another.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from duskline.llm import bpe, decontaminate, language, near_duplicates, repeats
from duskline.llm.common import documents, saved, splittable

TOKENIZER = "word_bpe_49k.json"
# A text whose best language is less like it than this is no text of any of them.
LEAST_LIKENESS = 0.02

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or like no known language, go."""
    learned = language.learn_prototypes(docs.where(F.col("doc_id").isNotNull()))
    named = language.predict_language(docs, learned, *[F.col(f"`{c}`") for c in docs.columns])
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LIKENESS)
    return named.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = saved(near_duplicates.near_duplicates(docs), "found")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(splittable(gone), docs["doc_id"] == F.col("gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once; other texts stay as they are."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    cut = repeats.without_repeats(docs, *names)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    # Only this stage needs the vocabulary files; where they are missing the rest still works.
    import public_tokenizers

    return bpe.token_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontaminate", decontaminated),
    ("bpe", encode),
]

# Trained prototypes and a tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
