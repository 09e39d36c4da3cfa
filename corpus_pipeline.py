"""The corpus pipeline: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``. A stage works on all that its
predecessor kept, and nulls, empty texts, repeated rows and empty tables pass through as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.llm import language, ngram_join, packing, recompress, runtime


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a missing language is filled in. A mixture of languages is no reason to go.

    If no document that may be learned from has a language, nothing can be told and all documents stay as they are.
    """
    model = language.fit(docs.filter(~language.held_out()).select("lang", "text"))
    if not model.languages:
        return docs
    found = language.identify(docs, model, prefix="found_")
    kept = found.filter(F.col("found_lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "found_lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, that with the smallest id; equal rows are copies of each other."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more stay in their first document only; a document of which nothing is left goes."""
    kept = recompress.dedup(docs).filter("text is null or text <> ''")
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 4096 ids."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", by_language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: The mixture model and the tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = runtime.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
