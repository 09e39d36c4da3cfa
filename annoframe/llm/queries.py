"""The queries of these operators over the driver tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.llm import (
    backoff,
    bpe,
    chat,
    cover_tree,
    divergence,
    language,
    ngram_join,
    order_minhash,
    packing,
    recompress,
    resample,
    runtime,
    simple8b,
    sql,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
vocabulary = public_tokenizers.path


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard", sql.NGRAM_JACCARD)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(load(spark, sf_dir, "documents"))


@query("op2_substring_dedup", sql.SUBSTRING_DEDUP)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(load(spark, sf_dir, "documents"))


@query("op3_token_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.folder(spark)
    simple8b.write_ids(load(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return simple8b.read_ids(spark, path, digest=True)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out()).select("lang", "text"))
    rows = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op5_stupid_backoff", sql.STUPID_BACKOFF)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(load(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "longest", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query("op6_cover_tree", sql.COVER_TREE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.links(load(spark, sf_dir, "embeddings"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_best_fit")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(load(spark, sf_dir, "documents"))


@query("op10_chat_format", sql.CHAT_FORMAT)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = spark.range(2).select(F.lit(-1).cast("long"), "id", role, F.lit("</s>[INST] ok [/INST]"))
    return chat.digests(chat.format_chats(turns.union(rows)))


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    free = ~toxicity.held_out()
    model = toxicity.fit(docs.filter(free), labels.filter(free))
    rows = docs.select("doc_id", "text", toxicity.held_out().alias("held_out"))
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


@query("op12_importance_resampling", sql.IMPORTANCE_RESAMPLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op13_source_divergence", sql.SOURCE_DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))
