import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import brute


def test_stages_keep_the_columns_and_follow_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(900_000 + i, t, None, "odd", None) for i, (_, t) in enumerate(brute.odd_texts())], docs.schema)
    docs = docs.union(odd)
    first = corpus_pipeline.by_language(spark, docs, "").cache()
    assert first.schema == docs.schema
    every = {r.doc_id: r.text for r in docs.collect()}
    rejected = {i for i, t in every.items() if not any(c.isalpha() for c in t or "")}
    pairs = [(r.doc_id, r.text) for r in first.collect()]
    assert {i for i, _ in pairs} == set(every) - rejected
    assert {900_003, 900_004, 900_005} <= rejected
    assert first.filter(F.col("lang").isNull()).isEmpty()

    second = corpus_pipeline.near_duplicates(spark, first, "")
    root = {i: c for i, _, c in brute.jaccard_classes(pairs)}
    pairs = [(i, t) for i, t in pairs if root[i] == i]
    assert brute.rows(second, "doc_id", "text") == sorted(pairs)

    third = corpus_pipeline.repeated_passages(spark, second, "")
    want = [(i, kept if gone else t) for (i, t), (_, _, gone, kept) in zip(pairs, brute.kept_words(pairs), strict=True)]
    assert brute.rows(third, "doc_id", "text", "n_chars") == sorted((i, t, len(t)) for i, t in want if t)

    last = corpus_pipeline.packed(spark, third, "")
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {i for i, t in want if t}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    three = "the house of the river and the garden " * 3 + "das haus und der garten nicht weit " * 3 + "la maison et le jardin pour les enfants " * 3
    mixed = spark.createDataFrame([(910_000, three, None, "s", len(three)), (910_001, three + " end", "fr", "s", len(three))], docs.schema)
    first = corpus_pipeline.by_language(spark, docs.union(mixed), "")
    assert first.filter("doc_id >= 910000").count() == 2
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.by_language(spark, unnamed, "").count() == docs.count()


def test_empty_documents_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.collect() == []


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14
