"""Source and sink queries: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annoframe.operators import runs, splits
from annoframe.plans.base import load, query
from annoframe.plans.audits import sample_records
from annoframe.plans.predictions import predictions
from annoframe.plans.samples import KEYS, PRELUDE
from annoframe.sources import samples as sample_files
from annoframe.session import settle, shared_folder
from annoframe.sources import tables


def scratch(spark) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/annoframe-{uuid.uuid4().hex}"


def records(spark, sf):
    df = sample_records(spark, sf)
    prov = F.col("provenance")
    full = F.struct(
        prov["source_file"].alias("source_file"),
        prov["source_row_index"].alias("source_row_index"),
        prov["parser_version"].alias("parser_version"),
        F.lit(None).cast("string").alias("parsing_date"),
        F.lit(None).cast("map<string,string>").alias("raw_data_sample"),
    )
    return df.withColumn("provenance", full).withColumn(
        "label", F.when(~F.isnan("label"), F.col("label"))
    ).select(
        "sample_id",
        "dataset",
        "sequence",
        "label",
        "label_type",
        "label_unit",
        "assay_type",
        "assay_metadata",
        "edits",
        "anchor_status",
        "provenance",
        F.lit(None).cast("map<string,string>").alias("split_metadata"),
        F.array().cast("array<string>").alias("quality_flags"),
    )


_KEPT = f"""WITH {PRELUDE}, {KEYS}
SELECT CASE WHEN s.id % 101 = 0 THEN 'order-' ELSE 'ORDER_' END || s.id AS sample_id, n_edits,
  CASE WHEN cust % 97 = 0 THEN NULL ELSE label END AS label, s.id AS row_index, priority FROM s"""


def _kept(df):
    return df.select(
        "sample_id",
        F.size("edits").cast("bigint").alias("n_edits"),
        "label",
        F.col("provenance.source_row_index").alias("row_index"),
        F.element_at("assay_metadata", "priority").alias("priority"),
    )


@query("json_layout", _KEPT)
def json_layout(spark, sf):
    """Nested fields to JSON text and back (IO3, IO4)."""
    return _kept(sample_files.from_flat(sample_files.to_flat(records(spark, sf))))


@query("files_json_lines", _KEPT)
def files_json_lines(spark, sf):
    """Samples written as JSON Lines and read back by suffix (IO1, IO2, IO6)."""
    path = f"{scratch(spark)}/samples.jsonl"
    sample_files.write_samples_json(records(spark, sf), path)
    return _kept(sample_files.read_samples(spark, path))


@query("files_both_formats", _KEPT)
def files_both_formats(spark, sf):
    """Both formats written from one evaluation; the Parquet form read back (IO4-IO6)."""
    folder = scratch(spark)
    sample_files.write_both(records(spark, sf), folder, "samples")
    return _kept(sample_files.read_samples(spark, f"{folder}/samples.parquet"))


@query(
    "files_split_sets",
    f"""WITH {PRELUDE}, p AS (SELECT DISTINCT priority FROM o)
    SELECT CASE priority WHEN '1-URGENT' THEN 'val' WHEN '5-LOW' THEN 'test' ELSE 'train' END AS split, count(*) AS n
    FROM o GROUP BY 1""",
)
def files_split_sets(spark, sf):
    """Train, val and test sets written and read as one frame (IO7)."""
    folder = scratch(spark)
    priority = F.element_at("assay_metadata", "priority")
    split = F.when(priority == "1-URGENT", "val").when(priority == "5-LOW", "test").otherwise("train")
    rows = records(spark, sf).withColumn("_s", split)
    for name in ("train", "val", "test"):
        part = rows.filter(F.col("_s") == name).drop("_s")
        sample_files.write_samples_parquet(part, f"{folder}/{name}.parquet", nested="native")
    return splits.distribution(sample_files.read_splits(spark, folder), "split")


@query(
    "event_properties",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def event_properties(spark, sf):
    """A JSON text column to a struct (IO3)."""
    df = load(spark, sf, "events")
    return df.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("files_raw_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def files_raw_csv(spark, sf):
    """A CSV table written and read back with inferred types (IO8, IO12)."""
    path = f"{scratch(spark)}/customer.csv"
    tables.write_table(load(spark, sf, "customer"), path)
    df = tables.read_raw_csv(spark, path)
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")


@query(
    "files_predictions",
    """SELECT 'count' AS model_id, CAST(year(o_orderdate) AS INTEGER) AS seed, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'total', CAST(year(o_orderdate) AS INTEGER), count(*) FROM orders GROUP BY 2""",
)
def files_predictions(spark, sf):
    """Predictions written by run and read back with partition columns (IO10, IO11)."""
    path = f"{scratch(spark)}/predictions"
    rows = predictions(spark, sf).select(
        F.col("id").cast("string").alias("sample_id"),
        "y_true",
        "y_pred",
        F.lit("test").alias("split"),
        F.col("model").alias("model_id"),
        F.col("yr").alias("seed"),
        F.lit("all").alias("split_type"),
    )
    tables.write_predictions(rows, path)
    back = tables.read_written_predictions(spark, path)
    return back.groupBy("model_id", "seed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "files_run_documents",
    """SELECT o_orderpriority AS split, CAST(year(o_orderdate) AS INTEGER) AS seed, 'model_a' AS feature_set_id,
    round(CAST(avg(o_totalprice) AS DOUBLE), 3) AS r2 FROM orders GROUP BY 1, 2""",
)
def files_run_documents(spark, sf):
    """Run documents without own keys in their folders, read as one table with keys from the path (IO9)."""
    root = scratch(spark)
    docs = load(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")
    ).agg(F.struct(F.round(F.avg("o_totalprice"), 3).alias("r2")).alias("test_metrics"))
    docs = settle(docs.withColumn("status", F.lit("completed")))
    # One small document for each run, each in a folder of its own.
    for run in docs.select("p", "y").collect():
        one = docs.filter((F.col("p") == run.p) & (F.col("y") == run.y)).select(F.to_json(F.struct("status", "test_metrics")))
        one.coalesce(1).write.text(f"{root}/{run.p}/seed_{run.y}/model_a")
    seeds = tables.seed_table(tables.read_runs(spark, f"{root}/*/seed_*/*"))
    return seeds.select("split", "seed", "feature_set_id", "r2")


@query(
    "files_prediction_csv",
    """SELECT model_id, 'all' AS split_type, seed, count(*) AS n, round(sum(y), 2) AS y_true FROM (
      SELECT unnest(['count', 'total']) AS model_id, CAST(year(o_orderdate) AS INTEGER) AS seed, o_totalprice AS y FROM orders) GROUP BY ALL""",
)
def files_prediction_csv(spark, sf):
    """Prediction files as CSV with a header, read under a glob (IO10)."""
    root = scratch(spark)
    rows = predictions(spark, sf).select(
        F.col("id").cast("string").alias("sample_id"),
        "y_true",
        "y_pred",
        F.lit("test").alias("split"),
        F.col("model").alias("model_id"),
        F.col("yr").alias("seed"),
        F.lit("all").alias("split_type"),
    )
    for model in ("count", "total"):
        tables.write_table(rows.filter(F.col("model_id") == model), f"{root}/{model}/predictions.csv")
    back = tables.read_predictions(spark, f"{root}/*/predictions.csv")
    return back.groupBy("model_id", "split_type", "seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y_true"), 2).alias("y_true"))


@query("files_checksums")
def files_checksums(spark, sf):
    """Checksums of written result files and the frozen summary row (IO13, ST17)."""
    path = f"{scratch(spark)}/result"
    tables.write_table(load(spark, sf, "nation"), path, ["n_nationkey"])
    sums = tables.checksum_manifest(spark, path, "*.csv")
    done = runs.completion(
        load(spark, sf, "orders").select(
            F.col("o_orderpriority").alias("experiment"), F.lit("completed").alias("status")
        ),
        "experiment",
    )
    frozen = runs.freeze(done, sums)
    return frozen.select(
        "status", F.size("completion").alias("n_experiments"), F.size("artifact_checksums").alias("n_files")
    )


