"""Raw CSV, run documents, prediction files, result tables and file checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_DDL = (
    "sample_id string, y_true double, y_pred double, split string, model_id string, seed int, "
    "split_type string"
)
RUN_DDL = """
model_id string, model_name string, role string, feature_set string, estimator string,
family string, seed int, split_type string, status string, hpo boolean,
n_features bigint, n_train bigint, n_val bigint, n_test bigint, n_trials bigint,
val_metrics struct<rmse:double,mae:double,r2:double,spearman:double>,
test_metrics struct<rmse:double,mae:double,r2:double,spearman:double,pearson:double,
kendall_tau:double,n_samples:bigint,variance_ratio:double>,
best_validation_rmse double, best_params map<string,double>, runtime_seconds double
""".replace("\n", " ").strip()


def read_raw_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A raw assay table with header (IO8). Types are inferred only when no schema is given."""
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Many run documents as one table (IO9). Older documents lack split, seed or model; these
    come from the path ``.../<split>/seed_<n>/<model>/metrics.json``."""
    docs = spark.read.schema(RUN_DDL).option("multiLine", True).json(path)
    # Paths of files come in escaped form, in which a plus is a plus.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return with_path_keys(docs.withColumn("source_path", path))


def with_path_keys(docs: DataFrame) -> DataFrame:
    """Fill split, seed and model from ``source_path`` where a document lacks them."""
    part = lambda pattern: F.nullif(F.regexp_extract("source_path", pattern, 1), F.lit(""))
    return docs.withColumns(
        {
            "split_type": F.coalesce("split_type", part(r"/([^/]+)/seed_\d+/")),
            "seed": F.coalesce("seed", part(r"/seed_(\d+)/").cast("int")),
            "model_id": F.coalesce("model_id", part(r"/seed_\d+/([^/]+)/[^/]*$")),
        }
    )


def seed_table(runs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Seed-level result rows from run documents: test metrics, validation score, parameters."""
    label = F.col("model_id")
    if names:
        table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
        label = F.coalesce(F.try_element_at(table, F.col("model_id")), F.col("model_id"))
    return runs.select(
        F.col("split_type").alias("split"),
        F.col("model_id").alias("feature_set_id"),
        label.alias("feature_set"),
        "seed",
        *[F.col(f"test_metrics.{m}").alias(m) for m in ("r2", "rmse", "mae", "spearman")],
        F.coalesce("best_validation_rmse", "val_metrics.rmse").alias("validation_score"),
        "runtime_seconds",
        "status",
        F.to_json("best_params").alias("best_params_json"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files under a path or glob (IO10)."""
    return spark.read.schema(PREDICTION_DDL).option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prediction rows as Parquet, one folder per split type, model and seed (IO11).

    Rows are shuffled by the folder columns plus a hash slice first, so one large run is written
    by several tasks and a folder does not get a file from every task.
    """
    slices = F.pmod(F.xxhash64("sample_id"), F.lit(16))
    spread = df.repartition("split_type", "model_id", "seed", slices)
    spread.write.mode(mode).partitionBy("split_type", "model_id", "seed").parquet(path)


def read_written_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A result table as CSV with header (IO12), optionally sorted."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).csv(path)


def checksum_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and SHA-256 of every file below a folder (IO13).

    A file is one row, so this is meant for result files, each well under 2 GB.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
