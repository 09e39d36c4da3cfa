"""The run grid: which cells are missing, and manifests of what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expected_grid(spark: SparkSession, dims: dict[str, Sequence]) -> DataFrame:
    """Every combination of the given dimension values, as a chain of explodes over one row."""
    grid = spark.range(1)
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


def grid_of(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every combination of the values seen in each dimension column. Dimensions are run keys
    (split, model, seed), so each has few values."""
    row = df.agg(*[F.array_sort(F.collect_set(d)).alias(d) for d in dims])
    for d in dims:
        row = row.withColumn(d, F.explode(d))
    return row


def completed(
    runs: DataFrame,
    predictions: DataFrame,
    trials: DataFrame,
    keys: Sequence[str],
    budget: int,
    status: str = "status",
) -> DataFrame:
    """Keys of runs that are finished: status, at least one prediction row, and exactly
    ``budget`` search trials."""
    done = runs.filter(F.col(status) == "completed").select(*keys)
    scored = predictions.select(*keys).distinct()
    full = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")).filter(F.col("_t") == budget)
    return done.join(scored, list(keys), "left_semi").join(full, list(keys), "left_semi")


def missing(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected cells without a finished run (JN12)."""
    return expected.join(done, list(keys), "left_anti")


def manifest(
    runs: DataFrame, keys: Sequence[str], runtime: str = "runtime_seconds", budget: int = 50
) -> DataFrame:
    """One line per run: search budget, status text and reason (ST16).

    Runs without a recorded run time come from before it was recorded, so they were reused.
    """
    absent = F.col(runtime).isNull() | F.isnan(F.col(runtime).cast("double"))
    return runs.select(
        *keys,
        F.lit(budget).alias("search_budget"),
        F.when(absent, "valid reusable run").otherwise("newly completed run").alias("run_status"),
        F.lit(f"Validated metrics, {budget} trials, predictions and held-out test evaluation.").alias(
            "reason"
        ),
    )


def completion(runs: DataFrame, experiment: str, status: str = "status") -> DataFrame:
    """``done/total`` per experiment."""
    agg = runs.groupBy(experiment).agg(
        F.count_if(F.col(status) == "completed").alias("n_completed"),
        F.count(F.lit(1)).alias("n_expected"),
    )
    text = F.concat_ws("/", F.col("n_completed").cast("string"), F.col("n_expected").cast("string"))
    return agg.withColumn("completion", text)


def freeze(
    completion_rows: DataFrame, checksums: DataFrame, experiment: str = "experiment"
) -> DataFrame:
    """One frozen row: overall status, completion text per experiment, checksum per file (ST17).

    Both inputs are manifests with one row per experiment or artefact file.
    """
    done = completion_rows.agg(
        F.bool_and(F.col("n_completed") == F.col("n_expected")).alias("_ok"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col(experiment), F.col("completion"))))
        ).alias("completion"),
    ).withColumn("_all", F.lit(0))
    sums = checksums.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias(
            "artifact_checksums"
        )
    ).withColumn("_all", F.lit(0))
    out = done.join(sums, "_all")
    return out.select(
        F.when(F.col("_ok"), "COMPLETE").otherwise("INCOMPLETE").alias("status"),
        "completion",
        "artifact_checksums",
    )
