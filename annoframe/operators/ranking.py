"""Ranking inside families of related rows, and comparisons of two models over families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions.joins import join_keys
from annoframe.operators import metrics, ranks, stats
from annoframe.session import settle


def family_accuracy(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    bucket_rows: int = ranks.BUCKET_ROWS,
) -> DataFrame:
    """Valid pairs, correct pairs, accuracy and Spearman per family and model (RK1, RK2).

    Pairs are counted, not formed (see ``metrics.pair_counts``). A pair with equal truth is not
    valid; a family without valid pairs has NULL accuracy.
    """
    acc = metrics.pairwise_accuracy(df, by, order, truth, pred, bucket_rows)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"))
    rho = metrics.spearman(df, by, truth, pred, bucket_rows=bucket_rows)
    share = F.when(F.col("valid_pairs") > 0, F.col("correct_pairs") / F.col("valid_pairs"))
    out = join_keys(join_keys(n, acc, by, "left"), rho, by, "left")
    return out.select(
        *by,
        "n_test",
        F.coalesce("valid_pairs", F.lit(0)).alias("valid_pair_count"),
        F.coalesce("correct_pairs", F.lit(0)).alias("correct_pair_count"),
        share.alias("pairwise_accuracy"),
        F.col("spearman").alias("within_family_spearman"),
    )


def summary(
    families: DataFrame,
    family: str = "family_id",
    model: str = "model",
    replicates: int = stats.FAMILY_REPLICATES,
    seed: int = stats.BOOTSTRAP_SEED,
) -> DataFrame:
    """Pooled and mean family accuracy per model with a family bootstrap interval (RK3)."""
    families = settle(families)
    pooled = families.groupBy(model).agg(
        F.countDistinct(family).alias("n_families_total"),
        F.try_divide(F.sum("correct_pair_count"), F.sum("valid_pair_count")).alias(
            "overall_pairwise_accuracy"
        ),
    )
    boot = stats.mean_bootstrap(families, [model], family, "pairwise_accuracy", replicates, seed)
    out = pooled.join(boot, model)
    return out.select(
        model,
        "n_families_total",
        F.col("n_units").alias("n_families_with_valid_pairs"),
        "overall_pairwise_accuracy",
        F.col("mean").alias("mean_family_pairwise_accuracy"),
        F.col("ci95_low").alias("family_bootstrap_ci95_low"),
        F.col("ci95_high").alias("family_bootstrap_ci95_high"),
        F.lit(replicates).alias("bootstrap_replicates"),
    )


def family_differences(
    families: DataFrame,
    left: str,
    right: str,
    family: str = "family_id",
    model: str = "model",
    value: str = "pairwise_accuracy",
) -> DataFrame:
    """Values of two models side by side per family, with their difference (JN4)."""
    return stats.paired_rows(families, [family], model, left, right, value)


def compare(
    families: DataFrame,
    left: str,
    right: str,
    family: str = "family_id",
    model: str = "model",
    replicates: int = stats.FAMILY_REPLICATES,
    seed: int = stats.BOOTSTRAP_SEED,
) -> DataFrame:
    """Mean family difference of two models with interval and exact sign test (RK4)."""
    diff = settle(family_differences(families, left, right, family, model))
    boot = stats.mean_bootstrap(diff, [], family, "difference", replicates, seed)
    sign = stats.sign_test(diff, [], "difference").drop("n_units")
    boot, sign = boot.withColumn("_all", F.lit(0)), sign.withColumn("_all", F.lit(0))
    out = boot.join(sign, "_all")
    return out.select(
        F.lit(f"{left} minus {right}").alias("comparison"),
        F.col("n_units").alias("n_families_valid"),
        F.col("mean").alias("mean_difference"),
        "ci95_low",
        "ci95_high",
        "proportion_improved",
        "proportion_tied",
        "proportion_worsened",
        "exact_sign_test_p",
    )
