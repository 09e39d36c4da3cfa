"""Time-forward diagnostics: rows before a cutoff against a sample of the rows after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annoframe.operators import ranks, stats

FOCAL_CUTOFFS = (2020, 2021, 2023)


def sides(df: DataFrame) -> DataFrame:
    """One row per (cutoff, side) a row serves; needs ``splits.time_forward`` columns."""
    roles = F.concat(
        F.transform("train_for", lambda c: F.struct(c.alias("cutoff"), F.lit("train").alias("side"))),
        F.transform("test_for", lambda c: F.struct(c.alias("cutoff"), F.lit("test").alias("side"))),
    )
    keep = [c for c in df.columns if c not in ("train_for", "test_for")]
    return df.select(*keep, F.explode(roles).alias("_r")).select("_r.cutoff", "_r.side", *keep)


def value_presence(df: DataFrame, value: str, many: bool = False) -> DataFrame:
    """Per distinct value the cutoffs it is seen in on each side. Rows are reduced to one row per
    value before anything is fanned out to cutoffs, so a frequent value costs one row."""
    v = F.explode(F.array_distinct(value)) if many else F.col(value)
    rows = df.select(v.alias("_v"), "train_for", "test_for").filter(F.col("_v").isNotNull())
    # Equal role arrays are few (at most cutoffs x 2^cutoffs): collapse before collecting sets.
    kinds = rows.groupBy("_v", "train_for", "test_for").agg(F.lit(1).alias("_c"))
    seen = kinds.groupBy("_v").agg(
        F.array_distinct(F.flatten(F.collect_set("train_for"))).alias("train_for"),
        F.array_distinct(F.flatten(F.collect_set("test_for"))).alias("test_for"),
    )
    return seen


def distinct_counts(df: DataFrame, value: str, name: str, many: bool = False) -> DataFrame:
    """Distinct values on each side of each cutoff and the share of test values that training
    does not have; 0 when test has none (TF1, TF2)."""
    seen = value_presence(df, value, many)
    roles = F.array_distinct(F.concat("train_for", "test_for"))
    long = seen.select("train_for", "test_for", F.explode(roles).alias("cutoff"))
    tr = F.array_contains("train_for", F.col("cutoff"))
    te = F.array_contains("test_for", F.col("cutoff"))
    agg = long.groupBy("cutoff").agg(
        F.count_if(tr).alias(f"train_{name}"),
        F.count_if(te).alias(f"test_{name}"),
        F.count_if(te & ~tr).alias("_new"),
    )
    share = F.when(F.col(f"test_{name}") > 0, F.col("_new") / F.col(f"test_{name}")).otherwise(0.0)
    return agg.select("cutoff", f"train_{name}", f"test_{name}", share.alias(f"unseen_{name}_fraction"))


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """n, mean, sample sd, median and IQR of the label per cutoff, one column set per side (TF3)."""
    long = sides(df.select(F.col(label).cast("double").alias("_y"), "train_for", "test_for"))
    moments = long.groupBy("cutoff", "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd")
    )
    qs = ranks.quantiles(long, "_y", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["cutoff", "side"])
    both = moments.join(qs, ["cutoff", "side"], "left")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, c))
    aggs = []
    for s in ("train", "test"):
        aggs += [
            F.coalesce(pick(s, F.col("n")), F.lit(0)).alias(f"{s}_n"),
            pick(s, F.col("mean")).alias(f"{s}_label_mean"),
            pick(s, F.col("sd")).alias(f"{s}_label_sd"),
            pick(s, F.col("median")).alias(f"{s}_label_median"),
            pick(s, F.col("q75") - F.col("q25")).alias(f"{s}_label_iqr"),
        ]
    return both.groupBy("cutoff").agg(*aggs)


def cutoff_stats(
    df: DataFrame, label: str, counted: dict[str, str], listed: dict[str, str] | None = None
) -> DataFrame:
    """Rows, distinct values, unseen shares and label statistics per cutoff (TF1-TF3).

    ``counted`` maps an output name to a column, ``listed`` to an array column.
    """
    out = label_stats(df, label)
    for name, col in counted.items():
        out = out.join(distinct_counts(df, col, name), "cutoff", "left")
    for name, col in (listed or {}).items():
        out = out.join(distinct_counts(df, col, name, many=True), "cutoff", "left")
    return out


def composition(
    df: DataFrame, source: str, cutoffs: Sequence[int] = FOCAL_CUTOFFS
) -> DataFrame:
    """Test rows per source with their share, for the given cutoffs (TF4). Sort by descending
    test_n, then source."""
    focal = F.filter("test_for", lambda c: c.isin(*cutoffs))
    long = df.select(F.col(source).alias("source"), F.explode(focal).alias("cutoff"))
    counts = long.groupBy("cutoff", "source").agg(F.count(F.lit(1)).alias("test_n"))
    total = F.sum("test_n").over(W.partitionBy("cutoff"))
    return counts.withColumn("test_fraction", F.col("test_n") / total)


def performance(
    predictions: DataFrame,
    family: str = "family",
    replicates: int = stats.BOOTSTRAP_REPLICATES,
    seed: int = stats.BOOTSTRAP_SEED,
    with_spearman: bool = True,
) -> DataFrame:
    """Metrics by cutoff and model with a family bootstrap (TF5)."""
    return stats.group_bootstrap(
        predictions,
        ["cutoff", "model"],
        family,
        replicates=replicates,
        seed=seed,
        with_spearman=with_spearman,
    )


def wide_report(
    performance_rows: DataFrame, cutoffs: DataFrame, similarity: DataFrame, metric: str = "spearman"
) -> DataFrame:
    """Performance of one metric joined with cutoff statistics and similarity (JN5, TF6)."""
    chosen = performance_rows.filter(F.col("metric") == metric).withColumnRenamed("estimate", metric)
    return chosen.drop("metric").join(cutoffs, "cutoff").join(similarity, "cutoff")


