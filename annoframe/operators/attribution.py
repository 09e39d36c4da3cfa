"""Attribution reports from a long table of per-row feature contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.ml import Model

from annoframe.functions import constants as C
from annoframe.functions import draws
from annoframe.operators import ranks, stats

SUBSET_ROWS = 500
TOP_OVERALL = 15
TOP_PER_BLOCK = 10


def block_of(feature: Column) -> Column:
    """Block of a feature name (AT1): A, B1, B2 (by prefix), B3, otherwise C."""
    return (
        F.when(feature.isin(*C.ATTRIBUTION_A), "A")
        .when(feature.isin(*C.ATTRIBUTION_B1), "B1")
        .when(feature.startswith(C.ATTRIBUTION_B2_PREFIX), "B2")
        .when(feature.isin(*C.ATTRIBUTION_B3), "B3")
        .otherwise("C")
    )


def with_blocks(df: DataFrame, blocks: DataFrame | None = None, feature: str = "feature") -> DataFrame:
    """Add ``block`` from the naming rule, or from a (feature, block) table; default C (AT1)."""
    if blocks is None:
        return df.withColumn("block", block_of(F.col(feature)))
    joined = df.join(blocks.select(feature, "block"), feature, "left")
    return joined.withColumn("block", F.coalesce("block", F.lit("C")))


def feature_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature and its share of the run's total (AT2)."""
    agg = df.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("mean_absolute"))
    total = F.sum("mean_absolute").over(W.partitionBy(*by))
    return agg.withColumn("proportion", F.try_divide("mean_absolute", total))


def block_share(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share per block, with B as the sum of B1, B2 and B3 (AT3). ``shares`` has ``block``."""
    roles = F.when(
        F.col("block").isin("B1", "B2", "B3"), F.array(F.col("block"), F.lit("B"))
    ).otherwise(F.array("block"))
    long = shares.select(*by, "proportion", F.explode(roles).alias("block"))
    return long.groupBy(*by, "block").agg(F.sum("proportion").alias("attribution_proportion"))


def seed_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Interval over seeds per block or feature (AT4)."""
    return stats.t_interval(df, by, value).withColumnRenamed("n", "n_seeds")


def top_features(
    shares: DataFrame, by: Sequence[str], overall: int = TOP_OVERALL, per_block: int = TOP_PER_BLOCK
) -> DataFrame:
    """The largest mean shares overall and per block A, B (B1-B3 pooled) and C, ranked (AT5)."""
    means = seed_interval(shares, [*by, "feature", "block"], "proportion")
    pooled = F.when(F.col("block").startswith("B"), "B").otherwise(F.col("block"))
    long = means.withColumn("scope", F.explode(F.array(F.lit("overall"), pooled)))
    order = W.partitionBy(*by, "scope").orderBy(F.desc("mean"), "feature")
    limit = F.when(F.col("scope") == "overall", overall).otherwise(per_block)
    ranked = long.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(overall, per_block)
    )
    ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select(
        *by,
        "scope",
        "rank",
        "feature",
        "block",
        F.col("mean").alias("proportion"),
        "sample_sd",
        "ci95_low",
        "ci95_high",
        "n_seeds",
    )


def fixed_subset(df: DataFrame, key: str, n: int = SUBSET_ROWS, seed: int | str = stats.BOOTSTRAP_SEED):
    """A fixed random subset of ``n`` rows: the first in hash order (AT6)."""
    ranked = df.withColumn("_h", draws.unit(seed, key)).orderBy("_h", key).limit(n)
    return ranked.drop("_h")


def permutation(
    model: Model,
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    assemble,
    seed: int = 42,
) -> DataFrame:
    """RMSE increase when one feature is shuffled over the rows (AT7).

    The shuffle is a join of the rows' hash order with a second hash order. All features are
    scored in one pass: each row is fanned out to one copy per feature plus an unchanged one.
    """
    rows = df.select(key, label, *features)
    rows = rows.withColumns({"_h1": draws.unit(f"{seed}:a", key), "_h2": draws.unit(f"{seed}:b", key)})
    rows = ranks.dense_index(rows, [], "_h1", key, "_i1")
    rows = ranks.dense_index(rows, [], "_h2", key, "_i2")
    donor = rows.select(F.col("_i2").alias("_i1"), F.struct(*features).alias("_donor"))
    paired = rows.join(donor, "_i1")
    names = F.array(F.lit(""), *[F.lit(f) for f in features])
    fan = paired.select("*", F.explode(names).alias("feature"))
    changed = fan.withColumns(
        {
            f: F.when(F.col("feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f))
            for f in features
        }
    )
    scored = model.transform(assemble(changed))
    err = F.col("prediction") - F.col(label)
    agg = scored.groupBy("feature").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    base = agg.filter(F.col("feature") == "").select(F.col("rmse").alias("_base"), F.lit(0).alias("_all"))
    out = agg.filter(F.col("feature") != "").withColumn("_all", F.lit(0)).join(F.broadcast(base), "_all")
    return out.select("feature", "rmse", (F.col("rmse") - F.col("_base")).alias("rmse_increase"))
