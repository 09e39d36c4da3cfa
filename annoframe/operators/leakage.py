"""Train-test leakage metrics of a split."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.operators import ranks, similarity
from annoframe.session import settle, ship

HIGH_IDENTITY = 0.7
# The last one finds every pair that shares a letter.
LOWER_LEVELS = (0.4, 0.2, 0.1, 1e-6)
JS_EPSILON = 1e-10
# Fixed value: up to this size of the larger side the p of the Kolmogorov-Smirnov test is exact.
EXACT_KS = 10_000
#: Pairs of a test sequence that train lacks and a train sequence up to which all are compared, instead of a blocked join.
ALL_PAIRS = 1 << 36


def sequence_similarity(df: DataFrame, sequence: str, split: str = "split") -> DataFrame:
    """Highest train-test identity and the share of test rows that have one above 0.7 (LK1), exact at any size.

    Works on distinct sequences: a copy in train has identity 1, the others meet all of train in blocks or, where that would be
    too many pairs, by a blocked join. Only if that finds no pair from 0.7, lower thresholds are tried for the maximum.
    """
    used = df.filter(F.col(split).isin("train", "test") & F.col(sequence).isNotNull())
    seqs = used.groupBy(F.col(sequence).alias("_seq")).agg(
        F.count_if(F.col(split) == "train").alias("_tr"), F.count_if(F.col(split) == "test").alias("_te")
    )
    seqs = settle(seqs)
    train, rest = seqs.filter("_tr > 0"), seqs.filter("_tr = 0")
    few = train.count() * rest.count() <= ALL_PAIRS
    if few:
        near = similarity.best_between(rest.select(F.col("_seq").alias("seq")), train.select(F.col("_seq").alias("seq")))
        best = near.select(F.col("seq").alias("_seq"), F.col("best").alias("_best"))
    else:
        near = similarity.between(rest, train, "_seq", HIGH_IDENTITY)
        best = near.groupBy(F.col("seq_a").alias("_seq")).agg(F.max("identity").alias("_best"))
    own = F.when((F.col("_tr") > 0) & (F.col("_te") > 0), 1.0)
    scored = seqs.filter("_te > 0").join(settle(best), "_seq", "left").withColumn("_best", F.coalesce(own, "_best"))
    high = F.sum(F.when(F.col("_best") > HIGH_IDENTITY, F.col("_te")).otherwise(0)) / F.sum("_te")
    out = settle(scored.agg(F.max("_best").alias("_max"), F.coalesce(100.0 * high, F.lit(0.0)).alias("pct_test_high_similarity")))
    top = out.first()["_max"]
    for level in () if few else LOWER_LEVELS:
        if top is None:
            top = similarity.between(rest, train, "_seq", level).agg(F.max("identity")).first()[0]
    return out.select(F.lit(top if top is not None else 0.0).alias("max_sequence_identity"), "pct_test_high_similarity")


def sampled_mean_identity(
    df: DataFrame, key: str, sequence: str, draws_wanted: int = 10_000, seed: int = 42, split: str = "split"
) -> DataFrame:
    """Mean identity of ``draws_wanted`` hashed train-test draws: an estimate, unlike ``sequence_similarity``."""
    train, test = (df.filter(F.col(split) == s) for s in ("train", "test"))
    pairs = similarity.sampled_pairs(train, test, sequence, key, draws_wanted, seed)
    return pairs.agg(F.coalesce(F.avg("identity"), F.lit(0.0)).alias("mean_test_train_similarity"))


def _steps(seqs: DataFrame) -> int:
    """Letters of train sequences times test sequences."""
    letters = F.sum(F.when(F.col("_side") == "train", F.length("seq") + 1))
    cost = seqs.agg(F.coalesce(letters, F.lit(0)).alias("a"), F.count_if(F.col("_side") == "test").alias("b")).first()
    return cost.a * cost.b


def mean_identity(
    df: DataFrame,
    key: str,
    sequence: str,
    split: str = "split",
    exact_steps: int | None = None,
    draws_wanted: int = 1_000_000,
    seed: int = 42,
) -> DataFrame:
    """Mean identity of all pairs of a train and a test row and its standard error, which is 0 as all pairs count (LK1).

    Distinct sequences count with their rows on both sides, at any size. Only a caller who names ``exact_steps`` gets, beyond so
    many letters of train sequences times test sequences, the mean of ``draws_wanted`` hashed draws and how far that may be off.
    """
    used = df.filter(F.col(split).isin("train", "test") & F.col(sequence).isNotNull())
    seqs = settle(used.groupBy(F.col(sequence).alias("seq"), F.col(split).alias("_side")).agg(F.count(F.lit(1)).alias("w")))
    if exact_steps is not None and _steps(seqs) > exact_steps:
        train, test = (used.filter(F.col(split) == side) for side in ("train", "test"))
        pairs = similarity.sampled_pairs(train, test, sequence, key, draws_wanted, seed)
        error = F.stddev_samp("identity") / F.sqrt(F.count("identity"))
        return pairs.agg(F.avg("identity").alias("mean_test_train_similarity"), error.alias("standard_error"))
    sums = similarity.identity_sums(*(seqs.filter(F.col("_side") == side).select("seq", "w") for side in ("train", "test")))
    mean = F.coalesce(F.try_divide(F.sum("total"), F.sum("pairs")), F.lit(0.0))
    return sums.agg(mean.alias("mean_test_train_similarity"), F.lit(0.0).alias("standard_error"))


def key_overlap(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Keys found on both sides and the share of test rows that have one (JN10, LK2)."""
    per = df.groupBy(group).agg(
        F.count_if(F.col(split) == "train").alias("_tr"),
        F.count_if(F.col(split) == "test").alias("_te"),
    )
    both = (F.col("_tr") > 0) & (F.col("_te") > 0)
    share = 100.0 * F.sum(F.when(both, F.col("_te")).otherwise(0)) / F.sum("_te")
    return per.agg(
        F.count_if(both).alias("n_shared_scaffolds"),
        F.coalesce(F.when(F.sum("_te") > 0, share), F.lit(0.0)).alias("pct_test_shared_scaffold"),
    )


def _two_counts(df: DataFrame, key: Column, name: str, split: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.count_if(F.col(split) == "train").alias("p"), F.count_if(F.col(split) == "test").alias("q")
    )


def profile_cosine(df: DataFrame, profile: str, split: str = "split") -> DataFrame:
    """Cosine of the train and test profile frequency vectors (LK4)."""
    counts = _two_counts(df, F.col(profile), "profile", split)
    agg = counts.agg(
        F.sum(F.col("p") * F.col("q")).alias("pq"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("q") * F.col("q")).alias("qq"),
    )
    norm = F.sqrt(F.col("pp").cast("double")) * F.sqrt(F.col("qq").cast("double"))
    return agg.select(
        F.when(norm > 0, F.col("pq") / norm).otherwise(0.0).alias("edit_profile_cosine_similarity")
    )


def js_divergence(
    df: DataFrame, edits: str, families: Sequence[str] = C.FAMILIES, split: str = "split"
) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of family counts over a fixed family list (LK5).

    Shares get 1e-10 added and are normalised again, families never seen included. All counts
    come from one aggregate over the arrays in place.
    """
    n = lambda f: F.size(F.filter(edits, lambda e: e["edit_family"] == f))
    aggs = []
    for i, f in enumerate(families):
        aggs += [
            F.sum(F.when(F.col(split) == "train", n(f)).otherwise(0)).alias(f"p{i}"),
            F.sum(F.when(F.col(split) == "test", n(f)).otherwise(0)).alias(f"q{i}"),
        ]
    return _js_row(df.agg(*aggs), len(families))


def _js_row(row: DataFrame, n: int) -> DataFrame:
    return row.select(
        js_of(
            [F.col(f"p{i}") for i in range(n)],
            [F.col(f"q{i}") for i in range(n)],
        ).alias("edit_family_js_divergence")
    )


def js_of(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Jensen-Shannon divergence of two count vectors given as columns."""

    def smooth(v: Sequence[Column]) -> list[Column]:
        total = sum(v[1:], v[0])
        shares = [F.when(total > 0, x / total).otherwise(0.0) + JS_EPSILON for x in v]
        again = sum(shares[1:], shares[0])
        return [s / again for s in shares]

    sp, sq = smooth(p), smooth(q)
    out = F.lit(0.0)
    for a, b in zip(sp, sq, strict=True):
        m = (a + b) / 2
        out = out + (a * F.log(a / m) + b * F.log(b / m)) / 2
    return out


def _paths_inside(m: int, n: int, h: int) -> float:
    """Share of the orders of m and n values in which |i n - j m| stays below ``h`` after every i and j values.

    Orders are lattice paths; the share of those that reach a point unhurt follows from its two neighbours on the diagonal
    before, so that a diagonal is one vector.
    """
    inside = np.ones(1)
    for k in range(1, m + n + 1):
        low, high = max(0, k - n), min(m, k)
        i = np.arange(low, high + 1)
        before = max(0, k - 1 - n)
        left = np.zeros(len(i))
        down = np.zeros(len(i))
        # From (i - 1, j) and from (i, j - 1), where those exist.
        at = i - 1 - before
        ok = (at >= 0) & (at < len(inside))
        left[ok] = inside[at[ok]]
        at = i - before
        ok = (at >= 0) & (at < len(inside)) & (k - i > 0)
        down[ok] = inside[at[ok]]
        inside = (left * i + down * (k - i)) / k
        inside[np.abs(i * n - (k - i) * m) >= h] = 0
    return float(inside[0])


def ks(df: DataFrame, label: str, split: str = "split", exact_up_to: int = EXACT_KS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of train and test labels and its p (LK6). An empty side gives 0 and 1.

    The p is exact, from lattice paths, if no side has more than ``exact_up_to`` rows, and else the limiting one.
    """
    rows = df.filter(F.col(split).isin("train", "test") & F.col(label).isNotNull())
    ship(df.sparkSession)
    counts = rows.groupBy(F.col(label).cast("double").alias("_v")).agg(
        F.count_if(F.col(split) == "train").alias("_a"), F.count_if(F.col(split) == "test").alias("_b")
    )
    counts, keys = ranks.keyed(counts, [])
    cum = ranks.cumulate(counts, keys, "_v", ["_a", "_b"])
    sizes = counts.groupBy(*keys).agg(F.sum("_a").alias("_m"), F.sum("_b").alias("_n"))
    both = cum.join(F.broadcast(sizes), keys)
    gap = F.abs(
        F.try_divide(F.col("_a_before") + F.col("_a"), F.col("_m"))
        - F.try_divide(F.col("_b_before") + F.col("_b"), F.col("_n"))
    )
    row = both.agg(F.max(gap).alias("_d"), F.max("_m").alias("_m"), F.max("_n").alias("_n"))
    d, m, n = F.col("_d"), F.col("_m").cast("double"), F.col("_n").cast("double")
    lam = F.sqrt(m * n / (m + n)) * d
    series = F.lit(0.0)
    for k in range(1, 101):
        series = series + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    # Below 0.2 the series has not converged after 100 terms, and p is 1 to twelve digits.
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    empty = F.coalesce((F.col("_m") == 0) | (F.col("_n") == 0), F.lit(True))

    @F.pandas_udf("double")
    def exact(m: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        # One row. m n d is a whole number.
        share = [1 - _paths_inside(int(a), int(b), round(a * b * x)) if 0 < a and 0 < b and max(a, b) <= exact_up_to else 0.0 for a, b, x in zip(m, n, d, strict=True)]
        return pd.Series(np.clip(share, 0.0, 1.0))

    small = F.greatest("_m", "_n") <= exact_up_to
    row = settle(row)
    return row.select(
        F.when(empty, 0.0).otherwise(d).alias("ks_statistic"),
        F.when(empty, 1.0).when(small, exact("_m", "_n", "_d")).otherwise(p).alias("ks_pvalue"),
    )


def label_stats(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Mean and population sd of the label per split in one row; an empty split gives 0 (LK7)."""
    aggs = []
    for s in ("train", "val", "test"):
        v = F.when(F.col(split) == s, F.col(label))
        aggs += [
            F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{s}_label_mean"),
            F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{s}_label_std"),
        ]
    return df.agg(*aggs)


def risk(identity: Column, overlap_pct: Column) -> Column:
    """low, moderate or high from the highest identity and the overlap share (LK8)."""
    return (
        F.when((identity < 0.70) & (overlap_pct < 10.0), "low")
        .when((identity > 0.85) | (overlap_pct > 50.0), "high")
        .otherwise("moderate")
    )


def report(
    df: DataFrame,
    key: str,
    sequence: str,
    edits: str,
    label: str,
    scaffold: str,
    profile: str,
    split: str = "split",
) -> DataFrame:
    """All leakage metrics of a split in one row (LK9)."""
    # Built once: the arrays are read for the families alone, everything else comes from a narrow table.
    families = F.transform(edits, lambda e: F.struct(e["edit_family"].alias("edit_family")))
    df = settle(df.select(key, sequence, families.alias(edits), label, scaffold, profile, split))
    parts = [
        sequence_similarity(df, sequence, split),
        mean_identity(df, key, sequence, split),
        key_overlap(df, scaffold, split),
        profile_cosine(df, profile, split),
        js_divergence(df, edits, split=split),
        ks(df, label, split),
        label_stats(df, label, split),
    ]
    # Each part is one row, so these joins on a constant move one row each.
    out = parts[0].withColumn("_all", F.lit(0))
    for part in parts[1:]:
        out = out.join(F.broadcast(part.withColumn("_all", F.lit(0))), "_all")
    level = risk(F.col("max_sequence_identity"), F.col("pct_test_shared_scaffold"))
    return out.withColumn("overall_risk", level).drop("_all")
