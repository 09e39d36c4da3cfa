"""Leak-safe split assignment.

A split is a comparison of a row's (or its group's) hash with exact cut points. Finding the cut
points takes partial aggregates plus one pass over the bucket that holds each cut; assigning is
map-only, so rows of a hot group or stratum are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annoframe.functions import draws
from annoframe.functions.joins import join_keys
from annoframe.operators import ranks
from annoframe.session import settle

TOLERANCE = 0.02
SPLIT_VERSION = "1.0.0"


@dataclass(frozen=True)
class Ratios:
    train: float = 0.70
    val: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        if abs(self.train + self.val + self.test - 1.0) > 1e-8:
            raise ValueError(f"ratios must sum to 1, got {self.train + self.val + self.test}")


def _hashed(df: DataFrame, strata: Sequence[str], key: str, seed: int | str) -> DataFrame:
    return df.withColumn("_h", draws.unit(seed, *strata, key))


def _cuts(
    items: DataFrame, strata: Sequence[str], key: str, sizes: DataFrame, cut_names: Sequence[str]
) -> DataFrame:
    """Exact (hash, key) cut points: ``sizes`` holds per stratum how many items lie below each."""
    strata = list(strata)
    wanted = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("cut"), F.col(c).alias("k")) for c in cut_names]
        )
    )
    targets = sizes.select(*strata, wanted.alias("t")).select(*strata, "t.cut", "t.k")
    targets = targets.filter(F.col("k") > 0)
    rows = items.select(*strata, "_h", key, "_w").withColumn("_b", ranks.hash_bucket(F.col("_h")))
    found = ranks.crossing(rows, strata, "_b", ["_h", key], "_w", targets, "k")
    found = found.withColumn("_at", F.struct("_h", F.col(key).alias("_k")))
    picked = [F.max(F.when(F.col("cut") == c, F.col("_at"))).alias(c) for c in cut_names]
    # Strata without any crossing (all sizes 0) keep NULL cut points: nothing lies below.
    cuts = join_keys(sizes.select(*strata), found.groupBy(*strata).agg(*picked), strata, "left")
    # One row per stratum. Settled, so that using the cuts does not repeat the search for them.
    return settle(cuts)


def _below(cut: str, key: str) -> Column:
    mine = F.struct(F.col("_h"), F.col(key).alias("_k"))
    return F.coalesce(mine <= F.col(cut), F.lit(False))


def _finish(rows: DataFrame, strata: Sequence[str], split: Column, drop: Sequence[str]) -> DataFrame:
    return rows.withColumn("split", split).drop("_h", "_all", "_w", *drop)


def quartile_stratum(df: DataFrame, label: str, name: str = "stratum") -> DataFrame:
    """Number of quartile edges that a label reaches: 0..3 (SP1)."""
    edges = settle(ranks.quantiles(df, label, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}))
    one = df.withColumn("_all", F.lit(0)).join(F.broadcast(edges.withColumn("_all", F.lit(0))), "_all")
    reached = [(F.col(label) >= F.col(q)).cast("int") for q in ("_q1", "_q2", "_q3")]
    return one.withColumn(name, reached[0] + reached[1] + reached[2]).drop("_all", "_q1", "_q2", "_q3")


def _take(
    df: DataFrame, strata: Sequence[str], key: str, share: float, seed: str, flag: str
) -> DataFrame:
    """Flag round(n * share) rows of every stratum, the first in hash order."""
    strata = list(strata)
    rows = _hashed(df, [], key, seed).withColumn("_w", F.lit(1))
    sizes = rows.groupBy(*strata).agg(
        F.floor(F.count(F.lit(1)) * F.lit(share) + 0.5).cast("bigint").alias("_cut")
    )
    cuts = _cuts(rows, strata, key, sizes, ["_cut"])
    out = join_keys(rows, cuts, strata).withColumn(flag, _below("_cut", key))
    return out.drop("_h", "_w", "_cut")


def stratified(
    df: DataFrame,
    key: str,
    strata: str | None = None,
    label: str | None = None,
    ratios: Ratios = Ratios(),
    seed: int = 42,
) -> DataFrame:
    """Random split inside strata: a given column (SP5), or label quartiles (SP1).

    Test rows are taken first; with a label the quartiles are computed again on the rest before
    the validation rows are taken from it.
    """
    if (strata is None) == (label is None):
        raise ValueError("give either strata or label")
    first = df if strata else quartile_stratum(df, label, "_s")
    marked = _take(first, [strata or "_s"], key, ratios.test, f"{seed}:test", "_test")
    rest = marked.filter(~F.col("_test"))
    test = marked.filter("_test")
    if label:
        rest = quartile_stratum(rest.drop("_s"), label, "_s")
    val_share = ratios.val / (ratios.train + ratios.val)
    rest = _take(rest, [strata or "_s"], key, val_share, f"{seed}:val", "_val")
    split = F.when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")
    both = rest.unionByName(test.withColumn("_val", F.lit(False)))
    return both.withColumn("split", split).drop("_test", "_val", "_s")


def by_group(
    df: DataFrame,
    group: str,
    ratios: Ratios = Ratios(),
    seed: int = 42,
    within: Sequence[str] = (),
) -> DataFrame:
    """Whole groups go to one side; ratios are over groups, not rows (SP2, SP3).

    ``within`` splits the groups of each stratum separately (SP6, SP7).
    """
    df, strata = ranks.keyed(df, within)
    salt = [c for c in strata if c != "_all"]
    rows = _hashed(df, salt, group, seed)
    groups = rows.select(*strata, group, "_h").distinct().withColumn("_w", F.lit(1))
    n = F.count(F.lit(1))
    train = F.floor(n * F.lit(ratios.train)).cast("bigint")
    val = F.floor(n * F.lit(ratios.val)).cast("bigint")
    sizes = groups.groupBy(*strata).agg(train.alias("_train"), (train + val).alias("_val"))
    cuts = _cuts(groups, strata, group, sizes, ["_train", "_val"])
    split = (
        F.when(_below("_train", group), "train").when(_below("_val", group), "val").otherwise("test")
    )
    return _finish(join_keys(rows, cuts, strata), strata, split, ["_train", "_val"])


def by_group_fill(
    df: DataFrame, group: str, ratios: Ratios = Ratios(), seed: int = 42
) -> DataFrame:
    """Groups in hash order fill test until it has its share of rows, then val; rest train (SP4).

    A group is placed while the size before it is under the target, so a side can overshoot.
    """
    rows = _hashed(df, [], group, seed).withColumn("_all", F.lit(0))
    groups = rows.groupBy("_all", group, "_h").agg(F.count(F.lit(1)).alias("_w"))
    total = groups.groupBy("_all").agg(F.sum("_w").alias("_n"))
    test_target = F.floor(F.col("_n") * F.lit(ratios.test)).cast("bigint")
    val_target = F.floor(F.col("_n") * F.lit(ratios.val)).cast("bigint")
    items = groups.withColumn("_b", ranks.hash_bucket(F.col("_h")))
    order = ["_h", group]
    goal = total.select("_all", test_target.alias("_t"), val_target.alias("_v"))
    first = ranks.crossing(items, ["_all"], "_b", order, "_w", goal.filter("_t > 0"), "_t")
    first = settle(first)
    # Without a test target nothing is placed in test and the fill of val starts at zero.
    first = goal.select("_all", "_v").join(
        first.select("_all", F.struct("_h", F.col(group).alias("_k")).alias("_test"), "reached"),
        "_all",
        "left",
    )
    goal2 = first.withColumn("_t2", F.coalesce("reached", F.lit(0)) + F.col("_v"))
    second = ranks.crossing(
        items, ["_all"], "_b", order, "_w", goal2.filter("_v > 0").select("_all", "_t2"), "_t2"
    )
    second = settle(second)
    # If val cannot be filled, every remaining group was placed in it.
    second = goal2.select("_all", "_test", "_v").join(
        second.select("_all", F.struct("_h", F.col(group).alias("_k")).alias("_val")), "_all", "left"
    )
    open_val = F.col("_val").isNull() & (F.col("_v") > 0)
    split = (
        F.when(_below("_test", group), "test")
        .when(open_val | _below("_val", group), "val")
        .otherwise("train")
    )
    return _finish(rows.join(F.broadcast(second), "_all"), [], split, ["_test", "_val", "_v"])


def by_derivative(
    df: DataFrame,
    key: str,
    group: str,
    ratios: Ratios = Ratios(),
    seed: int = 42,
) -> DataFrame:
    """Derivative groups stay whole; rows without a group are split one by one (SP7)."""
    unit = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("r:"), F.col(key).cast("string")))
    rows = df.withColumns({"_unit": unit, "_single": F.col(group).isNull().cast("int")})
    return by_group(rows, "_unit", ratios, seed, within=["_single"]).drop("_unit", "_single")


def time_forward(
    df: DataFrame, key: str, year: str, cutoffs: Sequence[int], seed: int = 42
) -> DataFrame:
    """Rows with the cutoffs they serve: ``train_for`` (year before the cutoff) and ``test_for``
    (second half, in hash order, of the rows from the cutoff on) (SP13).

    One row per input row: the cut point of every cutoff is found from a (year, hash bucket)
    table and each row compares its hash with the few cut points.
    """
    cuts = sorted(set(cutoffs))
    rows = _hashed(df, [], key, seed)
    y = F.col(year)
    # A future row serves every cutoff up to its year; only hash buckets are fanned out.
    serves = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= y)
    fan = rows.select(F.explode(serves).alias("_cut"), "_h", key).withColumn("_w", F.lit(1))
    sizes = fan.groupBy("_cut").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("_half"))
    found = _cuts(fan, ["_cut"], key, sizes, ["_half"])
    table = found.groupBy().agg(F.collect_list(F.struct("_cut", "_half")).alias("_cuts"))
    # One row with one entry per cutoff.
    table = table.withColumn("_all", F.lit(0))
    out = rows.withColumn("_all", F.lit(0)).join(F.broadcast(table), "_all")
    mine = F.struct(F.col("_h"), F.col(key).alias("_k"))
    late = F.filter(
        "_cuts", lambda c: (c["_cut"] <= y) & ~F.coalesce(mine <= c["_half"], F.lit(False))
    )
    train_for = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > y)
    return out.withColumns(
        {"train_for": train_for, "test_for": F.array_sort(F.transform(late, lambda c: c["_cut"]))}
    ).drop("_h", "_all", "_cuts")


def support_query(
    df: DataFrame, family: str, order: Sequence[str], min_family: int = 8, share: float = 0.3
) -> DataFrame:
    """Rows of families with at least ``min_family`` rows, marked support or query (SP14).

    ``order`` is numeric: first the trailing number of a name, then the unique row id. The
    first max(3, int(share * n)) are support. ``history_rows`` counts the rows outside the family.
    """
    first, key = order
    sizes = df.groupBy(family).agg(F.count(F.lit(1)).alias("n_family"))
    total = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    sizes = sizes.withColumn("_all", F.lit(0)).join(F.broadcast(total), "_all").select(
        family, "n_family", (F.col("_n") - F.col("n_family")).alias("history_rows")
    )
    big = sizes.filter(F.col("n_family") >= min_family)
    rows = df.join(big, family)
    items = ranks.with_bucket(rows, [family], first, "_vb").withColumn("_w", F.lit(1))
    # Many rows can share one number: such a number has a bucket of its own, cut again by id.
    items = ranks.with_bucket(items, [family, "_vb"], key, "_kb")
    items = items.withColumn("_b", F.struct("_vb", F.when(F.col("_vb") % 2 == 1, F.col("_kb")).otherwise(0).alias("_kb")))
    targets = big.select(
        family, F.greatest(F.lit(3), F.floor(F.col("n_family") * F.lit(share))).alias("n_support")
    )
    cut = ranks.crossing(items, [family], "_b", [first, key], "_w", targets, "n_support")
    cut = settle(cut).select(family, "n_support", F.struct(F.col(first).alias("_a"), F.col(key).alias("_k")).alias("_cut"))
    out = rows.join(cut, family)
    mine = F.struct(F.col(first).alias("_a"), F.col(key).alias("_k"))
    role = F.when(mine <= F.col("_cut"), "support").otherwise("query")
    return out.withColumn("role", role).drop("_cut")


def summary(df: DataFrame, ratios: Ratios = Ratios(), split: str = "split") -> DataFrame:
    """Rows and share per split, with the target and whether it is within +-2% (SP9, SP10)."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    target = (
        F.when(F.col(split) == "train", ratios.train)
        .when(F.col(split) == "val", ratios.val)
        .when(F.col(split) == "test", ratios.test)
    )
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    out = counts.withColumn("share", share).withColumn("target", target)
    return out.withColumn("within_tolerance", F.abs(F.col("share") - F.col("target")) <= TOLERANCE)


def metadata(
    df: DataFrame,
    strategy: str,
    feasibility: DataFrame | None = None,
    ratios: Ratios = Ratios(),
    seed: int = 42,
    split: str = "split",
) -> DataFrame:
    """One-row description of a split: strategy, counts, ratios, seed, feasibility (SP9)."""
    n = lambda s: F.count_if(F.col(split) == s).alias(f"{s}_count")
    row = df.agg(n("train"), n("val"), n("test")).withColumn("_all", F.lit(0))
    if feasibility is None:
        row = row.withColumns({"feasible": F.lit(True), "reason": F.lit(None).cast("string")})
    else:
        row = row.join(feasibility.select("feasible", "reason").withColumn("_all", F.lit(0)), "_all")
    return row.select(
        F.lit(strategy).alias("strategy_name"),
        "feasible",
        "reason",
        "train_count",
        "val_count",
        "test_count",
        F.struct(
            F.lit(ratios.train).alias("train_ratio"),
            F.lit(ratios.val).alias("val_ratio"),
            F.lit(ratios.test).alias("test_ratio"),
        ).alias("strategy_params"),
        F.lit(seed).alias("random_seed"),
        F.lit(SPLIT_VERSION).alias("split_version"),
    )


def with_metadata(
    df: DataFrame, strategy: str, extra: dict[str, str] | None = None, seed: int = 42
) -> DataFrame:
    """Add the per-row ``split_metadata`` map: strategy, split, seed and any key columns (SP9)."""
    pairs = {
        "split_strategy": F.lit(strategy),
        "split_name": F.col("split"),
        "random_seed": F.lit(str(seed)),
        **{k: F.col(c).cast("string") for k, c in (extra or {}).items()},
    }
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return df.withColumn("split_metadata", F.create_map(*flat))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Rows per group, profile or cluster (SP11)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def disjoint(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Ids found in more than one split: counts per pair of splits in one row (JN11)."""
    has = lambda s: F.max((F.col(split) == s).cast("int")).alias(f"_{s}")
    seen = df.groupBy(key).agg(has("train"), has("val"), has("test"))
    both = lambda a, b: F.count_if((F.col(f"_{a}") == 1) & (F.col(f"_{b}") == 1))
    return seen.agg(
        both("train", "val").alias("train_val"),
        both("train", "test").alias("train_test"),
        both("val", "test").alias("val_test"),
    )


def assert_disjoint(df: DataFrame, key: str, split: str = "split") -> None:
    """Raise when an id is in more than one split (JN11)."""
    row = disjoint(df, key, split).first()
    if any(row):
        raise ValueError(
            "split overlap: train/val {train_val}, train/test {train_test}, val/test {val_test}".format(
                **row.asDict()
            )
        )


def _verdict(row: DataFrame, checks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """First failing check gives the reason."""
    reason = F.lit(None).cast("string")
    for bad, text in reversed(list(checks)):
        reason = F.when(bad, text).otherwise(reason)
    keep = [c for c in row.columns if not c.startswith("_")]
    return row.withColumn("reason", reason).select(
        F.col("reason").isNull().alias("feasible"), "reason", *keep
    )


def feasible_random(df: DataFrame, minimum: int = 10) -> DataFrame:
    """Too few rows (SP8)."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"))
    text = F.format_string(f"Too few samples (%d < {minimum})", "n_rows")
    return _verdict(row, [(F.col("n_rows") < minimum, text)])


def feasible_groups(df: DataFrame, group: str, minimum: int = 20, largest: float = 0.5) -> DataFrame:
    """Too few groups, or one group over half of the rows (SP8)."""
    row = distribution(df, group).agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("_max"), F.sum("n").alias("n_rows")
    )
    row = row.withColumn("largest_share", F.col("_max") / F.col("n_rows"))
    few = F.format_string(f"Only %d groups (minimum {minimum} required)", "n_groups")
    big = F.format_string("Largest group contains %.1f%% of data", F.col("largest_share") * 100)
    return _verdict(
        row, [(F.col("n_groups") < minimum, few), (F.col("largest_share") > largest, big)]
    )


def feasible_clusters(df: DataFrame, cluster: str, minimum: int = 20) -> DataFrame:
    """Too few clusters (SP8)."""
    return feasible_groups(df, cluster, minimum, 1.0)


def feasible_profiles(
    df: DataFrame, profile: str, minimum: int = 10, sparse_limit: float = 30.0
) -> DataFrame:
    """More than 30% of the profiles are under the minimum size (SP8)."""
    row = distribution(df, profile).agg(
        F.count(F.lit(1)).alias("n_profiles"), F.count_if(F.col("n") < minimum).alias("n_sparse")
    )
    row = row.withColumn("pct_sparse", F.try_divide(100.0 * F.col("n_sparse"), F.col("n_profiles")))
    text = F.format_string(
        f"%d/%d profiles have <{minimum} samples (%.1f%% sparse)", "n_sparse", "n_profiles", "pct_sparse"
    )
    return _verdict(row, [(F.col("pct_sparse") > sparse_limit, text)])


def feasible_within(df: DataFrame, profile: str, group: str, minimum: int = 5) -> DataFrame:
    """Some profile has too few groups (SP8)."""
    per = df.select(profile, group).distinct().groupBy(profile).agg(F.count(F.lit(1)).alias("_g"))
    row = per.agg(
        F.count(F.lit(1)).alias("n_profiles"), F.count_if(F.col("_g") < minimum).alias("n_sparse")
    )
    text = F.format_string(f"%d profiles have <{minimum} groups", "n_sparse")
    return _verdict(row, [(F.col("n_sparse") > 0, text)])


def feasible_derivatives(
    df: DataFrame, group: str, min_coverage: float = 0.1, max_share: float = 0.2
) -> DataFrame:
    """No derivative group, too low coverage, or one group over 20% of the rows (SP8)."""
    sizes = distribution(df, group)
    row = sizes.agg(
        F.count_if(F.col(group).isNotNull()).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col(group).isNotNull(), F.col("n")).otherwise(0)).alias("_in"),
        F.max(F.when(F.col(group).isNotNull(), F.col("n")).otherwise(0)).alias("_max"),
    )
    row = row.withColumns(
        {
            "coverage": F.col("_in") / F.col("n_rows"),
            "largest_share": F.col("_max") / F.col("n_rows"),
        }
    )
    low = F.format_string("Only %.1f%% of samples in derivative groups", F.col("coverage") * 100)
    big = F.format_string("Largest group contains %.1f%% of data", F.col("largest_share") * 100)
    return _verdict(
        row,
        [
            (F.col("n_groups") == 0, F.lit("No derivative groups identified")),
            (F.col("coverage") < min_coverage, low),
            (F.col("largest_share") > max_share, big),
        ],
    )
