"""Statistics over runs: intervals, paired tests, corrections and grouped bootstraps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import draws
from annoframe.functions.joins import join_keys
from annoframe.functions.tquantile import t_975_column
from annoframe.operators import metrics, ranks, replicates as replicated
from annoframe.session import settle, ship

SIGN_FLIP_LIMIT = 44
BOOTSTRAP_REPLICATES = 2000
FAMILY_REPLICATES = 5000
BOOTSTRAP_SEED = 20260717


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str):
    """Wide columns to (name, value) rows; values become doubles."""
    wide = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(list(ids), list(values), name, value)


def t_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, sample_sd, ci95_low, ci95_high and n per group (ST1); n = 1 has no interval."""
    rows, keys = ranks.keyed(df, by)
    agg = rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sample_sd"),
    )
    half = t_975_column(F.col("n") - 1) * F.col("sample_sd") / F.sqrt("n")
    return agg.select(
        *by,
        "n",
        "mean",
        "sample_sd",
        (F.col("mean") - half).alias("ci95_low"),
        (F.col("mean") + half).alias("ci95_high"),
    )


def summary(df: DataFrame, by: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Seed-level wide table to one summary row per group and metric, with rounded text (ST2)."""
    long = melt(df, by, metric_cols, "metric", "value")
    out = t_interval(long, [*by, "metric"], "value").withColumnRenamed("n", "n_completed_seeds")
    text = F.format_string("%.3f (%.3f, %.3f)", "mean", "ci95_low", "ci95_high")
    return out.withColumn("estimate_95ci", text)


def paired_rows(
    df: DataFrame, by: Sequence[str], side: str, left: str, right: str, value: str
) -> DataFrame:
    """One row per ``by`` key that both sides have, with left minus right as ``difference``."""
    agg = (
        df.filter(F.col(side).isin(left, right))
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col(side) == left, F.col(value))).alias("left_value"),
            F.max(F.when(F.col(side) == right, F.col(value))).alias("right_value"),
        )
    )
    out = agg.filter(F.col("left_value").isNotNull() & F.col("right_value").isNotNull())
    return out.withColumn("difference", F.col("left_value") - F.col("right_value"))


def paired_difference(
    df: DataFrame,
    by: Sequence[str],
    seed: str,
    side: str,
    comparisons: Sequence[tuple[str, str]],
    value: str,
) -> DataFrame:
    """Mean seed-wise difference with interval and excludes-zero flag per comparison (ST4).

    Each row of ``df`` is read once and fanned out to the comparisons that use its side.
    """
    rows = compare_long(df, [*by, seed], side, comparisons, value)
    out = t_interval(rows, [*by, "comparison"], "difference")
    zero_out = (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0)
    label = F.when(zero_out, "supported directional difference").otherwise("inconclusive")
    return (
        out.withColumnRenamed("mean", "mean_difference")
        .withColumnRenamed("n", "n_pairs")
        .withColumn("ci_excludes_zero", F.coalesce(zero_out, F.lit(False)))
        .withColumn("interpretation", label)
    )


def compare_long(
    df: DataFrame,
    by: Sequence[str],
    side: str,
    comparisons: Sequence[tuple[str, str]],
    value: str,
) -> DataFrame:
    """(by, comparison, difference) for several left/right pairs in a single pass."""
    options = F.array(
        *[
            F.struct(
                F.lit(f"{a} minus {b}").alias("comparison"),
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
            )
            for a, b in comparisons
        ]
    )
    uses = F.filter(options, lambda o: (o["a"] == F.col(side)) | (o["b"] == F.col(side)))
    rows = df.select(*by, side, value, F.explode(uses).alias("o"))
    agg = rows.groupBy(*by, F.col("o.comparison").alias("comparison")).agg(
        F.max(F.when(F.col("o.a") == F.col(side), F.col(value))).alias("_l"),
        F.max(F.when(F.col("o.b") == F.col(side), F.col(value))).alias("_r"),
    )
    both = agg.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    return both.select(*by, "comparison", (F.col("_l") - F.col("_r")).alias("difference"))


def _half_sums(values: np.ndarray) -> np.ndarray:
    """All sums of the values with either sign, in order."""
    sums = np.zeros(1)
    for v in values:
        # Two ordered lists, shifted down and up, merged by their places in each other.
        low, high = sums - v, sums + v
        out = np.empty(2 * len(sums))
        at = np.arange(len(low)) + np.searchsorted(high, low, side="left")
        out[at] = low
        rest = np.ones(len(out), bool)
        rest[at] = False
        out[rest] = high
        sums = out
    return sums


def _flip_share(values: np.ndarray, slack: float = 1e-15) -> float:
    """Share of the 2^n sign vectors whose mean is at least as far from 0 as that of ``values``.

    The sums of both halves are put in order; for each sum of the first half, those of the second that
    lead beyond the observed sum are a leading and a trailing part, so 2^(n/2) sums stand for 2^n.
    """
    size = np.abs(values)
    # Sums in another order differ in their last digits; those are ties too.
    bound = abs(values.sum()) - slack * len(values) - 1e-13 * size.sum()
    if bound <= 0:
        return 1.0
    left, right = _half_sums(size[::2]), _half_sums(size[1::2])
    above = len(right) - np.searchsorted(right, bound - left, side="left")
    below = np.searchsorted(right, -bound - left, side="right")
    return float(np.sum(above) + np.sum(below)) / float(len(left) * len(right))


def sign_flip(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact two-sided sign-flip permutation p of the mean (ST5).

    Groups of up to ``SIGN_FLIP_LIMIT`` values: a task holds 2^(n/2) sums. More values are an error when their row is
    computed, never NULL; at that size the p of a normal mean says the same.
    """
    rows, keys = ranks.keyed(df.filter(F.col(value).isNotNull()), by)
    ship(df.sparkSession)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    small = join_keys(rows, sizes.filter(F.col("n_pairs") <= SIGN_FLIP_LIMIT), keys)
    lists = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_d"))

    @F.pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _flip_share(np.asarray(v, dtype=float)))

    p = lists.select(*keys, share("_d").alias("p_value_unadjusted"))
    many = F.raise_error(F.concat(F.lit(f"more than {SIGN_FLIP_LIMIT} values in a group: "), F.col("n_pairs").cast("string")))
    checked = F.when(F.col("n_pairs") > SIGN_FLIP_LIMIT, many.cast("double")).otherwise(F.col("p_value_unadjusted"))
    return join_keys(sizes, p, keys, "left").select(*by, "n_pairs", checked.alias("p_value_unadjusted"))


def holm(df: DataFrame, p: str, name: str = "p_value_holm", bucket_rows: int = ranks.BUCKET_ROWS) -> DataFrame:
    """Holm step-down correction over all rows (ST6).

    ``df`` is a table of tests, one row per comparison and metric. Rows with equal p get equal
    corrected values, so the work is done on distinct p values.
    """
    levels, _ = ranks.keyed(df.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")), [])
    # Each pass over buckets reads its input several times.
    levels = settle(levels.filter(F.col("_p").isNotNull()))
    cum = ranks.cumulate(levels, ["_all"], "_p", ["_c"], bucket_rows)
    total = levels.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_m"))
    steps = cum.join(total.withColumn("_all", F.lit(0)), "_all")
    steps = steps.withColumn("_raw", (F.col("_m") - F.col("_c_before")) * F.col("_p"))
    steps = ranks.running_max(settle(steps), ["_all"], "_p", "_raw", "_running", bucket_rows)
    steps = steps.select("_p", F.least(F.lit(1.0), F.col("_running")).alias(name))
    return df.join(steps, df[p] == steps["_p"], "left").drop("_p")


def _group_index(df: DataFrame, by: list[str], group: str, seed: int | str) -> DataFrame:
    groups = df.select(*by, group).distinct().withColumn("_h", draws.unit(seed, group))
    return ranks.dense_index(groups, by, "_h", group, "_g").drop("_h")


def draw_groups(
    df: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int
) -> DataFrame:
    """Bootstrap draws: for each replicate, groups drawn with replacement and their multiplicity.

    A replicate draws as many groups as its ``by`` key has. Draws depend on (replicate, slot)
    only, so every model scored on the same groups sees the same draw.
    """
    by = list(by)
    indexed = _group_index(df, by, group, seed)
    sizes = indexed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # Each group is also one slot; its replicates explode from its own row, so the draws of a
    # single large ``by`` key are spread over tasks.
    slots = indexed.join(sizes, by).select(
        *by,
        "_n",
        F.col("_g").alias("_slot"),
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"),
    )
    picks = slots.select(
        *by, "replicate", draws.below(F.col("_n"), seed, "replicate", "_slot").alias("_g")
    )
    counted = picks.groupBy(*by, "replicate", "_g").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counted.join(indexed, [*by, "_g"]).drop("_g")


def _error_sums(df: DataFrame, keys: list[str], truth: str, preds: dict[str, str]) -> DataFrame:
    """Per-group sums from which rmse, mae and r2 of any resample follow."""
    t = F.col(truth).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(t).alias("sy"), F.sum(t * t).alias("syy")]
    for tag, pred in preds.items():
        e = t - F.col(pred).cast("double")
        aggs += [F.sum(e * e).alias(f"sse{tag}"), F.sum(F.abs(e)).alias(f"sae{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def _group_sums(rows: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """``_error_sums`` of rows that stand for ``_c`` equal ones, with the mean of the truth and its squared deviations."""
    t, c = F.col(truth), F.col("_c")
    e = t - F.col(pred)
    aggs = {"n": F.sum(c), "sy": F.sum(t * c), "syy": F.sum(t * t * c), "sse": F.sum(e * e * c), "sae": F.sum(F.abs(e) * c)}
    sums = rows.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]).withColumn("_mean", F.col("sy") / F.col("n"))
    off = t - F.col("_mean")
    spread = join_keys(rows, sums.select(*keys, "_mean"), keys).groupBy(*keys).agg(F.sum(off * off * c).alias("_m2"))
    return join_keys(sums, spread, keys)


def _point(sums: DataFrame, keys: list[str]) -> DataFrame:
    """r2, rmse and mae of all rows from ``_group_sums``, as ``metrics.regression`` has them."""
    n = F.col("n")
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae")], (F.sum(F.col("_mean") * n) / F.sum("n")).alias("_all_mean"))
    off = F.col("_mean") - F.col("_all_mean")
    spread = join_keys(sums.select(*keys, "_mean", "_m2", F.col("n").alias("_n")), total, keys)
    spread = spread.groupBy(*keys, "n", "sse", "sae").agg(F.sum(F.col("_m2") + off * off * F.col("_n")).alias("_sst"))
    scores = {"r2": metrics.r2_of(F.col("sse"), F.col("_sst")), "rmse": F.sqrt(F.col("sse") / n), "mae": F.col("sae") / n}
    return spread.select(*keys, *[F.when(n >= 2, c).alias(k) for k, c in scores.items()])


def _weighted(sums: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    w = F.col("multiplicity")
    return sums.groupBy(*keys).agg(*[F.sum(F.col(c) * w).alias(c) for c in cols])


def _scores(tag: str = "") -> dict[str, Column]:
    n, sse = F.col("n"), F.col(f"sse{tag}")
    # Sums of squares lose digits: a spread below 1e-12 of the raw power counts as constant.
    raw = F.col("syy") - F.col("sy") * F.col("sy") / n
    sst = F.when(raw > F.abs("syy") * 1e-12, raw).otherwise(0.0)
    return {
        "r2": metrics.r2_of(sse, sst),
        "rmse": F.sqrt(sse / n),
        "mae": F.col(f"sae{tag}") / n,
    }


def _interval(reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    # A group holds at most ``replicates`` values, so the exact built-in percentile is bounded.
    return reps.groupBy(*keys).agg(
        F.percentile(value, 0.025).alias("ci95_low"),
        F.percentile(value, 0.975).alias("ci95_high"),
    )


def group_bootstrap(
    df: DataFrame,
    by: Sequence[str],
    group: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    with_spearman: bool = True,
) -> DataFrame:
    """Percentile interval of r2, rmse, mae and spearman with whole groups resampled (ST7).

    The first three come from per-group sums, so their cost is replicates x groups. Spearman
    orders the rows once for all replicates (``replicates.spearman``), of which number 0 has every group once.
    """
    df, keys = ranks.keyed(metrics.clean(df, truth, pred).filter(F.col(truth).isNotNull()), by)
    if with_spearman:
        # Whatever the rows cost, they are read once.
        rows = settle(df.groupBy(*keys, group, truth, pred).agg(F.count(F.lit(1)).alias("_c")))
        sums = settle(_group_sums(rows, [*keys, group], truth, pred))
        point = _point(sums, keys)
    else:
        # One row per group, used by the draws and by every replicate.
        sums = settle(_error_sums(df, [*keys, group], truth, {"": pred}))
        point = metrics.regression(df, keys, truth, pred).select(*keys, "r2", "rmse", "mae")
    picks = draw_groups(sums, keys, group, replicates, seed)
    cols = ["n", "sy", "syy", "sse", "sae"]
    reps = _weighted(picks.join(sums, [*keys, group]), [*keys, "replicate"], cols)
    reps = reps.select(*keys, "replicate", *[c.alias(k) for k, c in _scores().items()])
    long = melt(reps, [*keys, "replicate"], ["r2", "rmse", "mae"], "metric", "value")
    base = melt(point, keys, ["r2", "rmse", "mae"], "metric", "estimate")
    if with_spearman:
        every = sums.select(*keys, group, F.lit(0).alias("replicate"), F.lit(1).cast("bigint").alias("multiplicity"))
        found = settle(replicated.spearman(rows, keys, group, truth, pred, picks.unionByName(every), weight="_c"))
        rho, one = found.filter("replicate > 0"), found.filter("replicate = 0")
        long = long.unionByName(
            rho.select(*keys, "replicate", F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))
        )
        base = base.unionByName(
            one.select(*keys, F.lit("spearman").alias("metric"), F.col("spearman").alias("estimate"))
        )
    out = base.join(_interval(long, [*keys, "metric"], "value"), [*keys, "metric"])
    return out.select(
        *by, "metric", "estimate", "ci95_low", "ci95_high", F.lit(replicates).alias("replicates")
    )


def align_predictions(
    left: DataFrame, right: DataFrame, key: str, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Predictions of two models on the same rows, kept where both report the same truth (JN2)."""
    a = left.select(key, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred_x"))
    b = right.select(key, F.col(truth).alias("_y"), F.col(pred).alias("y_pred_y"))
    return a.join(b, key).filter(F.col("y_true") == F.col("_y")).drop("_y")


def attach_groups(predictions: DataFrame, groups: DataFrame, key: str, group: str):
    """Look up the resampling group of each row (JN3): (rows with a group, rows without one)."""
    joined = predictions.join(groups.select(key, group), key, "left")
    return joined.filter(F.col(group).isNotNull()), joined.filter(F.col(group).isNull())


def group_bootstrap_diff(
    df: DataFrame,
    by: Sequence[str],
    group: str,
    truth: str = "y_true",
    pred_x: str = "y_pred_x",
    pred_y: str = "y_pred_y",
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    with_spearman: bool = True,
) -> DataFrame:
    """Interval of the metric difference x - y, both models seeing the same draw (ST8)."""
    df, keys = ranks.keyed(df, by)
    sums = settle(_error_sums(df, [*keys, group], truth, {"_x": pred_x, "_y": pred_y}))
    picks = draw_groups(sums, keys, group, replicates, seed)
    names = ["r2", "rmse", "mae"]

    def differences(sums: DataFrame, extra: list[str]) -> DataFrame:
        x, y = _scores("_x"), _scores("_y")
        wide = sums.select(*keys, *extra, *[(x[m] - y[m]).alias(m) for m in names])
        return melt(wide, [*keys, *extra], names, "metric", "value")

    cols = ["n", "sy", "syy", "sse_x", "sae_x", "sse_y", "sae_y"]
    reps = differences(_weighted(picks.join(sums, [*keys, group]), [*keys, "replicate"], cols), ["replicate"])
    total = _weighted(sums.withColumn("multiplicity", F.lit(1)), keys, cols)
    base = differences(total, [])
    if with_spearman:

        def rho(at: list[str], of) -> DataFrame:
            a, b = of(pred_x), of(pred_y)
            both = a.join(b.withColumnRenamed("spearman", "_b"), at)
            return both.select(
                *at, F.lit("spearman").alias("metric"), (F.col("spearman") - F.col("_b")).alias("value")
            )

        reps = reps.unionByName(rho([*keys, "replicate"], lambda pred: replicated.spearman(df, keys, group, truth, pred, picks)))
        base = base.unionByName(rho(keys, lambda pred: metrics.spearman(df, keys, truth, pred)))
    out = base.withColumnRenamed("value", "observed_difference").join(
        _interval(reps, [*keys, "metric"], "value"), [*keys, "metric"]
    )
    return out.select(
        *by,
        "metric",
        "observed_difference",
        "ci95_low",
        "ci95_high",
        F.lit(replicates).alias("replicates"),
    )


def mean_bootstrap(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    value: str,
    replicates: int = FAMILY_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
) -> DataFrame:
    """Mean over units with a percentile interval from resampled units (ST9).

    ``df`` has one row per (by, unit); NULL and NaN values are dropped first.
    """
    v = F.col(value).cast("double")
    rows, keys = ranks.keyed(df.filter(v.isNotNull() & ~F.isnan(v)), by)
    rows = settle(rows.select(*keys, unit, v.alias("_v")))
    picks = draw_groups(rows, keys, unit, replicates, seed).join(rows, [*keys, unit])
    w = F.col("multiplicity")
    reps = picks.groupBy(*keys, "replicate").agg((F.sum(F.col("_v") * w) / F.sum(w)).alias("_m"))
    point = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.avg("_v").alias("mean"))
    out = point.join(_interval(reps, keys, "_m"), keys)
    return out.select(*by, "n_units", "mean", "ci95_low", "ci95_high")


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 16 on (error below 1e-15 of the value)."""
    x = n.cast("double") + 1 + 16
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
    series = series + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    product = F.lit(1.0)
    for k in range(1, 17):
        product = product * (n.cast("double") + k)
    return series - F.log(product)


def binomial_tail(n: Column, k: Column) -> Column:
    """min(1, 2 P(X <= k)) for X ~ Binomial(n, 1/2), from the largest term down.

    Terms fall at least like those of a normal tail: beyond 5 sqrt(n) + 50 they are below double precision.
    """
    largest = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0))
    lowest = F.greatest(F.lit(0), k - F.ceil(5 * F.sqrt(n.cast("double"))) - 50).cast("bigint")
    start = F.struct(largest.alias("term"), F.lit(0.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        j = k - i + lowest  # k down to lowest
        below = a["term"] * j / (n - j + 1)
        return F.struct(below.alias("term"), (a["s"] + a["term"]).alias("s"))

    walk = F.aggregate(F.sequence(lowest, k.cast("bigint")), start, step)
    return F.least(F.lit(1.0), 2 * walk["s"])


def sign_test(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact two-sided sign test and improved / tied / worsened shares (ST10); ties leave n."""
    rows, keys = ranks.keyed(df.filter(F.col(value).isNotNull()), by)
    v = F.col(value)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(v > 0).alias("_pos"),
        F.count_if(v < 0).alias("_neg"),
    )
    n, low = F.col("_pos") + F.col("_neg"), F.least("_pos", "_neg")
    p = F.when(F.col("_pos") == F.col("_neg"), F.lit(1.0)).otherwise(binomial_tail(n, low))
    tied = F.col("n_units") - n
    return agg.select(
        *by,
        "n_units",
        (F.col("_pos") / F.col("n_units")).alias("proportion_improved"),
        (tied / F.col("n_units")).alias("proportion_tied"),
        (F.col("_neg") / F.col("n_units")).alias("proportion_worsened"),
        p.alias("exact_sign_test_p"),
    )


def association(
    df: DataFrame, by: Sequence[str], metric: str, diagnostics: Sequence[str]
) -> DataFrame:
    """Spearman of one metric with each diagnostic over the points of a group (ST11)."""
    long = melt(df, [*by, metric], diagnostics, "diagnostic", "_d")
    rho = metrics.spearman(long, [*by, "diagnostic"], metric, "_d")
    n = long.groupBy(*by, "diagnostic").agg(F.count("_d").alias("n_cutoffs"))
    out = join_keys(rho, n, [*by, "diagnostic"])
    return out.withColumnRenamed("spearman", "cutoff_level_spearman")


def matrix(
    df: DataFrame,
    row: str,
    col: str,
    columns: Sequence[str],
    value: str,
    base: str | None = None,
    full: str | None = None,
) -> DataFrame:
    """Mean of ``value`` per (row, column) in a fixed column order, optionally with a flag that
    the full set beats the base set (ST12)."""
    out = df.groupBy(row).pivot(col, list(columns)).agg(F.avg(value))
    if base and full:
        better = F.coalesce(F.col(f"`{full}`") > F.col(f"`{base}`"), F.lit(False))
        out = out.withColumn("trend_consistent", better)
    return out


def mean_prediction(
    df: DataFrame, by: Sequence[str], key: str, truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Mean prediction over seeds per row id (ST14); rows are aligned by id."""
    return df.groupBy(*by, key).agg(
        F.min(truth).alias("y_true"), F.avg(pred).alias("y_pred"), F.count(pred).alias("n_seeds")
    )


def bin2d(
    df: DataFrame, by: Sequence[str], x: str, y: str, width_x: float, width_y: float
) -> DataFrame:
    """Counts on a square grid of truth against prediction (ST15)."""
    bx = F.floor(F.col(x) / F.lit(width_x)).cast("bigint")
    by_ = F.floor(F.col(y) / F.lit(width_y)).cast("bigint")
    return df.groupBy(*by, bx.alias("bin_x"), by_.alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n")
    )
