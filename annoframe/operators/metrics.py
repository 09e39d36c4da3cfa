"""Regression and ranking metrics, grouped by any run keys.

Everything is one aggregate per metric family, so thousands of runs are scored in one job and a
run that holds most of the rows is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import draws
from annoframe.functions.joins import join_keys
from annoframe.operators import ranks
from annoframe.session import ship

KEY_METRICS = ("rmse", "mae", "r2", "spearman")


def finite(col: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def clean(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``truth`` and ``pred`` as doubles, both NULL unless both are finite (ME1)."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    ok = finite(t) & finite(p)
    return df.withColumns({truth: F.when(ok, t), pred: F.when(ok, p)})


def r2_of(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant truth scores 1 when predicted exactly and 0 otherwise."""
    return F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))


def regression(
    df: DataFrame, by: Sequence[str], truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """n_samples, rmse, mae, r2, pearson and variance_ratio per group (ME1-ME4, ME7).

    Non-finite pairs are dropped; fewer than two left gives NULL metrics.
    """
    rows, keys = ranks.keyed(clean(df, truth, pred), by)
    err = F.col(truth) - F.col(pred)
    agg = rows.groupBy(*keys).agg(
        F.count(truth).alias("n_samples"),
        F.sum(err * err).alias("_sse"),
        F.avg(F.abs(err)).alias("_mae"),
        F.var_pop(truth).alias("_vt"),
        F.var_pop(pred).alias("_vp"),
        F.covar_pop(truth, pred).alias("_cov"),
    )
    enough = F.col("n_samples") >= 2
    n = F.col("n_samples")
    return agg.select(
        *by,
        "n_samples",
        F.when(enough, F.sqrt(F.col("_sse") / n)).alias("rmse"),
        F.when(enough, F.col("_mae")).alias("mae"),
        F.when(enough, r2_of(F.col("_sse"), F.col("_vt") * n)).alias("r2"),
        F.when(
            enough & (F.col("_vt") > 0) & (F.col("_vp") > 0),
            F.col("_cov") / (F.sqrt("_vt") * F.sqrt("_vp")),
        ).alias("pearson"),
        F.when(
            enough, F.when(F.col("_vt") > 0, F.col("_vp") / F.col("_vt")).otherwise(0.0)
        ).alias("variance_ratio"),
    )


def _distinct_pairs(
    df: DataFrame, by: Sequence[str], x: str, y: str, weight: str | None
) -> DataFrame:
    """Weighted distinct (x, y) per group: hot repeated values collapse before any sort."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    rows = clean(df, x, y).filter(F.col(x).isNotNull())
    return rows.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(
        w.cast("bigint").alias("_w")
    )


def _mid_ranks(pairs: DataFrame, by: Sequence[str], value: str, name: str, rows: int) -> DataFrame:
    sums = pairs.groupBy(*by, value).agg(F.sum("_w").alias("_m"))
    cum = ranks.cumulate(sums, by, value, ["_m"], bucket_rows=rows)
    mid = F.col("_m_before") + (F.col("_m") + 1) / 2
    return cum.select(*by, value, mid.alias(name))


def spearman(
    df: DataFrame,
    by: Sequence[str],
    x: str = "y_true",
    y: str = "y_pred",
    weight: str | None = None,
    bucket_rows: int = ranks.BUCKET_ROWS,
) -> DataFrame:
    """Spearman correlation with average ranks per group (ME5); ``weight`` repeats rows."""
    base, keys = ranks.keyed(df, by)
    pairs = _distinct_pairs(base, keys, x, y, weight)
    ranked = join_keys(pairs, _mid_ranks(pairs, keys, "_x", "_rx", bucket_rows), [*keys, "_x"])
    ranked = join_keys(ranked, _mid_ranks(pairs, keys, "_y", "_ry", bucket_rows), [*keys, "_y"])
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    agg = ranked.groupBy(*keys).agg(
        F.sum(w).alias("_n"),
        F.sum(w * rx * ry).alias("_sxy"),
        F.sum(w * rx * rx).alias("_sxx"),
        F.sum(w * ry * ry).alias("_syy"),
    )
    n = F.col("_n").cast("double")
    shift = n * (n + 1) * (n + 1) / 4
    vx, vy = F.col("_sxx") - shift, F.col("_syy") - shift
    rho = F.when((vx > 0) & (vy > 0), (F.col("_sxy") - shift) / F.sqrt(vx * vy))
    return agg.select(*by, rho.alias("spearman"))


def grouped_inversions(
    group: np.ndarray, first: np.ndarray, second: np.ndarray, weight: np.ndarray
) -> np.ndarray:
    """Per group number 0..g-1: sum of w_i*w_j over pairs with first_i < first_j and
    second_i > second_j, all groups at once.

    Rows are ordered by (group, first, second) and ranked by (group, second), so an inversion of
    ranks is an inversion within a group. Inversions are counted bit by bit of the rank.
    """
    total = np.zeros(int(group.max()) + 1, dtype=np.int64)
    by_second = np.lexsort((second, group))
    new = np.ones(len(group), dtype=bool)
    new[1:] = (np.diff(group[by_second]) != 0) | (
        second[by_second][1:] != second[by_second][:-1]
    )
    rank = np.empty(len(group), dtype=np.int64)
    rank[by_second] = np.cumsum(new) - 1
    order = np.lexsort((second, first, group))
    rank, w, g = rank[order], weight[order].astype(np.int64), group[order]
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        block = np.argsort(rank >> (bit + 1), kind="stable")
        head = (rank >> (bit + 1))[block]
        one = ((rank[block] >> bit) & 1).astype(bool)
        run = np.cumsum(np.where(one, w[block], 0))
        start = np.searchsorted(head, head, side="left")
        earlier = run - np.where(start > 0, run[start - 1], 0)
        np.add.at(total, g[block][~one], (earlier * w[block])[~one])
    return total


def _counter(keys: Sequence[str], first: str, second: str):
    """Batch function over rows sorted by ``keys``; the last group of a batch waits for the next."""
    keys = list(keys)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        out = pdf[keys].drop_duplicates(ignore_index=True)
        out["_inv"] = grouped_inversions(
            groups, pdf[first].to_numpy(), pdf[second].to_numpy(), pdf["_w"].to_numpy()
        )
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            numbers = pdf.groupby(keys, sort=False, dropna=False).ngroup()
            open_group = numbers == numbers.iloc[-1]
            if not open_group.all():
                yield count(pdf[~open_group])
            held = pdf[open_group]
        if held is not None and len(held):
            yield count(held)

    return run


def inversions(
    pairs: DataFrame, by: Sequence[str], bucket_rows: int = ranks.BUCKET_ROWS
) -> DataFrame:
    """Weighted count of pairs with _x rising and _y falling, per group, without making pairs.

    Both axes are cut into buckets. A pair in different buckets on both axes is counted on the
    bucket grid; a pair sharing a bucket is counted inside it. A task streams over many small
    groups and never holds more than one bucket of a large one.
    """
    by = list(by)
    rows = ranks.with_bucket(pairs, by, "_x", "_bx", bucket_rows)
    rows = ranks.with_bucket(rows, by, "_y", "_by", bucket_rows)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    schema = key_ddl + ", _inv bigint"

    def counted(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
        extra = [k for k in keys if k not in by]
        full = schema if not extra else key_ddl + ", " + ", ".join(f"{k} bigint" for k in extra) + ", _inv bigint"
        ready = df.select(*dict.fromkeys([*keys, first, second, "_w"]))
        ready = ready.repartition(*keys).sortWithinPartitions(*keys)
        ship(df.sparkSession)
        return ready.mapInPandas(_counter(keys, first, second), full).select(*by, "_inv")

    grid = rows.groupBy(*by, "_bx", "_by").agg(F.sum("_w").alias("_w"))
    same_x = counted(rows.filter(F.col("_bx") % 2 == 0), [*by, "_bx"], "_x", "_y")
    # A group in one bucket is finished by same_x; only cut groups have more to count.
    cut = grid.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells")).filter(F.col("_cells") > 1)
    across = counted(join_keys(grid, cut, by, "left_semi"), by, "_bx", "_by")
    large = join_keys(rows, cut, by, "left_semi").filter(F.col("_by") % 2 == 0)
    large = large.groupBy(*by, "_by", "_bx", "_y").agg(F.sum("_w").alias("_w"))
    same_y = counted(large, [*by, "_by"], "_bx", "_y")
    parts = across.unionByName(same_x).unionByName(same_y)
    return parts.groupBy(*by).agg(F.sum("_inv").alias("inversions"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_counts(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "y_true",
    pred: str = "y_pred",
    order: str | None = None,
    bucket_rows: int = ranks.BUCKET_ROWS,
) -> DataFrame:
    """Counts over all unordered pairs of a group (JN6): total, tied on truth, on prediction, on
    both, concordant, discordant.

    With a numeric, per-group unique ``order`` column it adds ``tied_rising``: pairs tied on the
    prediction whose truth rises in that order. No pair is ever materialised.
    """
    base, keys = ranks.keyed(df, by)
    pairs = _distinct_pairs(base, keys, truth, pred, None)
    both = pairs.groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.sum(_choose2(F.col("_w"))).alias("tied_both")
    )
    tx = pairs.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"))
    tx = tx.groupBy(*keys).agg(F.sum(_choose2(F.col("_w"))).alias("tied_truth"))
    ty = pairs.groupBy(*keys, "_y").agg(F.sum("_w").alias("_w"))
    ty = ty.groupBy(*keys).agg(F.sum(_choose2(F.col("_w"))).alias("tied_pred"))
    out = join_keys(join_keys(both, tx, keys), ty, keys)
    out = (
        join_keys(out, inversions(pairs, keys, bucket_rows), keys, "left")
        .withColumn("total", _choose2(F.col("n")))
        .withColumn("discordant", F.coalesce(F.col("inversions"), F.lit(0)).cast("double"))
    )
    out = out.withColumn(
        "concordant",
        F.col("total")
        - F.col("tied_truth")
        - F.col("tied_pred")
        + F.col("tied_both")
        - F.col("discordant"),
    )
    counts = ["total", "tied_truth", "tied_pred", "tied_both", "concordant", "discordant"]
    if order is not None:
        out = join_keys(out, _tied_rising(base, keys, truth, pred, order, bucket_rows), keys, "left")
        out = out.withColumn("tied_rising", F.coalesce("tied_rising", F.lit(0.0)))
        counts.append("tied_rising")
    return out.select(*by, "n", *[F.col(c).cast("bigint").alias(c) for c in counts])


def _tied_rising(
    base: DataFrame, keys: Sequence[str], truth: str, pred: str, order: str, bucket_rows: int
) -> DataFrame:
    """Pairs inside a prediction tie whose truth rises with ``order``."""
    rows = clean(base, truth, pred).filter(F.col(truth).isNotNull())
    rows = rows.select(
        *keys, F.col(pred).alias("_p"), F.col(order).alias("_x"), F.col(truth).alias("_y")
    ).withColumn("_w", F.lit(1).cast("bigint"))
    groups = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_s"))
    groups = groups.filter(F.col("_s") > 1)
    tied = join_keys(rows, groups.drop("_s"), [*keys, "_p"], "left_semi")
    same = tied.groupBy(*keys, "_p", "_y").agg(F.count(F.lit(1)).alias("_s"))
    same = same.groupBy(*keys).agg(F.sum(_choose2(F.col("_s"))).alias("_same"))
    every = groups.groupBy(*keys).agg(F.sum(_choose2(F.col("_s"))).alias("_all_pairs"))
    falling = inversions(tied, [*keys, "_p"], bucket_rows)
    falling = falling.groupBy(*keys).agg(F.sum("inversions").alias("_fall"))
    out = join_keys(join_keys(every, same, keys), falling, keys, "left")
    rising = F.col("_all_pairs") - F.col("_same") - F.coalesce("_fall", F.lit(0))
    return out.select(*keys, rising.alias("tied_rising"))


def kendall(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "y_true",
    pred: str = "y_pred",
    bucket_rows: int = ranks.BUCKET_ROWS,
) -> DataFrame:
    """Kendall tau-b per group (ME6), exact at any group size."""
    c = pair_counts(df, by, truth, pred, bucket_rows=bucket_rows)
    scale = F.sqrt(
        (F.col("total") - F.col("tied_truth")).cast("double")
        * (F.col("total") - F.col("tied_pred")).cast("double")
    )
    tau = F.when(scale > 0, (F.col("concordant") - F.col("discordant")) / scale)
    return c.select(*by, tau.alias("kendall_tau"))


def _top_flags(
    rows: DataFrame, keys: Sequence[str], value: str, key: str, share: float, flag: str
) -> DataFrame:
    """Flag the k = max(1, int(share*n)) largest rows per group; ties follow a hash of the key."""
    keys = list(keys)
    items = rows.withColumn("_neg", -F.col(value)).withColumn("_h", draws.unit(flag, key))
    items = ranks.with_bucket(items, keys, "_neg", "_vb")
    hot = F.when(F.col("_vb") % 2 == 1, ranks.hash_bucket(F.col("_h"))).otherwise(F.lit(0))
    items = items.withColumn("_b", F.col("_vb") * (1 << 17) + hot).withColumn("_one", F.lit(1))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    targets = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    targets = targets.select(*keys, k.alias("_k"))
    order = ["_neg", "_h", key]
    cut = ranks.crossing(items, keys, "_b", order, "_one", targets, "_k")
    cut = cut.select(*keys, F.struct(*order).alias("_cut"), F.col("_k").alias(f"_k_{flag}"))
    out = join_keys(items, cut, keys)
    out = out.withColumn(flag, F.struct(*order) <= F.col("_cut"))
    return out.drop("_neg", "_h", "_vb", "_b", "_one", "_cut")


def topk_overlap(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    share: float = 0.1,
) -> DataFrame:
    """Share of the true top k that is in the predicted top k (ME8), as top_k_enrichment."""
    rows, keys = ranks.keyed(clean(df, truth, pred), by)
    rows = rows.filter(F.col(truth).isNotNull()).select(*keys, key, truth, pred)
    rows = _top_flags(rows, keys, truth, key, share, "in_truth")
    rows = _top_flags(rows, keys, pred, key, share, "in_pred")
    agg = rows.groupBy(*keys).agg(
        F.count_if(F.col("in_truth") & F.col("in_pred")).alias("_hit"),
        F.max("_k_in_truth").alias("_k"),
    )
    return agg.select(*by, (F.col("_hit") / F.col("_k")).alias("top_k_enrichment"))


def pairwise_accuracy(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    bucket_rows: int = ranks.BUCKET_ROWS,
) -> DataFrame:
    """Ranking accuracy over all pairs with different truth (ME9, exact form).

    A pair (i before j in ``order``) is right when "truth falls" equals "prediction falls", so a
    predicted tie counts only where the truth does not fall. No valid pair gives 0.5.
    """
    c = pair_counts(df, by, truth, pred, order, bucket_rows)
    valid = F.col("total") - F.col("tied_truth")
    right = F.col("concordant") + F.col("tied_rising")
    return c.select(
        *by,
        valid.alias("valid_pairs"),
        right.alias("correct_pairs"),
        F.when(valid > 0, right / valid).otherwise(0.5).alias("pairwise_ranking_accuracy"),
    )


def sampled_pairwise_accuracy(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    max_pairs: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Ranking accuracy over min(max_pairs, n(n-1)/2) hashed draws of two rows (ME9, sampled)."""
    rows, keys = ranks.keyed(clean(df, truth, pred), by)
    rows = rows.filter(F.col(truth).isNotNull()).select(*keys, key, truth, pred)
    rows = rows.withColumn("_h", draws.unit(seed, key))
    rows = ranks.dense_index(rows, keys, "_h", key, "_i").drop("_h")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    wanted = F.least(F.lit(max_pairs).cast("bigint"), F.floor(_choose2(n)))
    sets = sizes.filter(n >= 2).select(*keys, "_n", F.explode(F.sequence(F.lit(1), wanted)).alias("_d"))
    i = draws.below(n, f"{seed}:i", "_d")
    step = draws.below(n - 1, f"{seed}:j", "_d") + 1
    sets = sets.withColumn("_i", i).withColumn("_j", F.pmod(F.col("_i") + step, n))
    left = rows.select(*keys, "_i", F.col(truth).alias("_ti"), F.col(pred).alias("_pi"))
    right = rows.select(
        *keys, F.col("_i").alias("_j"), F.col(truth).alias("_tj"), F.col(pred).alias("_pj")
    )
    seen = join_keys(join_keys(sets, left, [*keys, "_i"]), right, [*keys, "_j"])
    valid = F.col("_ti") != F.col("_tj")
    agree = (F.col("_ti") > F.col("_tj")) == (F.col("_pi") > F.col("_pj"))
    agg = seen.groupBy(*keys).agg(
        F.count_if(valid).alias("valid_pairs"), F.count_if(valid & agree).alias("correct_pairs")
    )
    out = join_keys(sizes, agg, keys, "left")
    acc = F.when(F.col("valid_pairs") > 0, F.col("correct_pairs") / F.col("valid_pairs"))
    return out.select(
        *by,
        F.coalesce("valid_pairs", F.lit(0)).alias("valid_pairs"),
        F.coalesce("correct_pairs", F.lit(0)).alias("correct_pairs"),
        F.coalesce(acc, F.lit(0.5)).alias("pairwise_ranking_accuracy"),
    )


def key_metrics(
    df: DataFrame, by: Sequence[str], truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """rmse, mae, r2 and spearman per group: the set other reports use (ME10)."""
    reg, keys = ranks.keyed(regression(df, by, truth, pred), by)
    rho, _ = ranks.keyed(spearman(df, by, truth, pred), by)
    return join_keys(reg, rho, keys, "left").select(*by, "n_samples", *KEY_METRICS)


def all_metrics(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """Every metric of a run in one row per group (ME1-ME7)."""
    reg, keys = ranks.keyed(regression(df, by, truth, pred), by)
    rho, _ = ranks.keyed(spearman(df, by, truth, pred), by)
    tau, _ = ranks.keyed(kendall(df, by, truth, pred), by)
    out = join_keys(join_keys(reg, rho, keys, "left"), tau, keys, "left")
    enough = F.col("n_samples") >= 2
    return out.select(
        *by,
        "n_samples",
        "rmse",
        "mae",
        "r2",
        F.when(enough, F.col("spearman")).alias("spearman"),
        "pearson",
        F.when(enough, F.col("kendall_tau")).alias("kendall_tau"),
        "variance_ratio",
    )


def evaluate(
    predictions: DataFrame,
    labels: DataFrame,
    key: str,
    by: Sequence[str],
    truth: str = "label",
    pred: str = "y_pred",
) -> DataFrame:
    """Join predictions to labels by row id and score them (ME11)."""
    joined = predictions.join(labels.select(key, F.col(truth).alias("_label")), key)
    return key_metrics(joined, by, "_label", pred)


