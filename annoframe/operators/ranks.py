"""Exact order statistics without one task ever seeing a whole group.

A value or hash is mapped to an order-preserving bucket, buckets are counted with a partial
aggregate, the small bucket table is prefix-summed, and only the inside of a bucket is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annoframe.functions.joins import join_keys
from annoframe.session import settle

BUCKET_ROWS = 100_000
FAN = 16
#: Keys up to which their edges, some 4 KB each, are sent to every task; a join by few keys would put each key's rows in one task.
SENT_EDGES = 2048
# Leaves 16 of the 60 bits of a draw.
HASH_SHIFT = 44


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``by`` as a non-empty key list: an empty one becomes a constant column ``_all``."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def with_bucket(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str = "_bucket",
    bucket_rows: int = BUCKET_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Add an order-preserving bucket number for ``value`` within ``by`` (non-empty).

    Edges are approximate quantiles per key; keys with at most ``bucket_rows`` rows get one
    bucket. A value equal to an edge has a bucket of its own (odd number), so a value held by
    many rows never shares a bucket with others. Where a key has so many rows that its buckets are too large, they are
    cut again by edges of their own until none has more than twice ``bucket_rows`` rows of different values.
    """
    return _placed(df, by, value, settle(_edges(df, by, value, bucket_rows, fan)), name, bucket_rows, fan)


def _placed(
    df: DataFrame, by: Sequence[str], value: str, edges: DataFrame, name: str, bucket_rows: int, fan: int
) -> DataFrame:
    """Bucket numbers from ``edges``, then from those of each bucket that is still too large."""
    by, leaves = list(by), fan * fan
    whole = edges.agg(F.max("_n").alias("most"), F.count(F.lit(1)).alias("keys")).first()
    out = _bucketed(df, by, value, edges, name, fan, whole["keys"] <= SENT_EDGES)
    if (whole.most or 0) <= leaves * bucket_rows:
        return out
    while True:
        size = out.groupBy(*by, name).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        full = settle(size.filter((F.col("_n") > 2 * bucket_rows) & (F.col("_lo") < F.col("_hi"))).select(*by, name))
        if full.isEmpty():
            return out
        inner = join_keys(out, full, [*by, name], "left_semi")
        inside = settle(_edges(inner, [*by, name], value, bucket_rows, fan))
        cut = _bucketed(out, [*by, name], value, inside, "_inner", fan, inside.count() <= SENT_EDGES, "left")
        out = cut.withColumn(name, F.col(name) * (2 * leaves + 2) + F.col("_inner")).drop("_inner")


def _edges(df: DataFrame, by: Sequence[str], value: str, bucket_rows: int, fan: int) -> DataFrame:
    """Per key: row count, approximate quantile edges, and every ``fan``-th of them."""
    by = list(by)
    probs = [i / (fan * fan) for i in range(1, fan * fan)]
    edges = df.groupBy(*by).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, probs, F.lit(10_000)).alias("_fine_edges"),
    )
    return edges.select(
        *by,
        "_n",
        F.when(
            (F.col("_n") > bucket_rows) & F.col("_fine_edges").isNotNull(),
            F.array_distinct(F.transform("_fine_edges", lambda e: e.cast("double"))),
        )
        .otherwise(F.array().cast("array<double>"))
        .alias("_fine_edges"),
    ).withColumn(
        "_coarse_edges",
        F.filter("_fine_edges", lambda e, i: F.pmod(i + 1, F.lit(fan)) == 0),
    )


def _bucketed(
    df: DataFrame, by: Sequence[str], value: str, edges: DataFrame, name: str, fan: int, few: bool, how: str = "inner"
) -> DataFrame:
    x = F.col(value).cast("double")
    # Without keys there is one row of edges; with the constant key folded away it must be the built side.
    sides = F.broadcast(edges.drop("_n")) if few else edges.drop("_n")
    joined = join_keys(df, sides, by, how)
    if how == "left":
        none = F.array().cast("array<double>")
        joined = joined.withColumns({c: F.coalesce(c, none) for c in ("_fine_edges", "_coarse_edges")})
    coarse = F.size(F.filter("_coarse_edges", lambda e: e < x))
    joined = joined.withColumn("_coarse_edges", coarse)
    fine = F.size(F.filter(F.slice("_fine_edges", F.col("_coarse_edges") * fan + 1, fan), lambda e: e < x))
    below = F.when(F.size("_fine_edges") == 0, F.lit(0)).otherwise(F.col("_coarse_edges") * fan + fine)
    joined = joined.withColumn("_coarse_edges", below)
    at_edge = F.coalesce((F.get("_fine_edges", F.col("_coarse_edges")) == x).cast("int"), F.lit(0))
    return joined.withColumn(name, (F.col("_coarse_edges") * 2 + at_edge).cast("bigint")).drop("_coarse_edges", "_fine_edges")


def cumulate(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Sequence[str],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``<measure>_before``: the sum of each measure over rows with a smaller value.

    ``df`` holds one row per (by, value); the caller aggregates copies first.
    """
    by = list(by)
    rows = with_bucket(df, by, value, bucket_rows=bucket_rows)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = join_keys(rows, offsets, [*by, "_bucket"])
    for m in measures:
        out = out.withColumn(
            f"{m}_before", F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        )
    return out.drop("_bucket", *[f"_o_{m}" for m in measures])


def running_max(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measure: str,
    name: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``name``: the largest ``measure`` over rows with this value or a smaller one."""
    by = list(by)
    rows = with_bucket(df, by, value, bucket_rows=bucket_rows)
    tops = rows.groupBy(*by, "_bucket").agg(F.max(measure).alias("_top"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(*by, "_bucket", F.max("_top").over(earlier).alias("_before"))
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    out = join_keys(rows, offsets, [*by, "_bucket"])
    return out.withColumn(name, F.greatest(F.max(measure).over(inside), "_before")).drop("_bucket", "_before")


def crossing(
    items: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[str],
    weight: str,
    targets: DataFrame,
    target: str,
) -> DataFrame:
    """For each target, the first item in order whose running weight reaches it.

    ``targets`` has ``by`` plus its own columns; the result has them, the ``order`` columns of
    the item and ``reached`` (the running weight including the item). Only items in the bucket
    that holds a crossing are sorted.
    """
    by, order = list(by), list(order)
    totals = items.groupBy(*by, bucket).agg(F.sum(weight).alias("_w"))
    upto = W.partitionBy(*by).orderBy(bucket)
    totals = totals.withColumn("_hi", F.sum("_w").over(upto)).withColumn(
        "_lo", F.col("_hi") - F.col("_w")
    )
    hits = join_keys(targets, totals.drop("_w"), by).filter(
        (F.col("_lo") < F.col(target)) & (F.col(target) <= F.col("_hi"))
    )
    near = join_keys(items, hits.select(*by, bucket).distinct(), [*by, bucket], "left_semi")
    near = near.groupBy(*by, bucket, *order).agg(F.sum(weight).alias("_w"))
    inner = W.partitionBy(*by, bucket).orderBy(*order)
    near = near.withColumn("_run", F.sum("_w").over(inner))
    found = join_keys(hits, near, [*by, bucket])
    found = found.withColumn("reached", F.col("_lo") + F.col("_run")).filter(
        (F.col("reached") >= F.col(target)) & (F.col("reached") - F.col("_w") < F.col(target))
    )
    return found.drop(bucket, "_lo", "_hi", "_w", "_run")


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probs``.

    NULL and NaN are left out. Groups without values are absent from the result.
    """
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_v"))
    rows, keys = keyed(rows, by)
    # One row per key, used three times below.
    edges = settle(_edges(rows, keys, "_v", bucket_rows, FAN))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                ((F.col("_n") - 1) * F.lit(float(p))).alias("pos"),
            )
            for name, p in probs.items()
        ]
    )
    targets = edges.select(*keys, F.explode(wanted).alias("t")).select(
        *keys,
        F.col("t.name").alias("_name"),
        (F.col("t.pos") - F.floor("t.pos")).alias("_frac"),
        F.explode(
            F.array_distinct(
                F.array(F.floor("t.pos").cast("bigint"), F.ceil("t.pos").cast("bigint"))
            )
        ).alias("_rank"),
    )
    targets = targets.withColumn("_target", F.col("_rank") + 1)
    items = _placed(rows, keys, "_v", edges, "_bucket", bucket_rows, FAN).withColumn("_one", F.lit(1))
    found = crossing(items, keys, "_bucket", ["_v"], "_one", targets, "_target")
    per = found.groupBy(*keys, "_name", "_frac").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    per = per.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    out = per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs]
    )
    return out.select(*by, *probs)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add a gap-free number 0..n-1 by ``order``, columns of any orderable types that together are unique.

    Rows are range-partitioned and written; a range's first number is the running count of the ranges before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row for each partition.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy(*order)
    out = placed.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
    return out.drop("_range", "_before")


def hash_bucket(hashed: Column) -> Column:
    """Leading bits of a draw: an order-preserving bucket for hash order."""
    return F.shiftright(hashed, HASH_SHIFT)


def dense_index(df: DataFrame, by: Sequence[str], hashed: str, key: str, name: str) -> DataFrame:
    """Add a gap-free index 0..n-1 within ``by`` following (hashed, key); keys must be unique."""
    rows, keys = keyed(df, by)
    rows = rows.withColumn("_hb", hash_bucket(F.col(hashed)))
    sizes = rows.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_hb", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")
    )
    inside = W.partitionBy(*keys, "_hb").orderBy(hashed, key)
    out = join_keys(rows, offsets, [*keys, "_hb"]).withColumn(
        name, F.col("_off") + F.row_number().over(inside) - 1
    )
    return out.drop("_hb", "_off", *([] if by else ["_all"]))
