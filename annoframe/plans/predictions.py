"""A prediction table over orders: two simple price models, years as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.plans.base import load

PREDICTIONS = """
li AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total, count(*) AS n
       FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS yr,
         c_nationkey AS nation, c_mktsegment AS segment, o_totalprice AS y_true,
         coalesce(total, 0.0) AS p_total, coalesce(n, 0) * 60000.0 AS p_count
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
pred AS (
  SELECT 'total' AS model, id, cust, priority, yr, nation, segment, y_true, CAST(p_total AS DOUBLE) AS y_pred FROM base
  UNION ALL SELECT 'count', id, cust, priority, yr, nation, segment, y_true, CAST(p_count AS DOUBLE) FROM base)
"""


def prediction_base(spark, sf):
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    orders = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("yr"),
        F.col("o_totalprice").alias("y_true"),
    )
    people = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    return orders.join(people, "cust").join(lines, "id", "left").select(
        "id",
        "cust",
        "priority",
        "yr",
        "nation",
        "segment",
        "y_true",
        F.coalesce("total", F.lit(0.0)).alias("p_total"),
        (F.coalesce("n", F.lit(0)) * F.lit(60000.0)).alias("p_count"),
    )


def predictions(spark, sf):
    """Both models in long form."""
    base = prediction_base(spark, sf)
    rows = F.explode(
        F.array(
            F.struct(F.lit("total").alias("model"), F.col("p_total").alias("y_pred")),
            F.struct(F.lit("count").alias("model"), F.col("p_count").alias("y_pred")),
        )
    )
    keep = ["id", "cust", "priority", "yr", "nation", "segment", "y_true"]
    return base.select(*keep, rows.alias("m")).select("m.model", *keep, "m.y_pred")
