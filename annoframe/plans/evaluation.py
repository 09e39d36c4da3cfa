"""Run metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.operators import metrics
from annoframe.plans.base import load, query, r, rounded, sql_unit
from annoframe.plans.predictions import PREDICTIONS, predictions

_REG = f"""SELECT model, yr, count(*) AS n_samples, {r("sqrt(avg((y_true - y_pred) ^ 2))", "rmse", 3)},
 {r("avg(abs(y_true - y_pred))", "mae", 3)},
 {r("1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*))", "r2")}, {r("corr(y_true, y_pred)", "pearson")},
 {r("var_pop(y_pred) / var_pop(y_true)", "variance_ratio")} FROM pred GROUP BY model, yr"""


def round_errors(df):
    """rmse and mae are in currency: three digits are enough to compare them."""
    small = df.withColumns({c: F.round(c, 3) for c in ("rmse", "mae") if c in df.columns})
    return rounded(small)


@query("metrics_regression", f"WITH {PREDICTIONS} {_REG}")
def metrics_regression(spark, sf):
    """RMSE, MAE, R2, Pearson and variance ratio per run (ME1-ME4, ME7)."""
    return round_errors(metrics.regression(predictions(spark, sf), ["model", "yr"]))


RANKED = """
rk AS (SELECT model, yr, id, y_true, y_pred,
  rank() OVER (PARTITION BY model, yr ORDER BY y_true) + (count(*) OVER (PARTITION BY model, yr, y_true) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY model, yr ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, yr, y_pred) - 1) / 2.0 AS rp
  FROM pred)"""
PAIRS = """
pairs AS (SELECT a.model, a.yr, sign(a.y_true - b.y_true) AS t, sign(a.y_pred - b.y_pred) AS p
  FROM pred a JOIN pred b ON a.model = b.model AND a.yr = b.yr AND a.id < b.id),
pc AS (SELECT model, yr, count(*) AS total, count_if(t = 0) AS tt, count_if(p = 0) AS tp,
  count_if(t * p > 0) AS con, count_if(t * p < 0) AS dis,
  count_if(t <> 0 AND (t > 0) = (p > 0)) AS ok, count_if(t <> 0) AS valid FROM pairs GROUP BY model, yr)"""


@query(
    "metrics_spearman",
    f"WITH {PREDICTIONS}, {RANKED} SELECT model, yr, {r('corr(rt, rp)', 'spearman')} FROM rk GROUP BY model, yr",
)
def metrics_spearman(spark, sf):
    """Spearman correlation per run (ME5)."""
    return rounded(metrics.spearman(predictions(spark, sf), ["model", "yr"]))


@query(
    "metrics_kendall",
    f"""WITH {PREDICTIONS}, {PAIRS} SELECT model, yr,
    {r("(con - dis) / (sqrt(total - tt) * sqrt(total - tp))", "kendall_tau")} FROM pc""",
)
def metrics_kendall(spark, sf):
    """Kendall tau-b per run (ME6)."""
    return rounded(metrics.kendall(predictions(spark, sf), ["model", "yr"]))


@query(
    "metrics_all",
    f"""WITH {PREDICTIONS}, {RANKED}, {PAIRS}, reg AS ({_REG}),
    sp AS (SELECT model, yr, {r("corr(rt, rp)", "spearman")} FROM rk GROUP BY model, yr)
    SELECT reg.*, spearman, {r("(con - dis) / (sqrt(total - tt) * sqrt(total - tp))", "kendall_tau")}
    FROM reg JOIN sp USING (model, yr) JOIN pc USING (model, yr)""",
)
def metrics_all(spark, sf):
    """Every metric of every run (ME1-ME7)."""
    return round_errors(metrics.all_metrics(predictions(spark, sf), ["model", "yr"]))


@query(
    "metrics_pairwise",
    f"""WITH {PREDICTIONS}, {PAIRS} SELECT model, yr, valid AS valid_pairs, ok AS correct_pairs,
    {r("ok * 1.0 / valid", "pairwise_ranking_accuracy")} FROM pc""",
)
def metrics_pairwise(spark, sf):
    """Ranking accuracy over all pairs of a run (ME9)."""
    return rounded(metrics.pairwise_accuracy(predictions(spark, sf), ["model", "yr"], "id"))


@query(
    "metrics_pairwise_sampled",
    f"""WITH {PREDICTIONS},
    ix AS (SELECT *, row_number() OVER (PARTITION BY model, yr ORDER BY {sql_unit("42", "id")}, id) - 1 AS i FROM pred),
    n AS (SELECT model, yr, count(*) AS n FROM pred GROUP BY model, yr),
    d AS (SELECT model, yr, n, d, {sql_unit("'42:i'", "d")} % n AS i, {sql_unit("'42:j'", "d")} % (n - 1) + 1 AS step
          FROM n, range(1, 10001) t(d) WHERE d <= n * (n - 1) // 2),
    v AS (SELECT d.model, d.yr, a.y_true AS ta, b.y_true AS tb, a.y_pred AS pa, b.y_pred AS pb
          FROM d JOIN ix a ON a.model = d.model AND a.yr = d.yr AND a.i = d.i
          JOIN ix b ON b.model = d.model AND b.yr = d.yr AND b.i = (d.i + step) % n)
    SELECT model, yr, count_if(ta <> tb) AS valid_pairs, count_if(ta <> tb AND (ta > tb) = (pa > pb)) AS correct_pairs,
      {r("count_if(ta <> tb AND (ta > tb) = (pa > pb)) * 1.0 / count_if(ta <> tb)", "pairwise_ranking_accuracy")}
    FROM v GROUP BY model, yr""",
)
def metrics_pairwise_sampled(spark, sf):
    """Ranking accuracy over hashed pair draws (ME9)."""
    df = predictions(spark, sf)
    return rounded(metrics.sampled_pairwise_accuracy(df, ["model", "yr"], "id"))


@query(
    "metrics_topk",
    f"""WITH {PREDICTIONS}, k AS (SELECT model, yr, greatest(1, floor(count(*) * 0.1)) AS k FROM pred GROUP BY model, yr),
    t AS (SELECT model, yr,
      row_number() OVER (PARTITION BY model, yr ORDER BY y_true DESC, {sql_unit("'in_truth'", "id")}, id) AS a,
      row_number() OVER (PARTITION BY model, yr ORDER BY y_pred DESC, {sql_unit("'in_pred'", "id")}, id) AS b FROM pred)
    SELECT model, yr, {r("count_if(a <= k AND b <= k) * 1.0 / max(k)", "top_k_enrichment")}
    FROM t JOIN k USING (model, yr) GROUP BY model, yr""",
)
def metrics_topk(spark, sf):
    """Overlap of true and predicted top tenth (ME8)."""
    return rounded(metrics.topk_overlap(predictions(spark, sf), ["model", "yr"], "id"))


@query(
    "metrics_evaluate",
    f"""WITH {PREDICTIONS}, {RANKED}, sp AS (SELECT model, corr(rt, rp) AS rho FROM (
      SELECT model, rank() OVER (PARTITION BY model ORDER BY y_true)
          + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0 AS rt,
        rank() OVER (PARTITION BY model ORDER BY y_pred)
          + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0 AS rp FROM pred) GROUP BY model)
    SELECT model, count(*) AS n_samples, {r("sqrt(avg((y_true - y_pred) ^ 2))", "rmse", 3)},
      {r("avg(abs(y_true - y_pred))", "mae", 3)},
      {r("1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*))", "r2")}, {r("max(rho)", "spearman")}
    FROM pred JOIN sp USING (model) GROUP BY model""",
)
def metrics_evaluate(spark, sf):
    """Predictions joined to labels by id and scored (ME10, ME11)."""
    preds = predictions(spark, sf).select("model", "id", "y_pred")
    labels = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("label"))
    return round_errors(metrics.evaluate(preds, labels, "id", ["model"]))
