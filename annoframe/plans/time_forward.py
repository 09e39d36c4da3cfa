"""Time-forward queries on orders: years as cutoffs, market segments as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.operators import splits, timeforward
from annoframe.plans.base import load, query, r, rounded
from annoframe.plans.predictions import PREDICTIONS, predictions
from annoframe.plans.run_statistics import _draws
from annoframe.plans.samples import PRELUDE, edit_types, orders_with_sequence
from annoframe.plans.split_sets import CUTOFFS, TIMED
from annoframe.session import settle


def timed_samples(spark, sf):
    """Samples with cutoffs, family, source and annotation types."""
    people = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"),
        F.col("c_mktsegment").alias("segment"),
        F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("family"),
    )
    orders = splits.time_forward(orders_with_sequence(spark, sf), "id", "yr", CUTOFFS)
    rows = orders.join(people, "cust").join(edit_types(spark, sf), "id", "left")
    return rows.withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def _counts(name: str, source: str) -> str:
    """SQL: distinct values per side and the unseen share."""
    return f"""
v_{name} AS (SELECT DISTINCT cutoff, side, v FROM {source} WHERE v IS NOT NULL),
n_{name} AS (SELECT e.cutoff, count(*) AS k, count_if(t.v IS NULL) AS new FROM v_{name} e LEFT JOIN v_{name} t
  ON t.cutoff = e.cutoff AND t.side = 'train' AND t.v = e.v WHERE e.side = 'test' GROUP BY 1),
c_{name} AS (SELECT cutoffs.cutoff, (SELECT count(*) FROM v_{name} x WHERE x.cutoff = cutoffs.cutoff AND side = 'train') AS train_{name},
  coalesce(k, 0) AS test_{name}, coalesce(CASE WHEN k > 0 THEN new * 1.0 / k END, 0) AS unseen_{name}
  FROM cuts cutoffs LEFT JOIN n_{name} n ON n.cutoff = cutoffs.cutoff)"""


STATS = f"""
{PRELUDE}, {TIMED},
x AS (SELECT tf.cutoff, tf.side, o.*, c_mktsegment AS segment, c_mktsegment || '|' || c_nationkey AS family
      FROM tf JOIN o USING (id) JOIN customer ON c_custkey = o.cust),
sq AS (SELECT cutoff, side, seq AS v FROM x), fm AS (SELECT cutoff, side, family AS v FROM x),
ty AS (SELECT cutoff, side, type AS v FROM tf JOIN ann USING (id)),
{_counts("sequences", "sq")}, {_counts("families", "fm")}, {_counts("types", "ty")},
ls AS (SELECT cutoff, {", ".join(f'''count_if(side = '{s}') AS {s}_n,
  avg(CASE WHEN side = '{s}' THEN label END) AS {s}_label_mean, stddev_samp(CASE WHEN side = '{s}' THEN label END) AS {s}_label_sd,
  quantile_cont(CASE WHEN side = '{s}' THEN label END, 0.5) AS {s}_label_median,
  quantile_cont(CASE WHEN side = '{s}' THEN label END, 0.75) - quantile_cont(CASE WHEN side = '{s}' THEN label END, 0.25)
    AS {s}_label_iqr''' for s in ("train", "test"))} FROM x GROUP BY cutoff)
"""
_LABELS = ", ".join(
    f"{s}_n, " + ", ".join(r(f"{s}_label_{k}", f"{s}_label_{k}", 5) for k in ("mean", "sd", "median", "iqr"))
    for s in ("train", "test")
)
_COUNTED = ", ".join(
    f"train_{n}, test_{n}, {r(f'unseen_{n}', f'unseen_{n}_fraction', 5)}" for n in ("sequences", "families", "types")
)


def cutoff_table(spark, sf):
    rows = timed_samples(spark, sf).select("label", "train_for", "test_for", "sequence", "family", "types")
    return timeforward.cutoff_stats(
        # Labels and each counted column read the rows anew: join the lines once.
        settle(rows),
        "label",
        {"sequences": "sequence", "families": "family"},
        {"types": "types"},
    )


@query(
    "time_cutoff_stats",
    f"""WITH {STATS} SELECT ls.cutoff, {_LABELS}, {_COUNTED} FROM ls JOIN c_sequences USING (cutoff)
    JOIN c_families USING (cutoff) JOIN c_types USING (cutoff)""",
)
def time_cutoff_stats(spark, sf):
    """Rows, distinct values, unseen shares and label statistics per cutoff (TF1-TF3)."""
    return rounded(cutoff_table(spark, sf), 5)


@query(
    "time_composition",
    f"""WITH {STATS} SELECT cutoff, segment AS source, count(*) AS test_n,
    {r("count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cutoff)", "test_fraction")}
    FROM x WHERE side = 'test' AND cutoff IN (1998, 2000) GROUP BY cutoff, segment""",
)
def time_composition(spark, sf):
    """Test rows per source at focal cutoffs (TF4)."""
    orders = splits.time_forward(orders_with_sequence(spark, sf), "id", "yr", CUTOFFS)
    people = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment")
    )
    return rounded(timeforward.composition(orders.join(people, "cust"), "segment", (1998, 2000)))


REPS = 2000


def cutoff_predictions(spark, sf):
    """Test predictions of each cutoff from the two price models."""
    orders = splits.time_forward(orders_with_sequence(spark, sf), "id", "yr", CUTOFFS)
    tests = orders.select("id", F.explode("test_for").alias("cutoff"))
    preds = predictions(spark, sf).withColumn("family", F.col("nation"))
    return preds.join(tests, "id")


PERF = f"""
{PRELUDE}, {TIMED}, {PREDICTIONS},
tp AS (SELECT tf.cutoff, pred.model, nation, y_true, y_pred, 10 * tf.cutoff + CASE model WHEN 'total' THEN 1 ELSE 0 END AS key
  FROM pred JOIN tf USING (id) WHERE side = 'test'),
{_draws("cutoff, model", "tp", "nation", REPS)},
gs AS (SELECT cutoff, model, nation, count(*) AS n, sum(y_true) AS sy, sum(y_true * y_true) AS syy,
  sum((y_true - y_pred) ^ 2) AS sse FROM tp GROUP BY 1, 2, 3),
rs AS (SELECT cutoff, model, rep, 1 - sum(w * sse) / (sum(w * syy) - sum(w * sy) * sum(w * sy) / sum(w * n)) AS v
  FROM mult JOIN gs USING (cutoff, model, nation) GROUP BY 1, 2, 3),
ci AS (SELECT cutoff, model, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM rs GROUP BY 1, 2),
pt AS (SELECT cutoff, model, 1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n FROM tp GROUP BY 1, 2)
"""


@query(
    "time_performance",
    f"""WITH {PERF} SELECT cutoff, model, {r("r2", "r2", 4)}, {r("lo", "ci95_low", 4)}, {r("hi", "ci95_high", 4)}
    FROM pt JOIN ci USING (cutoff, model)""",
)
def time_performance(spark, sf):
    """Performance by cutoff and model with a family bootstrap (TF5)."""
    out = timeforward.performance(cutoff_predictions(spark, sf), replicates=REPS, with_spearman=False)
    out = out.filter("metric = 'r2'").select("cutoff", "model", F.col("estimate").alias("r2"), "ci95_low", "ci95_high")
    return rounded(out, 4)


@query(
    "time_wide_report",
    f"""WITH {PERF}, lb AS (SELECT cutoff, count_if(side = 'train') AS train_n, count_if(side = 'test') AS test_n FROM tf GROUP BY 1),
    d AS (SELECT cutoff, avg(y_true) AS mean_truth FROM tp WHERE model = 'total' GROUP BY 1)
    SELECT cutoff, model, train_n, test_n, {r("r2", "r2", 4)}, {r("lo", "ci95_low", 4)}, {r("hi", "ci95_high", 4)},
      {r("mean_truth", "mean_truth", 4)} FROM pt JOIN ci USING (cutoff, model) JOIN lb USING (cutoff) JOIN d USING (cutoff)""",
)
def time_wide_report(spark, sf):
    """Performance joined with cutoff statistics and a diagnostic by cutoff (JN5, TF6)."""
    preds = cutoff_predictions(spark, sf)
    perf = timeforward.performance(preds, replicates=REPS, with_spearman=False)
    orders = splits.time_forward(orders_with_sequence(spark, sf), "id", "yr", CUTOFFS)
    cutoffs = timeforward.label_stats(orders, "label").select("cutoff", "train_n", "test_n")
    diag = preds.filter("model = 'total'").groupBy("cutoff").agg(F.avg("y_true").alias("mean_truth"))
    out = timeforward.wide_report(perf, cutoffs, diag, "r2")
    return rounded(
        out.select("cutoff", "model", "train_n", "test_n", "r2", "ci95_low", "ci95_high", "mean_truth"), 4
    )
