"""Family ranking and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.operators import attribution, ranking
from annoframe.plans.base import load, query, r, rounded, sql_unit
from annoframe.plans.predictions import PREDICTIONS, predictions
from annoframe.plans.run_statistics import _draws, _interval

FAMILY = f"""
{PREDICTIONS},
pf AS (SELECT *, segment || '|' || nation AS family_id FROM pred),
pairs AS (SELECT a.model, a.family_id, sign(a.y_true - b.y_true) AS t, sign(a.y_pred - b.y_pred) AS p
  FROM pf a JOIN pf b ON a.model = b.model AND a.family_id = b.family_id AND a.id < b.id),
pc AS (SELECT model, family_id, count_if(t <> 0 AND (t > 0) = (p > 0)) AS ok, count_if(t <> 0) AS valid FROM pairs GROUP BY 1, 2),
rk AS (SELECT model, family_id,
  rank() OVER (PARTITION BY model, family_id ORDER BY y_true) + (count(*) OVER (PARTITION BY model, family_id, y_true) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model, family_id ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, family_id, y_pred) - 1) / 2.0 AS b
  FROM pf),
fa AS (SELECT model, family_id, count(*) AS n_test, corr(a, b) AS rho FROM rk GROUP BY 1, 2),
fam AS (SELECT fa.model, fa.family_id, n_test, coalesce(valid, 0) AS valid_pair_count, coalesce(ok, 0) AS correct_pair_count,
  CASE WHEN valid > 0 THEN ok * 1.0 / valid END AS pairwise_accuracy, CASE WHEN isnan(rho) THEN NULL ELSE rho END AS rho
  FROM fa LEFT JOIN pc ON pc.model = fa.model AND pc.family_id = fa.family_id)
"""
REPS = 5000

def families(spark, sf):
    rows = predictions(spark, sf).withColumn(
        "family_id", F.concat_ws("|", "segment", F.col("nation").cast("string"))
    )
    return ranking.family_accuracy(rows, ["model", "family_id"], "id")


@query(
    "ranking_families",
    f"""WITH {FAMILY} SELECT model, family_id, n_test, valid_pair_count, correct_pair_count,
    {r("pairwise_accuracy", "pairwise_accuracy")}, {r("rho", "within_family_spearman")} FROM fam""",
)
def ranking_families(spark, sf):
    """Pair accuracy and Spearman per family and model (JN6, RK1, RK2)."""
    return rounded(families(spark, sf))


@query(
    "ranking_summary",
    f"""WITH {FAMILY}, valid AS (SELECT model, family_id, pairwise_accuracy AS v FROM fam WHERE pairwise_accuracy IS NOT NULL),
    {_draws("model", "valid", "family_id", REPS)},
    b AS (SELECT model, rep, sum(w * v) / sum(w) AS m FROM mult JOIN valid USING (model, family_id) GROUP BY 1, 2),
    ci AS (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM b GROUP BY 1),
    pt AS (SELECT model, count(*) AS n_families_total, count(pairwise_accuracy) AS n_families_with_valid_pairs,
      sum(correct_pair_count) * 1.0 / sum(valid_pair_count) AS pooled, avg(pairwise_accuracy) AS mean FROM fam GROUP BY 1)
    SELECT model, n_families_total, n_families_with_valid_pairs, {r("pooled", "overall_pairwise_accuracy")},
      {r("mean", "mean_family_pairwise_accuracy")}, {r("lo", "family_bootstrap_ci95_low")},
      {r("hi", "family_bootstrap_ci95_high")}, {REPS} AS bootstrap_replicates FROM pt JOIN ci USING (model)""",
)
def ranking_summary(spark, sf):
    """Pooled and mean family accuracy with interval (RK3)."""
    return rounded(ranking.summary(families(spark, sf), replicates=REPS))


_DIFF = """
fd AS (SELECT a.family_id, a.pairwise_accuracy AS left_value, b.pairwise_accuracy AS right_value,
       a.pairwise_accuracy - b.pairwise_accuracy AS difference FROM fam a JOIN fam b
       ON a.family_id = b.family_id AND a.model = 'total' AND b.model = 'count'
       WHERE a.pairwise_accuracy IS NOT NULL AND b.pairwise_accuracy IS NOT NULL)"""


@query(
    "ranking_family_differences",
    f"""WITH {FAMILY}, {_DIFF} SELECT family_id, {r("left_value", "left_value")}, {r("right_value", "right_value")},
    {r("difference", "difference")} FROM fd""",
)
def ranking_family_differences(spark, sf):
    """Two models side by side per family (JN4)."""
    return rounded(ranking.family_differences(families(spark, sf), "total", "count"))


@query(
    "ranking_compare",
    f"""WITH {FAMILY}, {_DIFF}, {_draws("", "fd", "family_id", REPS)},
    b AS (SELECT rep, sum(w * difference) / sum(w) AS m FROM mult JOIN fd USING (family_id) GROUP BY 1),
    ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM b),
    c AS (SELECT count(*) AS n, avg(difference) AS mean, count_if(difference > 0) AS pos, count_if(difference < 0) AS neg FROM fd),
    t AS (SELECT sum(exp(lgamma(pos + neg + 1) - lgamma(i + 1) - lgamma(pos + neg - i + 1) - (pos + neg) * ln(2.0))) AS tail
          FROM (SELECT *, unnest(range(0, CAST(least(pos, neg) AS BIGINT) + 1)) AS i FROM c))
    SELECT 'total minus count' AS comparison, n AS n_families_valid, {r("mean", "mean_difference")}, {r("lo", "ci95_low")},
      {r("hi", "ci95_high")}, {r("pos * 1.0 / n", "proportion_improved")}, {r("(n - pos - neg) * 1.0 / n", "proportion_tied")},
      {r("neg * 1.0 / n", "proportion_worsened")},
      {r("CASE WHEN pos = neg THEN 1.0 ELSE least(1.0, 2 * tail) END", "exact_sign_test_p")} FROM c, ci, t""",
)
def ranking_compare(spark, sf):
    """Model-against-model family difference (RK4, ST10)."""
    return rounded(ranking.compare(families(spark, sf), "total", "count", replicates=REPS))


# --- attribution ---------------------------------------------------------------------------

# Line measures stand for contributions: feature name -> SQL expression.
MEASURES = {
    "mol_weight": "l_quantity",
    "num_edits": "l_suppkey % 7",
    "anchor_pos_mean": "l_discount * 100",
    "anchor_res_A": "l_tax * -100",
    "anchor_res_C": "l_partkey % 5",
    "anchor_polar_frac": "l_extendedprice / 10000",
    "edit_family_backbone": "l_partkey % 11",
    "sequence_length": "l_suppkey % 13",
}
CONTRIB = "long AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS representation_id, l_linenumber AS seed, '{k}' AS feature, CAST({v} AS DOUBLE) AS contribution FROM lineitem"
    for k, v in MEASURES.items()
) + """),
ma AS (SELECT representation_id, seed, feature, avg(abs(contribution)) AS mean_absolute FROM long GROUP BY 1, 2, 3),
sh AS (SELECT *, mean_absolute / sum(mean_absolute) OVER (PARTITION BY representation_id, seed) AS proportion,
  CASE WHEN feature IN ('mol_weight', 'num_edits') THEN 'A' WHEN feature = 'anchor_pos_mean' THEN 'B1'
       WHEN feature LIKE 'anchor\\_res\\_%' ESCAPE '\\' THEN 'B2' WHEN feature = 'anchor_polar_frac' THEN 'B3' ELSE 'C' END AS block FROM ma),
bs AS (SELECT representation_id, seed, block, sum(proportion) AS v FROM (
  SELECT representation_id, seed, block, proportion FROM sh
  UNION ALL SELECT representation_id, seed, 'B', proportion FROM sh WHERE block LIKE 'B%') GROUP BY 1, 2, 3)
"""
RUN = ["representation_id", "seed"]


def shares(spark, sf):
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("feature"), F.expr(v).cast("double").alias("contribution"))
            for k, v in MEASURES.items()
        ]
    )
    long = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("representation_id"),
        F.col("l_linenumber").alias("seed"),
        F.explode(entries).alias("e"),
    ).select("representation_id", "seed", "e.*")
    return attribution.with_blocks(attribution.feature_share(long, RUN))


@query(
    "attribution_features",
    f"""WITH {CONTRIB} SELECT representation_id, seed, feature, {r("mean_absolute", "mean_absolute")},
    {r("proportion", "proportion")}, block FROM sh""",
)
def attribution_features(spark, sf):
    """Mean absolute contribution and share per feature, with blocks (AT1, AT2)."""
    return rounded(shares(spark, sf))


@query(
    "attribution_blocks",
    f"""WITH {CONTRIB}, s AS ({_interval("v", "representation_id, block", "bs")})
    SELECT representation_id, block, n AS n_seeds, {r("mean", "mean")}, {r("sd", "sample_sd")},
      {r("mean - half", "ci95_low")}, {r("mean + half", "ci95_high")} FROM s""",
)
def attribution_blocks(spark, sf):
    """Block shares with an interval over seeds (AT3, AT4)."""
    blocks = attribution.block_share(shares(spark, sf), RUN)
    return rounded(
        attribution.seed_interval(blocks, ["representation_id", "block"], "attribution_proportion")
    )


@query(
    "attribution_top_features",
    f"""WITH {CONTRIB}, m AS ({_interval("proportion", "representation_id, feature, block", "sh")}),
    x AS (SELECT *, 'overall' AS scope FROM m UNION ALL SELECT *, left(block, 1) FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY representation_id, scope ORDER BY mean DESC, feature) AS rk FROM x)
    SELECT representation_id, scope, CAST(rk AS INTEGER) AS rank, feature, block, {r("mean", "proportion")}, {r("sd", "sample_sd")},
      {r("mean - half", "ci95_low")}, {r("mean + half", "ci95_high")}, n AS n_seeds
    FROM k WHERE rk <= CASE scope WHEN 'overall' THEN 15 ELSE 10 END""",
)
def attribution_top_features(spark, sf):
    """Largest features overall and per block, ranked (AT5)."""
    return rounded(attribution.top_features(shares(spark, sf), ["representation_id"]))


@query(
    "attribution_subset",
    f"SELECT o_orderkey FROM orders ORDER BY {sql_unit('20260717', 'o_orderkey')}, o_orderkey LIMIT 500",
)
def attribution_subset(spark, sf):
    """A fixed random subset of rows (AT6)."""
    return attribution.fixed_subset(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
