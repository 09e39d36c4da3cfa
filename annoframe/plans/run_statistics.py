"""Statistics over runs: a run is a (model, priority) pair, the order year is its seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.functions.tquantile import t_975
from annoframe.operators import metrics, runs, stats
from annoframe.plans.base import query, r, rounded, sql_unit
from annoframe.plans.predictions import PREDICTIONS, predictions, prediction_base

NAMES = ["r2", "rmse", "mae"]
_T = " ".join(f"WHEN {k} THEN {t_975(k - 1)!r}" for k in range(2, 41))


def _interval(value: str, by: str, source: str) -> str:
    """SQL for mean, sample sd and 95% t interval."""
    return f"""SELECT {by}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd,
    (CASE count({value}) {_T} END) * stddev_samp({value}) / sqrt(count({value})) AS half
    FROM {source} GROUP BY {by}"""


SEEDS = f"""
{PREDICTIONS},
seeds AS (SELECT model, priority, yr, sqrt(avg((y_true - y_pred) ^ 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae,
  1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n_samples
  FROM pred GROUP BY model, priority, yr),
long AS (SELECT model, priority, yr, 'r2' AS metric, r2 AS value FROM seeds
  UNION ALL SELECT model, priority, yr, 'rmse', rmse FROM seeds UNION ALL SELECT model, priority, yr, 'mae', mae FROM seeds),
diff AS (SELECT a.priority, a.yr, a.metric, a.value - b.value AS difference FROM long a JOIN long b
  ON a.priority = b.priority AND a.yr = b.yr AND a.metric = b.metric AND a.model = 'total' AND b.model = 'count')
"""


def seed_table(spark, sf):
    return metrics.regression(predictions(spark, sf), ["model", "priority", "yr"])


def seed_long(spark, sf):
    return stats.melt(seed_table(spark, sf), ["model", "priority", "yr"], NAMES, "metric", "value")


@query(
    "stats_summary",
    f"""WITH {SEEDS}, s AS ({_interval("value", "model, priority, metric", "long")})
    SELECT model, priority, metric, n AS n_completed_seeds, {r("mean", "mean", 3)}, {r("sd", "sample_sd", 3)},
      {r("mean - half", "ci95_low", 3)}, {r("mean + half", "ci95_high", 3)} FROM s""",
)
def stats_summary(spark, sf):
    """Mean, sd and t interval over seeds per run and metric (ST1, ST2)."""
    out = stats.summary(seed_table(spark, sf), ["model", "priority"], NAMES)
    return rounded(out.drop("estimate_95ci"), 3)


@query(
    "stats_rounded_text",
    f"""WITH {SEEDS}, s AS ({_interval("value", "model, priority, metric", "long")})
    SELECT model, priority, format('{{:.3f}} ({{:.3f}}, {{:.3f}})', mean, mean - half, mean + half) AS estimate_95ci
    FROM s WHERE metric = 'r2'""",
)
def stats_rounded_text(spark, sf):
    """Rounded text of the R2 summary (ST2)."""
    out = stats.summary(seed_table(spark, sf), ["model", "priority"], ["r2"])
    return out.select("model", "priority", "estimate_95ci")


@query(
    "stats_paired_difference",
    f"""WITH {SEEDS}, s AS ({_interval("difference", "priority, metric", "diff")})
    SELECT priority, metric, 'total minus count' AS comparison, n AS n_pairs, {r("mean", "mean_difference", 3)},
      {r("sd", "sample_sd", 3)}, {r("mean - half", "ci95_low", 3)}, {r("mean + half", "ci95_high", 3)},
      mean - half > 0 OR mean + half < 0 AS ci_excludes_zero,
      CASE WHEN mean - half > 0 OR mean + half < 0 THEN 'supported directional difference' ELSE 'inconclusive' END
        AS interpretation FROM s""",
)
def stats_paired_difference(spark, sf):
    """Seed-wise differences of the two models (ST4, JN2)."""
    out = stats.paired_difference(
        seed_long(spark, sf), ["priority", "metric"], "yr", "model", [("total", "count")], "value"
    )
    return rounded(out, 3)


FLIPS = f"""
{SEEDS},
vals AS (SELECT priority, metric, list(abs(difference)) AS d, abs(sum(difference)) AS obs, count(*) AS n FROM diff GROUP BY 1, 2),
flips AS (SELECT priority, metric, avg(CASE WHEN abs(list_sum(list_transform(range(n), lambda i:
    CASE WHEN (m >> CAST(i AS INTEGER)) & 1 = 1 THEN d[i + 1] ELSE -d[i + 1] END))) / n >= obs / n - 1e-15 THEN 1.0 ELSE 0.0 END) AS p
  FROM (SELECT *, unnest(range(CAST(2 ** n AS BIGINT))) AS m FROM vals) GROUP BY 1, 2)
"""


def sign_flips(spark, sf):
    rows = stats.compare_long(
        seed_long(spark, sf), ["priority", "metric", "yr"], "model", [("total", "count")], "value"
    )
    return stats.sign_flip(rows, ["priority", "metric"], "difference")


@query(
    "stats_sign_flip",
    f"""WITH {FLIPS} SELECT priority, metric, n AS n_pairs, {r("p", "p_value_unadjusted")}
    FROM flips JOIN vals USING (priority, metric)""",
)
def stats_sign_flip(spark, sf):
    """Exact sign-flip p per metric (ST5)."""
    return rounded(sign_flips(spark, sf))


@query(
    "stats_holm",
    f"""WITH {FLIPS}, k AS (SELECT priority, metric, p, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM flips),
    h AS (SELECT *, max((m - rk + 1) * p) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS run FROM k)
    SELECT priority, metric, {r("p", "p_value_unadjusted")}, {r("least(1.0, run)", "p_value_holm")} FROM h""",
)
def stats_holm(spark, sf):
    """Holm-corrected p values over all tests (ST6)."""
    out = stats.holm(sign_flips(spark, sf), "p_value_unadjusted")
    return rounded(out.drop("n_pairs"))


def _draws(by: str, source: str, group: str, reps: int, seed: int = 20260717) -> str:
    """SQL bootstrap draws: multiplicity of each group per replicate."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"{by}, " if by else ""
    size = f"JOIN gn USING ({by})" if by else ", gn"
    return f"""
gi AS (SELECT {keys}{group}, row_number() OVER ({part}ORDER BY {sql_unit(str(seed), group)}, {group}) - 1 AS g
       FROM (SELECT DISTINCT {keys}{group} FROM {source})),
gn AS (SELECT {keys}count(*) AS n FROM gi{f" GROUP BY {by}" if by else ""}),
dr AS (SELECT {keys}rep, {sql_unit(str(seed), "rep", "g")} % n AS g FROM gi {size}, range(1, {reps + 1}) t(rep)),
mult AS (SELECT {keys}rep, {group}, count(*) AS w FROM dr JOIN gi USING ({using}g) GROUP BY {keys}rep, {group})"""


REPS = 2000
BOOT = f"""
{PREDICTIONS}, {_draws("model", "pred", "nation", REPS)},
gs AS (SELECT model, nation, count(*) AS n, sum(y_true) AS sy, sum(y_true * y_true) AS syy,
  sum((y_true - y_pred) ^ 2) AS sse, sum(abs(y_true - y_pred)) AS sae FROM pred GROUP BY 1, 2),
rs AS (SELECT model, rep, sum(w * n) AS n, sum(w * sy) AS sy, sum(w * syy) AS syy, sum(w * sse) AS sse, sum(w * sae) AS sae
  FROM mult JOIN gs USING (model, nation) GROUP BY 1, 2),
wide AS (SELECT model, rep, 1 - sse / (syy - sy * sy / n) AS r2, sqrt(sse / n) AS rmse, sae / n AS mae FROM rs),
bl AS (UNPIVOT wide ON r2, rmse, mae INTO NAME metric VALUE v),
pt AS (SELECT model, sqrt(avg((y_true - y_pred) ^ 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae,
  1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2 FROM pred GROUP BY model),
pl AS (UNPIVOT pt ON r2, rmse, mae INTO NAME metric VALUE estimate)
"""


@query(
    "bootstrap_groups",
    f"""WITH {BOOT}, ci AS (SELECT model, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bl GROUP BY 1, 2)
    SELECT model, metric, {r("estimate", "estimate", 3)}, {r("lo", "ci95_low", 3)}, {r("hi", "ci95_high", 3)},
      {REPS} AS replicates FROM pl JOIN ci USING (model, metric)""",
)
def bootstrap_groups(spark, sf):
    """Grouped bootstrap of r2, rmse and mae with nations as groups (ST7)."""
    out = stats.group_bootstrap(
        predictions(spark, sf), ["model"], "nation", replicates=REPS, with_spearman=False
    )
    return rounded(out, 3)


def _rho(source: str, by: str, y: str, name: str) -> str:
    """SQL: Spearman of every replicate; ``source`` has ``by``, nation, y_true and ``y``.

    In a replicate a value's mid-rank is the sum over nations of their multiplicity times their rows below it (and half of
    those at it), so all sums over rows follow from sums over nations, pairs and triples of nations.
    """

    def below(side: str, column: str) -> str:
        return f"""
{name}_{side} AS (SELECT {by}, v, nation AS n, sum(c) OVER (PARTITION BY {by}, nation ORDER BY v) - c / 2.0 AS a FROM (
    SELECT d.{by}, d.v, g.nation, coalesce(c, 0) AS c FROM (SELECT DISTINCT {by}, {column} AS v FROM {source}) d
    JOIN (SELECT DISTINCT {by}, nation FROM {source}) g USING ({by})
    LEFT JOIN (SELECT {by}, {column} AS v, nation, count(*) AS c FROM {source} GROUP BY ALL) USING ({by}, v, nation)))"""

    def triples(left: str, right: str) -> str:
        column = {"x": "y_true", "y": y}
        return f"""
{name}_{left}{right} AS (SELECT {by}, rep, sum(a.w * b.w * c.w * t) AS s FROM (
    SELECT p.{by}, p.nation AS k, l.n, r.n AS m, sum(l.a * r.a) AS t FROM {source} p
    JOIN {name}_{left} l ON l.{by} = p.{by} AND l.v = p.{column[left]} JOIN {name}_{right} r ON r.{by} = p.{by} AND r.v = p.{column[right]} GROUP BY ALL)
  JOIN mult a USING ({by}) JOIN mult b USING ({by}, rep) JOIN mult c USING ({by}, rep)
  WHERE a.nation = k AND b.nation = n AND c.nation = m GROUP BY {by}, rep)"""

    def pairs(side: str, column: str) -> str:
        return f"""
{name}_s{side} AS (SELECT {by}, rep, sum(a.w * b.w * t) AS s FROM (
    SELECT p.{by}, p.nation AS k, l.n, sum(l.a) AS t FROM {source} p JOIN {name}_{side} l ON l.{by} = p.{by} AND l.v = p.{column} GROUP BY ALL)
  JOIN mult a USING ({by}) JOIN mult b USING ({by}, rep) WHERE a.nation = k AND b.nation = n GROUP BY {by}, rep)"""

    return f"""{below("x", "y_true")},{below("y", y)},{triples("x", "y")},{triples("x", "x")},{triples("y", "y")},{pairs("x", "y_true")},{pairs("y", y)},
{name}_n AS (SELECT {by}, rep, sum(w * c) AS s FROM mult JOIN (SELECT {by}, nation, count(*) AS c FROM {source} GROUP BY ALL) USING ({by}, nation) GROUP BY {by}, rep),
{name} AS (SELECT {by}, rep, (xy.s - x.s * y.s / n.s) / sqrt((xx.s - x.s * x.s / n.s) * (yy.s - y.s * y.s / n.s)) AS v
  FROM {name}_xy xy JOIN {name}_xx xx USING ({by}, rep) JOIN {name}_yy yy USING ({by}, rep) JOIN {name}_sx x USING ({by}, rep)
  JOIN {name}_sy y USING ({by}, rep) JOIN {name}_n n USING ({by}, rep))"""


@query(
    "bootstrap_groups_spearman",
    f"""WITH {PREDICTIONS}, {_draws("model", "pred", "nation", REPS)}, {_rho("pred", "model", "y_pred", "v")}
    SELECT model, 'spearman' AS metric, {r("quantile_cont(v, 0.025)", "ci95_low")}, {r("quantile_cont(v, 0.975)", "ci95_high")}
    FROM v GROUP BY model""",
)
def bootstrap_groups_spearman(spark, sf):
    """Grouped bootstrap of Spearman, all replicates from one ordering of the rows (ST7)."""
    out = stats.group_bootstrap(predictions(spark, sf), ["model"], "nation", replicates=REPS)
    return rounded(out.filter("metric = 'spearman'").select("model", "metric", "ci95_low", "ci95_high"))


@query(
    "bootstrap_difference",
    f"""WITH {PREDICTIONS}, {_draws("priority", "base", "nation", REPS)},
    gs AS (SELECT priority, nation, count(*) AS n, sum(y_true) AS sy, sum(y_true * y_true) AS syy,
      sum((y_true - p_total) ^ 2) AS ex, sum(abs(y_true - p_total)) AS ax, sum((y_true - p_count) ^ 2) AS ey,
      sum(abs(y_true - p_count)) AS ay FROM base GROUP BY 1, 2),
    rs AS (SELECT priority, rep, sum(w * n) AS n, sum(w * sy) AS sy, sum(w * syy) AS syy, sum(w * ex) AS ex, sum(w * ax) AS ax,
      sum(w * ey) AS ey, sum(w * ay) AS ay FROM mult JOIN gs USING (priority, nation) GROUP BY 1, 2),
    wide AS (SELECT priority, rep, (ey - ex) / (syy - sy * sy / n) AS r2, sqrt(ex / n) - sqrt(ey / n) AS rmse, (ax - ay) / n AS mae FROM rs),
    bl AS (UNPIVOT wide ON r2, rmse, mae INTO NAME metric VALUE v),
    tot AS (SELECT priority, sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy, sum(ex) AS ex, sum(ax) AS ax, sum(ey) AS ey, sum(ay) AS ay
      FROM gs GROUP BY 1),
    pt AS (SELECT priority, (ey - ex) / (syy - sy * sy / n) AS r2, sqrt(ex / n) - sqrt(ey / n) AS rmse, (ax - ay) / n AS mae FROM tot),
    pl AS (UNPIVOT pt ON r2, rmse, mae INTO NAME metric VALUE d),
    ci AS (SELECT priority, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bl GROUP BY 1, 2)
    SELECT priority, metric, {r("d", "observed_difference", 3)}, {r("lo", "ci95_low", 3)}, {r("hi", "ci95_high", 3)},
      {REPS} AS replicates FROM pl JOIN ci USING (priority, metric)""",
)
def bootstrap_difference(spark, sf):
    """Joint grouped bootstrap of the metric difference of two models (ST8, JN2, JN3)."""
    base = prediction_base(spark, sf)
    keep = ["id", "priority", "y_true"]
    both = stats.align_predictions(
        base.select(*keep, F.col("p_total").alias("y_pred")),
        base.select(*keep, F.col("p_count").alias("y_pred")),
        "id",
    )
    groups = base.select("id", "nation", "priority")
    known, _ = stats.attach_groups(both.join(groups.select("id", "priority"), "id"), groups, "id", "nation")
    out = stats.group_bootstrap_diff(known, ["priority"], "nation", replicates=REPS, with_spearman=False)
    return rounded(out, 3)


FAMS = f"""
{PREDICTIONS}, fam AS (SELECT nation, model, avg(y_true - y_pred) / 1000 AS bias FROM pred GROUP BY 1, 2),
fd AS (SELECT a.nation, a.bias AS left_value, b.bias AS right_value, a.bias - b.bias AS difference FROM fam a JOIN fam b
       ON a.nation = b.nation AND a.model = 'total' AND b.model = 'count')
"""


@query(
    "bootstrap_mean",
    f"""WITH {FAMS}, {_draws("model", "fam", "nation", 5000)},
    v AS (SELECT model, rep, sum(w * bias) / sum(w) AS v FROM mult JOIN fam USING (model, nation) GROUP BY 1, 2),
    ci AS (SELECT model, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY 1),
    pt AS (SELECT model, count(*) AS n_units, avg(bias) AS mean FROM fam GROUP BY 1)
    SELECT model, n_units, {r("mean", "mean")}, {r("lo", "ci95_low")}, {r("hi", "ci95_high")} FROM pt JOIN ci USING (model)""",
)
def bootstrap_mean(spark, sf):
    """Mean over families with a bootstrap interval (ST9)."""
    fam = predictions(spark, sf).groupBy("nation", "model").agg(
        (F.avg(F.col("y_true") - F.col("y_pred")) / 1000).alias("bias")
    )
    return rounded(stats.mean_bootstrap(fam, ["model"], "nation", "bias", replicates=5000))


@query(
    "stats_sign_test",
    f"""WITH {PREDICTIONS}, d AS (SELECT priority, CASE WHEN abs(y_true - p_total) < abs(y_true - p_count) THEN 1
       WHEN abs(y_true - p_total) > abs(y_true - p_count) THEN -1 ELSE 0 END AS v FROM base),
    c AS (SELECT priority, count(*) AS n_units, count_if(v > 0) AS pos, count_if(v < 0) AS neg FROM d GROUP BY 1),
    k AS (SELECT *, pos + neg AS n, CAST(least(pos, neg) AS BIGINT) AS lo FROM c),
    t AS (SELECT priority, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) AS tail
          FROM (SELECT *, unnest(range(0, lo + 1)) AS i FROM k) GROUP BY 1)
    SELECT priority, n_units, {r("pos * 1.0 / n_units", "proportion_improved")}, {r("(n_units - n) * 1.0 / n_units", "proportion_tied")},
      {r("neg * 1.0 / n_units", "proportion_worsened")},
      {r("CASE WHEN pos = neg THEN 1.0 ELSE least(1.0, 2 * tail) END", "exact_sign_test_p")} FROM k JOIN t USING (priority)""",
)
def stats_sign_test(spark, sf):
    """Exact sign test per priority: which model is closer (ST10)."""
    near = F.abs(F.col("y_true") - F.col("p_total"))
    far = F.abs(F.col("y_true") - F.col("p_count"))
    v = F.when(near < far, 1).when(near > far, -1).otherwise(0)
    rows = prediction_base(spark, sf).select("priority", v.alias("v"))
    return rounded(stats.sign_test(rows, ["priority"], "v"))


@query(
    "stats_association",
    f"""WITH {SEEDS}, z AS (SELECT model, priority, r2, 'rmse' AS diagnostic, rmse AS d FROM seeds
      UNION ALL SELECT model, priority, r2, 'n_samples', n_samples FROM seeds),
    rk AS (SELECT model, diagnostic,
      rank() OVER (PARTITION BY model, diagnostic ORDER BY r2) + (count(*) OVER (PARTITION BY model, diagnostic, r2) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY model, diagnostic ORDER BY d) + (count(*) OVER (PARTITION BY model, diagnostic, d) - 1) / 2.0 AS b
      FROM z)
    SELECT model, diagnostic, {r("corr(a, b)", "cutoff_level_spearman")}, count(*) AS n_cutoffs FROM rk GROUP BY 1, 2""",
)
def stats_association(spark, sf):
    """Spearman of a metric with diagnostics over runs (ST11)."""
    return rounded(stats.association(seed_table(spark, sf), ["model"], "r2", ["rmse", "n_samples"]))


@query(
    "stats_matrix",
    f"""WITH {SEEDS} SELECT priority, {r("avg(CASE WHEN model = 'count' THEN r2 END)", '"count"')},
      {r("avg(CASE WHEN model = 'total' THEN r2 END)", "total")},
      avg(CASE WHEN model = 'total' THEN r2 END) > avg(CASE WHEN model = 'count' THEN r2 END) AS trend_consistent
    FROM seeds GROUP BY priority""",
)
def stats_matrix(spark, sf):
    """Mean R2 by priority and model, with the trend flag (ST12)."""
    return rounded(
        stats.matrix(seed_table(spark, sf), "priority", "model", ["count", "total"], "r2", "count", "total")
    )


@query(
    "stats_mean_prediction",
    f"""WITH {PREDICTIONS} SELECT priority, id, y_true, {r("avg(y_pred)", "y_pred")}, count(*) AS n_seeds
    FROM pred GROUP BY priority, id, y_true""",
)
def stats_mean_prediction(spark, sf):
    """Mean prediction per row over models (ST14)."""
    return rounded(stats.mean_prediction(predictions(spark, sf), ["priority"], "id"))


@query(
    "stats_density_bins",
    f"""WITH {PREDICTIONS} SELECT model, CAST(floor(y_true / 25000) AS BIGINT) AS bin_x,
    CAST(floor(y_pred / 50000) AS BIGINT) AS bin_y, count(*) AS n FROM pred GROUP BY 1, 2, 3""",
)
def stats_density_bins(spark, sf):
    """Counts on a grid of truth against prediction (ST15)."""
    return stats.bin2d(predictions(spark, sf), ["model"], "y_true", "y_pred", 25000.0, 50000.0)


def run_rows(spark, sf):
    """Runs per (priority, year) that exist only where enough orders do, with a status."""
    t = prediction_base(spark, sf).groupBy("priority", "yr").agg(F.count(F.lit(1)).alias("n"))
    return t.select(
        "priority",
        "yr",
        F.when(F.col("n") % 5 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("n") % 3 != 0, F.col("n") / 10).alias("runtime_seconds"),
        "n",
    )


RUNS = f"""
{PREDICTIONS}, runs AS (SELECT priority, yr, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN count(*) % 3 <> 0 THEN count(*) / 10 END AS runtime_seconds, count(*) AS n FROM base GROUP BY 1, 2)
"""


@query(
    "runs_missing",
    f"""WITH {RUNS}, dims AS (SELECT p.priority, y.yr FROM (SELECT DISTINCT priority FROM runs) p, (SELECT DISTINCT yr FROM runs) y),
    trials AS (SELECT priority, yr, count(*) AS t FROM base WHERE cust % 400 < 20 GROUP BY 1, 2)
    SELECT d.priority, d.yr FROM dims d LEFT JOIN runs r ON r.priority = d.priority AND r.yr = d.yr
      LEFT JOIN trials t ON t.priority = d.priority AND t.yr = d.yr
    WHERE NOT coalesce(r.status = 'completed' AND t.t = 20, FALSE)""",
)
def runs_missing(spark, sf):
    """Cells of the run grid without a finished run (JN12)."""
    rows = run_rows(spark, sf)
    base = prediction_base(spark, sf)
    keys = ["priority", "yr"]
    trials = base.filter(F.col("cust") % 400 < 20).select(*keys)
    done = runs.completed(rows, base.select(*keys), trials, keys, 20)
    return runs.missing(runs.grid_of(rows, keys), done, keys)


@query(
    "runs_manifest",
    f"""WITH {RUNS} SELECT priority, yr, 50 AS search_budget,
    CASE WHEN runtime_seconds IS NULL THEN 'valid reusable run' ELSE 'newly completed run' END AS run_status,
    'Validated metrics, 50 trials, predictions and held-out test evaluation.' AS reason FROM runs""",
)
def runs_manifest(spark, sf):
    """One manifest line per run (ST16)."""
    return runs.manifest(run_rows(spark, sf), ["priority", "yr"])


@query(
    "runs_completion",
    f"""WITH {RUNS} SELECT priority, count_if(status = 'completed') AS n_completed, count(*) AS n_expected,
    count_if(status = 'completed') || '/' || count(*) AS completion FROM runs GROUP BY priority""",
)
def runs_completion(spark, sf):
    """Completed over expected runs (ST17)."""
    return runs.completion(run_rows(spark, sf), "priority")
