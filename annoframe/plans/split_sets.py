"""Split and leakage queries on order samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.functions import sequences as S
from annoframe.operators import leakage, similarity, splits
from annoframe.plans.base import load, query, r, rounded, sql_unit
from annoframe.plans.samples import KEYS, PRELUDE, orders_with_sequence, samples

CUTOFFS = (1996, 1997, 1998, 1999, 2000, 2001)


def _stratified_sql(stratum: str, again: str) -> str:
    """Test rows of every stratum, then validation rows of every stratum of the rest."""
    return f"""
q1 AS (SELECT quantile_cont(label, 0.25) AS a, quantile_cont(label, 0.5) AS b, quantile_cont(label, 0.75) AS c FROM o),
t1 AS (SELECT o.*, {stratum} AS st FROM o, q1),
t2 AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {sql_unit("'42:test'", "id")}, id) AS rn,
       count(*) OVER (PARTITION BY st) AS cnt FROM t1),
rest AS (SELECT * EXCLUDE (st, rn, cnt) FROM t2 WHERE rn > floor(cnt * 0.15 + 0.5)),
q2 AS (SELECT quantile_cont(label, 0.25) AS a, quantile_cont(label, 0.5) AS b, quantile_cont(label, 0.75) AS c FROM rest),
v1 AS (SELECT rest.*, {again} AS st FROM rest, q2),
v2 AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {sql_unit("'42:val'", "id")}, id) AS rn,
       count(*) OVER (PARTITION BY st) AS cnt FROM v1),
sp AS (SELECT id, 'test' AS split FROM t2 WHERE rn <= floor(cnt * 0.15 + 0.5)
       UNION ALL SELECT id, CASE WHEN rn <= floor(cnt * (0.15 / (0.7 + 0.15)) + 0.5) THEN 'val' ELSE 'train' END FROM v2)"""


_QUART = "(label >= a)::INT + (label >= b)::INT + (label >= c)::INT"
RANDOM = _stratified_sql(_QUART, _QUART)
PROFILE = _stratified_sql("priority", "priority")


def random_split(spark, sf):
    return splits.stratified(orders_with_sequence(spark, sf), "id", label="label")


@query("split_random", f"WITH {PRELUDE}, {RANDOM} SELECT id, split FROM sp")
def split_random(spark, sf):
    """Random split stratified by label quartile (SP1)."""
    return random_split(spark, sf).select("id", "split")


@query("split_by_profile", f"WITH {PRELUDE}, {PROFILE} SELECT id, split FROM sp")
def split_by_profile(spark, sf):
    """Random split stratified by a profile column (SP5)."""
    df = orders_with_sequence(spark, sf)
    return splits.stratified(df, "id", strata="priority").select("id", "split")


GROUPED = f"""
g AS (SELECT cust, row_number() OVER (ORDER BY {sql_unit("42", "cust")}, cust) AS rn, count(*) OVER () AS n
      FROM (SELECT DISTINCT cust FROM o)),
gs AS (SELECT cust, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val'
       ELSE 'test' END AS split FROM g)"""


@query("split_by_group", f"WITH {PRELUDE}, {GROUPED} SELECT id, split FROM o JOIN gs USING (cust)")
def split_by_group(spark, sf):
    """Whole customers to one side; ratios over customers (SP2)."""
    return splits.by_group(orders_with_sequence(spark, sf), "cust").select("id", "split")


@query(
    "split_by_group_fill",
    f"""WITH {PRELUDE},
    g AS (SELECT cust, count(*) AS w, {sql_unit("42", "cust")} AS u FROM o GROUP BY cust),
    c AS (SELECT cust, w, u, sum(w) OVER (ORDER BY u, cust) - w AS before, (SELECT count(*) FROM o) AS n FROM g),
    t AS (SELECT *, before < floor(n * 0.15) AS is_test FROM c),
    v AS (SELECT *, before - (SELECT sum(w) FROM t WHERE is_test) AS before2 FROM t)
    SELECT id, CASE WHEN is_test THEN 'test' WHEN before2 < floor(n * 0.15) THEN 'val' ELSE 'train' END AS split
    FROM o JOIN v USING (cust)""",
)
def split_by_group_fill(spark, sf):
    """Customers in hash order fill test, then val (SP4)."""
    return splits.by_group_fill(orders_with_sequence(spark, sf), "cust").select("id", "split")


@query(
    "split_within_profile",
    f"""WITH {PRELUDE},
    g AS (SELECT priority, cust, row_number() OVER (PARTITION BY priority ORDER BY {sql_unit("42", "priority", "cust")}, cust)
          AS rn, count(*) OVER (PARTITION BY priority) AS n FROM (SELECT DISTINCT priority, cust FROM o)),
    gs AS (SELECT priority, cust, CASE WHEN rn <= floor(n * 0.7) THEN 'train'
           WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM g)
    SELECT id, split FROM o JOIN gs USING (priority, cust)""",
)
def split_within_profile(spark, sf):
    """Customers split inside each profile (SP6)."""
    df = orders_with_sequence(spark, sf)
    return splits.by_group(df, "cust", within=["priority"]).select("id", "split")


_SUMMARY = f"""SELECT split, count(*) AS n, {r("count(*) * 1.0 / (SELECT count(*) FROM sp)", "share")},
  CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS target,
  abs(count(*) * 1.0 / (SELECT count(*) FROM sp) - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) <= 0.02
    AS within_tolerance FROM sp GROUP BY split"""


@query("split_summary", f"WITH {PRELUDE}, {RANDOM} {_SUMMARY}")
def split_summary(spark, sf):
    """Rows, shares and tolerance per split (SP9, SP10)."""
    return rounded(splits.summary(random_split(spark, sf)))


@query(
    "split_metadata",
    f"""WITH {PRELUDE}, {GROUPED}, m AS (SELECT split FROM o JOIN gs USING (cust)),
    f AS (SELECT count(*) AS k, max(c) * 1.0 / sum(c) AS big FROM (SELECT cust, count(*) AS c FROM o GROUP BY cust))
    SELECT 'by_group' AS strategy_name, k >= 20 AND big <= 0.5 AS feasible, CAST(NULL AS VARCHAR) AS reason,
      count_if(split = 'train') AS train_count, count_if(split = 'val') AS val_count,
      count_if(split = 'test') AS test_count, 0.7 AS train_ratio, 42 AS random_seed, '1.0.0' AS split_version
    FROM m, f GROUP BY k, big""",
)
def split_metadata(spark, sf):
    """One-row description of a group split with its feasibility (SP8, SP9)."""
    df = splits.by_group(orders_with_sequence(spark, sf), "cust")
    out = splits.metadata(df, "by_group", splits.feasible_groups(df, "cust"))
    return out.select("*", F.col("strategy_params.train_ratio").alias("train_ratio")).drop("strategy_params")


@query(
    "split_row_metadata",
    f"""WITH {PRELUDE}, {GROUPED} SELECT id, 'by_group' AS split_strategy, split AS split_name,
    CAST(cust AS VARCHAR) AS scaffold_id, '42' AS random_seed FROM o JOIN gs USING (cust)""",
)
def split_row_metadata(spark, sf):
    """Per-row split metadata (SP9)."""
    df = splits.by_group(orders_with_sequence(spark, sf), "cust")
    df = splits.with_metadata(df, "by_group", {"scaffold_id": "cust"})
    keys = ("split_strategy", "split_name", "scaffold_id", "random_seed")
    return df.select("id", *[F.col(f"split_metadata.{k}").alias(k) for k in keys])


@query(
    "split_disjoint",
    f"WITH {PRELUDE} SELECT CAST(0 AS BIGINT) AS train_val, CAST(0 AS BIGINT) AS train_test, "
    "CAST(0 AS BIGINT) AS val_test FROM o LIMIT 1",
)
def split_disjoint(spark, sf):
    """Ids in more than one split: none (JN11)."""
    return splits.disjoint(random_split(spark, sf), "id")


@query(
    "split_group_sizes",
    f"WITH {PRELUDE}, {KEYS} SELECT profile, count(*) AS n FROM s GROUP BY profile",
)
def split_group_sizes(spark, sf):
    """Rows per annotation profile (SP11)."""
    df = samples(spark, sf).select(S.profile_key(F.col("edits")).alias("profile"))
    return splits.distribution(df, "profile")


@query(
    "split_feasibility",
    f"""WITH {PRELUDE}, {KEYS},
    p AS (SELECT profile, count(*) AS n, count(DISTINCT cust) AS g FROM s GROUP BY profile),
    c AS (SELECT cust, count(*) AS n FROM s GROUP BY cust)
    SELECT 'random' AS strategy, (SELECT count(*) FROM s) >= 10 AS feasible
    UNION ALL SELECT 'by_group', count(*) >= 20 AND max(n) * 1.0 / sum(n) <= 0.5 FROM c
    UNION ALL SELECT 'clusters', count(*) >= 20 FROM c
    UNION ALL SELECT 'profile', 100.0 * count_if(n < 10) / count(*) <= 30 FROM p
    UNION ALL SELECT 'within', count_if(g < 5) = 0 FROM p""",
)
def split_feasibility(spark, sf):
    """Feasibility of the split strategies (SP8)."""
    df = samples(spark, sf).select("id", "cust", S.profile_key(F.col("edits")).alias("profile"))
    parts = {
        "random": splits.feasible_random(df),
        "by_group": splits.feasible_groups(df, "cust"),
        "clusters": splits.feasible_clusters(df, "cust"),
        "profile": splits.feasible_profiles(df, "profile"),
        "within": splits.feasible_within(df, "profile", "cust"),
    }
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("strategy"), "feasible")
        out = row if out is None else out.unionByName(row)
    return out


def timed(spark, sf):
    return splits.time_forward(orders_with_sequence(spark, sf), "id", "yr", CUTOFFS)


_CUT_ROWS = ", ".join(f"({c})" for c in CUTOFFS)
TIMED = f"""
cuts AS (SELECT * FROM (VALUES {_CUT_ROWS}) t(cutoff)),
fut AS (SELECT cutoff, id, row_number() OVER (PARTITION BY cutoff ORDER BY {sql_unit("42", "id")}, id) AS rn,
        count(*) OVER (PARTITION BY cutoff) AS n FROM o JOIN cuts ON yr >= cutoff),
tf AS (SELECT cutoff, 'test' AS side, id FROM fut WHERE rn > n // 2
       UNION ALL SELECT cutoff, 'train', id FROM o JOIN cuts ON yr < cutoff)"""


@query(
    "split_time_forward",
    f"""WITH {PRELUDE}, {TIMED},
    a AS (SELECT id, string_agg(CAST(cutoff AS VARCHAR), ',' ORDER BY cutoff) AS t FROM tf WHERE side = 'train' GROUP BY id),
    b AS (SELECT id, string_agg(CAST(cutoff AS VARCHAR), ',' ORDER BY cutoff) AS t FROM tf WHERE side = 'test' GROUP BY id)
    SELECT o.id, coalesce(a.t, '') AS train_for, coalesce(b.t, '') AS test_for
    FROM o LEFT JOIN a ON a.id = o.id LEFT JOIN b ON b.id = o.id""",
)
def split_time_forward(spark, sf):
    """Cutoffs every row serves as training or test row (SP13)."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return timed(spark, sf).select(
        "id", text("train_for").alias("train_for"), text("test_for").alias("test_for")
    )


@query(
    "split_support_query",
    """WITH f AS (SELECT c_custkey, c_mktsegment || '|' || c_nationkey AS family,
         CAST(coalesce(nullif(regexp_extract(c_name, '(\\d+)[^\\d]*$', 1), ''), '0') AS BIGINT) % 10 AS num FROM customer),
    n AS (SELECT *, count(*) OVER (PARTITION BY family) AS n_family, (SELECT count(*) FROM f) AS total,
          row_number() OVER (PARTITION BY family ORDER BY num, c_custkey) AS rn FROM f)
    SELECT c_custkey, family, n_family, total - n_family AS history_rows,
           CAST(greatest(3, floor(n_family * 0.3)) AS BIGINT) AS n_support,
           CASE WHEN rn <= greatest(3, floor(n_family * 0.3)) THEN 'support' ELSE 'query' END AS role
    FROM n WHERE n_family >= 8""",
)
def split_support_query(spark, sf):
    """Support and query rows of every family (SP14)."""
    df = load(spark, sf, "customer").select(
        "c_custkey",
        F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("family"),
        (S.trailing_number(F.col("c_name")) % 10).alias("num"),
    )
    out = splits.support_query(df, "family", ["num", "c_custkey"])
    return out.select("c_custkey", "family", "n_family", "history_rows", "n_support", "role")


# --- leakage -------------------------------------------------------------------------------


def split_samples(spark, sf):
    """Order samples with keys and the group split."""
    orders = splits.by_group(
        orders_with_sequence(spark, sf), "priority", splits.Ratios(0.6, 0.2, 0.2)
    )
    return samples(spark, sf, orders).withColumns(
        {
            "scaffold": S.scaffold_key(F.col("sequence"), F.col("edits")),
            "profile": S.profile_key(F.col("edits")),
        }
    )


SPLIT = f"""
pg AS (SELECT priority, row_number() OVER (ORDER BY {sql_unit("42", "priority")}, priority) AS rn, count(*) OVER () AS n
       FROM (SELECT DISTINCT priority FROM o)),
ps AS (SELECT priority, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.6) + floor(n * 0.2) THEN 'val'
       ELSE 'test' END AS split FROM pg),
ss AS (SELECT s.*, split FROM s JOIN ps USING (priority))"""


@query(
    "leakage_key_overlap",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT},
    k AS (SELECT scaffold, count_if(split = 'train') AS a, count_if(split = 'test') AS b FROM ss GROUP BY scaffold)
    SELECT count_if(a > 0 AND b > 0) AS n_shared_scaffolds,
      {r("100.0 * sum(CASE WHEN a > 0 THEN b ELSE 0 END) / sum(b)", "pct_test_shared_scaffold")} FROM k""",
)
def leakage_key_overlap(spark, sf):
    """Scaffolds on both sides and test rows that have one (JN10, LK2)."""
    return rounded(leakage.key_overlap(split_samples(spark, sf), "scaffold"))


@query(
    "leakage_profile_cosine",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT},
    k AS (SELECT profile, count_if(split = 'train') AS a, count_if(split = 'test') AS b FROM ss GROUP BY profile)
    SELECT {r("sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))", "edit_profile_cosine_similarity")} FROM k""",
)
def leakage_profile_cosine(spark, sf):
    """Cosine of profile frequencies (LK4)."""
    return rounded(leakage.profile_cosine(split_samples(spark, sf), "profile"))


_FAM_ROWS = "('n_terminal'), ('c_terminal'), ('sidechain'), ('backbone'), ('cyclization'), ('substitution'), ('other')"


@query(
    "leakage_js_divergence",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, fam AS (SELECT * FROM (VALUES {_FAM_ROWS}) t(family)),
    c AS (SELECT fam.family, count_if(split = 'train') AS p, count_if(split = 'test') AS q
          FROM fam LEFT JOIN ann ON ann.family = fam.family LEFT JOIN ss ON ss.id = ann.id GROUP BY fam.family),
    d AS (SELECT p / (SELECT sum(p) FROM c) + 1e-10 AS p, q / (SELECT sum(q) FROM c) + 1e-10 AS q FROM c),
    e AS (SELECT p / (SELECT sum(p) FROM d) AS p, q / (SELECT sum(q) FROM d) AS q FROM d)
    SELECT {r("sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2", "edit_family_js_divergence", 9)} FROM e""",
)
def leakage_js_divergence(spark, sf):
    """Jensen-Shannon divergence of family counts (LK5)."""
    return rounded(leakage.js_divergence(split_samples(spark, sf), "edits"), 9)


@query(
    "leakage_ks",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT},
    n AS (SELECT count_if(split = 'train') AS m, count_if(split = 'test') AS n FROM ss),
    v AS (SELECT label, count_if(split = 'train') AS a, count_if(split = 'test') AS b FROM ss
          WHERE split IN ('train', 'test') GROUP BY label),
    c AS (SELECT abs(sum(a) OVER (ORDER BY label) * 1.0 / n.m - sum(b) OVER (ORDER BY label) * 1.0 / n.n) AS gap FROM v, n),
    d AS (SELECT max(gap) AS d, max(sqrt(m * 1.0 * n / (m + n))) AS e FROM c, n),
    p AS (SELECT d, e * d AS lam FROM d)
    SELECT {r("d", "ks_statistic")}, {r('''CASE WHEN max(lam) < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
      sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)))) END''', "ks_pvalue")}
    FROM p, range(1, 101) t(k) GROUP BY d""",
)
def leakage_ks(spark, sf):
    """Kolmogorov-Smirnov statistic and its limiting p (LK6)."""
    return rounded(leakage.ks(split_samples(spark, sf), "label", exact_up_to=0))


@query(
    "leakage_ks_exact",
    f"""WITH RECURSIVE ss AS (SELECT s_acctbal AS label, CASE WHEN s_nationkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM supplier),
    n AS (SELECT count_if(split = 'train')::BIGINT AS m, count_if(split = 'test')::BIGINT AS n FROM ss),
    v AS (SELECT label, count_if(split = 'train') AS a, count_if(split = 'test') AS b FROM ss GROUP BY label),
    c AS (SELECT abs(sum(a) OVER (ORDER BY label) * n.n - sum(b) OVER (ORDER BY label) * n.m) AS gap FROM v, n),
    h AS (SELECT m, n, (SELECT max(gap) FROM c)::BIGINT AS h FROM n),
    path(k, a) AS (
      SELECT 0, list_transform(range(m + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM h
      UNION ALL
      SELECT k + 1, list_transform(range(m + 1), lambda i: CASE WHEN k + 1 - i < 0 OR k + 1 - i > n OR abs(i * n - (k + 1 - i) * m) >= h THEN 0.0
        ELSE (coalesce(CASE WHEN i > 0 THEN a[i] END, 0.0) * i + a[i + 1] * (k + 1 - i)) / (k + 1) END) FROM path, h WHERE k < m + n)
    SELECT {r("h * 1.0 / (m * n)", "ks_statistic")}, {r("1 - a[m + 1]", "ks_pvalue")} FROM path, h WHERE k = m + n""",
)
def leakage_ks_exact(spark, sf):
    """Kolmogorov-Smirnov statistic and exact p of supplier balances (LK6)."""
    side = F.when(F.col("s_nationkey") % 4 == 0, "test").otherwise("train")
    return rounded(leakage.ks(load(spark, sf, "supplier").select(F.col("s_acctbal").alias("label"), side.alias("split")), "label"))


@query(
    "leakage_label_stats",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT} SELECT {", ".join(
        r(f"avg(CASE WHEN split = '{s}' THEN label END)", f"{s}_label_mean", 4) + ", "
        + r(f"stddev_pop(CASE WHEN split = '{s}' THEN label END)", f"{s}_label_std", 4)
        for s in ("train", "val", "test"))} FROM ss""",
)
def leakage_label_stats(spark, sf):
    """Mean and population sd per split (LK7)."""
    return rounded(leakage.label_stats(split_samples(spark, sf), "label"), 4)


# Longest common subsequence in SQL, bit-parallel over the letters of the left text.
_LCS = """CASE WHEN a = b THEN 1.0 ELSE (length(b) - bit_count(CAST(list_reduce(
  list_transform(string_split(a, ''), lambda ch: list_sum(list_transform(range(length(b)),
    lambda i: CASE WHEN substr(b, CAST(i AS INTEGER) + 1, 1) = ch THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END))::BIGINT),
  lambda v, m: (((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS BIGINT) << CAST(length(b) AS INTEGER)) - 1)),
  (CAST(1 AS BIGINT) << CAST(length(b) AS INTEGER)) - 1) AS BIGINT))) * 1.0 / greatest(length(a), length(b)) END"""


def _cross_sql(limit: int) -> str:
    return f"""
tr AS (SELECT id, seq, row_number() OVER (ORDER BY {sql_unit("42", "id")}, id) - 1 AS i FROM ss WHERE split = 'train'),
te AS (SELECT id, seq, row_number() OVER (ORDER BY {sql_unit("42", "id")}, id) - 1 AS j FROM ss WHERE split = 'test'),
n AS (SELECT (SELECT count(*) FROM tr) AS n1, (SELECT count(*) FROM te) AS n2),
draws AS (SELECT draw, {sql_unit("'42:i'", "draw")} % n1 AS i, {sql_unit("'42:j'", "draw")} % n2 AS j
          FROM n, range({limit}) t(draw)),
pairs AS (SELECT draw, tr.id AS left_key, te.id AS right_key, tr.seq AS a, te.seq AS b
          FROM draws JOIN tr USING (i) JOIN te USING (j)),
scored AS (SELECT draw, left_key, right_key, {_LCS} AS identity FROM pairs)"""


@query(
    "leakage_sampled_pairs",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, {_cross_sql(10000)}
    SELECT draw, left_key, right_key, {r("identity", "identity")} FROM scored""",
)
def leakage_sampled_pairs(spark, sf):
    """Identity of hashed train-test pair draws (JN7, SM1)."""
    df = split_samples(spark, sf)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    return rounded(similarity.sampled_pairs(train, test, "sequence", "id"))


# Exact: the best identity of each distinct test sequence over all distinct train sequences.
_BEST = f"""
qt AS (SELECT seq, count_if(split = 'train') AS tr, count_if(split = 'test') AS te FROM ss GROUP BY seq),
far AS (SELECT x.seq, x.te, x.seq AS a, y.seq AS b FROM qt x, qt y WHERE x.te > 0 AND x.tr = 0 AND y.tr > 0),
best AS (SELECT seq, te, max({_LCS}) AS best FROM far GROUP BY seq, te
         UNION ALL SELECT seq, te, 1.0 FROM qt WHERE te > 0 AND tr > 0)"""


@query(
    "leakage_similarity",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, {_BEST}
    SELECT {r("max(best)", "max_sequence_identity")},
      {r("100.0 * sum(CASE WHEN best > 0.7 THEN te ELSE 0 END) / sum(te)", "pct_test_high_similarity")} FROM best""",
)
def leakage_similarity(spark, sf):
    """Highest train-test identity and share of test rows with a similar one, over all pairs (LK1)."""
    rows = splits.by_group(orders_with_sequence(spark, sf), "priority", splits.Ratios(0.6, 0.2, 0.2))
    return rounded(leakage.sequence_similarity(rows, "sequence"))


@query(
    "leakage_sampled_mean",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, {_cross_sql(10000)}
    SELECT {r("avg(identity)", "mean_test_train_similarity")} FROM scored""",
)
def leakage_sampled_mean(spark, sf):
    """Mean identity of hashed train-test draws (LK1)."""
    return rounded(leakage.sampled_mean_identity(split_samples(spark, sf), "id", "sequence"))


# Exact: every pair of distinct sequences, with the rows of both.
_MEAN = f"""
met AS (SELECT x.te * y.tr AS w, x.seq AS a, y.seq AS b FROM qt x, qt y WHERE x.te > 0 AND y.tr > 0),
mean AS (SELECT sum(w * {_LCS}) / sum(w) AS mean FROM met)"""


@query(
    "leakage_mean_identity",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, {_BEST}, {_MEAN} SELECT {r("mean", "mean_test_train_similarity")}, 0.0::DOUBLE AS standard_error FROM mean""",
)
def leakage_mean_identity(spark, sf):
    """Mean identity of all train-test pairs (LK1, JN7)."""
    rows = splits.by_group(orders_with_sequence(spark, sf), "priority", splits.Ratios(0.6, 0.2, 0.2))
    return rounded(leakage.mean_identity(rows, "id", "sequence"))


@query(
    "leakage_report",
    f"""WITH {PRELUDE}, {KEYS}, {SPLIT}, {_BEST}, {_MEAN},
    k AS (SELECT scaffold, count_if(split = 'train') AS a, count_if(split = 'test') AS b FROM ss GROUP BY scaffold),
    x AS (SELECT (SELECT max(best) FROM best) AS mi,
          (SELECT 100.0 * sum(CASE WHEN best > 0.7 THEN te ELSE 0 END) / sum(te) FROM best) AS hi,
          (SELECT 100.0 * sum(CASE WHEN a > 0 THEN b ELSE 0 END) / sum(b) FROM k) AS ov, (SELECT mean FROM mean) AS mean)
    SELECT {r("mi", "max_sequence_identity")}, {r("mean", "mean_test_train_similarity")}, {r("hi", "pct_test_high_similarity")}, {r("ov", "pct_test_shared_scaffold")},
      CASE WHEN mi < 0.7 AND ov < 10 THEN 'low' WHEN mi > 0.85 OR ov > 50 THEN 'high' ELSE 'moderate' END AS overall_risk
    FROM x""",
)
def leakage_report(spark, sf):
    """The full leakage row, shown by its main figures and risk class (LK8, LK9)."""
    out = leakage.report(
        split_samples(spark, sf), "id", "sequence", "edits", "label", "scaffold", "profile"
    )
    return rounded(out.select("max_sequence_identity", "mean_test_train_similarity", "pct_test_high_similarity", "pct_test_shared_scaffold", "overall_risk"))
