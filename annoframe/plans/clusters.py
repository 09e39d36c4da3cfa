"""Similarity, clustering, derivative-group and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.operators import similarity, splits
from annoframe.plans.base import load, query, r, rounded, sql_unit
from annoframe.plans.samples import PRELUDE, sequence_of, signatures
from annoframe.plans.split_sets import _LCS
from annoframe.session import settle

THRESHOLD = 0.5
NAME_THRESHOLD = 0.7

NODES = f"""
sup AS (SELECT s_suppkey AS k, substr(translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'),
        1, CAST(6 + s_suppkey % 7 AS INTEGER)) AS seq FROM supplier),
nodes AS (SELECT seq, min(k) AS first, count(*) AS n_rows FROM sup GROUP BY seq),
p AS (SELECT x.seq AS a, y.seq AS b, x.first AS fa, y.first AS fb FROM nodes x JOIN nodes y ON x.first < y.first),
edges AS (SELECT * FROM (SELECT a, b, fa, fb, {_LCS} AS identity FROM p) WHERE identity >= {THRESHOLD})
"""


def _leaders(order: str) -> str:
    """Sequential greedy clustering as a recursive query over the node order."""
    return f"""
ord AS (SELECT seq, first, row_number() OVER (ORDER BY {order}) AS i FROM nodes),
nb AS (SELECT ord.i, list(o2.i) FILTER (WHERE o2.i IS NOT NULL) AS before FROM ord
       LEFT JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) e ON e.a = ord.seq
       LEFT JOIN ord o2 ON o2.seq = e.b AND o2.i < ord.i GROUP BY ord.i),
walk(i, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT walk.i + 1, CASE WHEN len(list_intersect(coalesce(nb.before, []), leaders)) = 0
                          THEN list_append(leaders, nb.i) ELSE leaders END
  FROM walk JOIN nb ON nb.i = walk.i + 1),
lead AS (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1),
cl AS (SELECT ord.seq, list_position(leaders, CASE WHEN list_contains(leaders, ord.i) THEN ord.i
         ELSE list_min(list_intersect(nb.before, leaders)) END) - 1 AS cluster_id
       FROM ord JOIN nb USING (i), lead)"""


def suppliers(spark, sf):
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), sequence_of("s_suppkey").alias("sequence")
    )


@query(
    "similar_sequences",
    f"""WITH {NODES} SELECT a AS seq_a, b AS seq_b, {r("identity", "identity")} FROM edges""",
)
def similar_sequences(spark, sf):
    """Pairs of distinct sequences at or above an identity (JN8, SM1)."""
    return rounded(similarity.edges(suppliers(spark, sf), "sequence", "k", THRESHOLD))


@query(
    "clusters_in_order",
    f"WITH RECURSIVE {NODES}, {_leaders('first')} SELECT k, cluster_id FROM sup JOIN cl USING (seq)",
)
def clusters_in_order(spark, sf):
    """Leader clusters in input order, expanded to all rows (SM3, SM5)."""
    df = suppliers(spark, sf)
    found = similarity.leader_clusters(df, "sequence", "k", THRESHOLD)
    return similarity.expand_clusters(df, found, "sequence").select("k", "cluster_id")


@query(
    "clusters_longest_first",
    f"""WITH RECURSIVE {NODES}, {_leaders('length(seq) DESC, first')}
    SELECT k, cluster_id FROM sup JOIN cl USING (seq)""",
)
def clusters_longest_first(spark, sf):
    """Leader clusters, longest sequence first (SM4)."""
    df = suppliers(spark, sf)
    found = similarity.leader_clusters(df, "sequence", "k", THRESHOLD, order="length_desc")
    return similarity.expand_clusters(df, found, "sequence").select("k", "cluster_id")


# Part names under text ids, as a table of samples with a sequence and an id would be.
NAMES = f"""
sup AS (SELECT 'PART_' || p_partkey AS k, p_name AS seq FROM part),
nodes AS (SELECT seq, min(k) AS first, count(*) AS n_rows FROM sup GROUP BY seq),
p AS (SELECT x.seq AS a, y.seq AS b, x.first AS fa, y.first AS fb FROM nodes x JOIN nodes y ON x.first < y.first),
edges AS (SELECT * FROM (SELECT a, b, fa, fb, {_LCS} AS identity FROM p) WHERE identity >= {NAME_THRESHOLD})
"""


@query(
    "clusters_of_names",
    f"""WITH RECURSIVE {NAMES}, {_leaders('length(seq) DESC, first')}
    SELECT k, cluster_id FROM sup JOIN cl USING (seq)""",
)
def clusters_of_names(spark, sf):
    """Leader clusters of part names, longest first, by text ids (SM4, SM5)."""
    df = load(spark, sf, "part").select(F.concat(F.lit("PART_"), F.col("p_partkey").cast("string")).alias("k"), "p_name")
    found = similarity.leader_clusters(df, "p_name", "k", NAME_THRESHOLD, order="length_desc")
    return similarity.expand_clusters(df, found, "p_name").select("k", "cluster_id")


SET_THRESHOLD = 0.5


def _words(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-zà-ÿ]+'), lambda t: t <> '')))"


@query(
    "clusters_of_documents",
    f"""WITH RECURSIVE sup AS (SELECT doc_id AS k, CASE WHEN len({_words("text")}) > 0 THEN {_words("text")} END AS seq FROM documents),
    full_sets AS (SELECT seq, min(k) AS first FROM sup WHERE seq IS NOT NULL GROUP BY seq),
    tok AS (SELECT first, len(seq) AS n, unnest(seq) AS t FROM full_sets),
    ov AS (SELECT x.first AS fa, y.first AS fb, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS o
           FROM tok x JOIN tok y ON x.t = y.t AND x.first < y.first GROUP BY 1, 2),
    nodes AS (SELECT first AS seq, first FROM full_sets UNION ALL SELECT k, k FROM sup WHERE seq IS NULL),
    edges AS (SELECT fa AS a, fb AS b FROM ov WHERE o >= {SET_THRESHOLD} * (na + nb - o)),
    {_leaders('first')}
    SELECT k, cluster_id FROM sup LEFT JOIN full_sets f ON f.seq = sup.seq JOIN cl ON cl.seq = coalesce(f.first, k)""",
)
def clusters_of_documents(spark, sf):
    """Leader clusters of documents by their sets of words (SM3)."""
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda t: t != "")
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("k"), words.alias("w"))
    return similarity.set_clusters(docs, "k", "w", SET_THRESHOLD)


@query("clusters_affine")
def clusters_affine(spark, sf):
    """Leader clusters by affine-gap identity (SM2, SM4); SQL has no affine alignment."""
    df = suppliers(spark, sf)
    return similarity.leader_clusters(df, "sequence", "k", 0.4, order="length_desc", method="affine")


@query(
    "split_by_cluster",
    f"""WITH RECURSIVE {NODES}, {_leaders('first')},
    g AS (SELECT cluster_id, row_number() OVER (ORDER BY {sql_unit("42", "cluster_id")}, cluster_id) AS rn,
          count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id FROM cl))
    SELECT k, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val'
      ELSE 'test' END AS split FROM sup JOIN cl USING (seq) JOIN g USING (cluster_id)""",
)
def split_by_cluster(spark, sf):
    """Whole clusters to one side (SP3)."""
    df = suppliers(spark, sf)
    found = similarity.leader_clusters(df, "sequence", "k", THRESHOLD)
    rows = similarity.expand_clusters(df, found, "sequence")
    return splits.by_group(rows, "cluster_id").select("k", "split")


DERIVED = f"""
{PRELUDE},
sg AS (SELECT o.id, o.seq, list_sort(list_distinct(list(type || '@' || array_to_string(list_sort(pos), ',')) FILTER (WHERE type IS NOT NULL))) AS sig
       FROM o LEFT JOIN ann ON ann.id = o.id GROUP BY o.id, o.seq),
num AS (SELECT id, seq, coalesce(sig, []) AS sig, row_number() OVER (PARTITION BY seq ORDER BY id) AS i FROM sg),
walk(seq, i, leaders, id, leader) AS (
  SELECT seq, i, [{{'id': id, 'sig': sig}}], id, id FROM num WHERE i = 1
  UNION ALL
  SELECT seq, i, CASE WHEN hit IS NULL THEN list_append(leaders, {{'id': id, 'sig': sig}}) ELSE leaders END, id, coalesce(hit, id)
  FROM (SELECT num.seq, num.i, num.id, num.sig, walk.leaders,
          list_filter(walk.leaders, lambda l: len(list_filter(l.sig, lambda x: NOT list_contains(num.sig, x)))
            + len(list_filter(num.sig, lambda y: NOT list_contains(l.sig, y))) <= 1)[1].id AS hit
        FROM walk JOIN num ON num.seq = walk.seq AND num.i = walk.i + 1)),
dg AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY leader) > 1 THEN leader END AS derivative_group FROM walk)
"""


def derived(spark, sf):
    found = similarity.derivative_groups(signatures(spark, sf), "id", "sequence", "sig")
    return found.select("id", "derivative_group")


@query("derivative_groups", f"WITH RECURSIVE {DERIVED} SELECT id, derivative_group FROM dg")
def derivative_groups(spark, sf):
    """Groups of samples one annotation apart (SM6)."""
    return derived(spark, sf)


@query(
    "split_by_derivative",
    f"""WITH RECURSIVE {DERIVED},
    u AS (SELECT id, CAST(derivative_group IS NULL AS INTEGER) AS single,
          CASE WHEN derivative_group IS NULL THEN 'r:' || id ELSE 'g:' || derivative_group END AS unit FROM dg),
    g AS (SELECT single, unit, row_number() OVER (PARTITION BY single ORDER BY {sql_unit("42", "single", "unit")}, unit) AS rn,
          count(*) OVER (PARTITION BY single) AS n FROM (SELECT DISTINCT single, unit FROM u))
    SELECT id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val'
      ELSE 'test' END AS split FROM u JOIN g USING (single, unit)""",
)
def split_by_derivative(spark, sf):
    """Derivative groups stay whole, single rows are split separately (SP7)."""
    # Read three times: units, cut points, rows.
    return splits.by_derivative(settle(derived(spark, sf)), "id", "derivative_group").select("id", "split")


@query(
    "derivative_feasibility",
    f"""WITH RECURSIVE {DERIVED}, c AS (SELECT derivative_group AS g, count(*) AS n FROM dg GROUP BY 1),
    f AS (SELECT count(g) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows,
          sum(CASE WHEN g IS NOT NULL THEN n ELSE 0 END) * 1.0 / sum(n) AS cov,
          max(CASE WHEN g IS NOT NULL THEN n ELSE 0 END) * 1.0 / sum(n) AS big FROM c)
    SELECT n_groups > 0 AND cov >= 0.1 AND big <= 0.2 AS feasible, n_groups, n_rows,
      {r("cov", "coverage")}, {r("big", "largest_share")} FROM f""",
)
def derivative_feasibility(spark, sf):
    """Feasibility of the derivative-group split (SP8)."""
    return rounded(splits.feasible_derivatives(derived(spark, sf), "derivative_group").drop("reason"))


@query(
    "edit_pairs",
    f"""WITH d AS (SELECT p_brand, p_name, avg(p_retailprice) AS label, count(*) AS n FROM part GROUP BY p_brand, p_name)
    SELECT a.p_brand, a.p_name AS source, b.p_name AS target, levenshtein(a.p_name, b.p_name) AS distance,
      a.n AS source_rows, b.n AS target_rows, {r("b.label - a.label", "delta", 4)}
    FROM d a JOIN d b ON a.p_brand = b.p_brand AND a.p_name < b.p_name
    WHERE levenshtein(a.p_name, b.p_name) BETWEEN 1 AND 2""",
)
def edit_pairs(spark, sf):
    """Names within two edits of each other, per brand (JN9, SC11)."""
    df = load(spark, sf, "part")
    return rounded(similarity.edit_pairs(df, "p_name", "p_retailprice", ["p_brand"], 2), 4)


@query(
    "edit_pairs_distant",
    f"""WITH d AS (SELECT p_name, avg(p_retailprice) AS label, count(*) AS n FROM part GROUP BY p_name)
    SELECT a.p_name AS source, b.p_name AS target, levenshtein(a.p_name, b.p_name) AS distance, a.n AS source_rows, b.n AS target_rows,
      {r("b.label - a.label", "delta", 4)} FROM d a JOIN d b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) BETWEEN 1 AND 4""",
)
def edit_pairs_distant(spark, sf):
    """Names within four edits of each other (JN9, SC11)."""
    return rounded(similarity.edit_pairs(load(spark, sf, "part"), "p_name", "p_retailprice", max_distance=4), 4)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), lambda t: t <> ''))"
NEAREST = f"""
q AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
m AS (SELECT count(*) AS m FROM c WHERE len(w) > 0),
qw AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM q),
cw AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM c),
j AS (SELECT doc_id, item_id, count(*) * 1.0 / (max(qw.n) + max(cw.n) - count(*)) AS j
      FROM qw JOIN cw USING (t) GROUP BY doc_id, item_id),
top AS (SELECT doc_id, max(j) AS best, sum(j) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC) AS rn FROM j) WHERE rn <= 5 GROUP BY doc_id),
near AS (SELECT q.doc_id, CASE WHEN len(w) > 0 THEN coalesce(best, 0) END AS max_similarity,
         CASE WHEN len(w) > 0 THEN coalesce(s, 0) / least(m, 5) END AS mean_top_similarity
         FROM q LEFT JOIN top ON top.doc_id = q.doc_id, m)
"""


def nearest(spark, sf):
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda t: t != "")
    docs = load(spark, sf, "documents").select("doc_id", words.alias("w"))
    items = load(spark, sf, "benchmark").select("item_id", words.alias("w"))
    return similarity.nearest_jaccard(docs, items, "doc_id", "w")


@query(
    "nearest_items",
    f"""WITH {NEAREST} SELECT doc_id, {r("max_similarity", "max_similarity")},
    {r("mean_top_similarity", "mean_top_similarity")} FROM near""",
)
def nearest_items(spark, sf):
    """Highest and mean top-five set similarity of documents to the benchmark items (SM7)."""
    return rounded(nearest(spark, sf))


@query(
    "nearest_items_approximate",
    f"""WITH q AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    m AS (SELECT count(*) AS m FROM c WHERE len(w) > 0),
    word AS (SELECT t, ('0x' || substr(md5(t), 1, 7))::BIGINT AS a, ('0x' || substr(md5(t), 9, 7))::BIGINT AS b
             FROM (SELECT DISTINCT unnest(w) AS t FROM (SELECT w FROM q UNION ALL SELECT w FROM c))),
    qw AS (SELECT doc_id, unnest(w) AS t, len(w) AS n FROM q), cw AS (SELECT item_id, unnest(w) AS t, len(w) AS n FROM c),
    qs AS (SELECT doc_id, i, min((a + i * b) % 2147483647) AS v FROM qw JOIN word USING (t), range(128) f(i) GROUP BY 1, 2),
    cs AS (SELECT item_id, i, min((a + i * b) % 2147483647) AS v FROM cw JOIN word USING (t), range(128) f(i) GROUP BY 1, 2),
    met AS (SELECT DISTINCT x.doc_id, y.item_id FROM qs x JOIN cs y ON x.i = y.i AND x.v = y.v AND x.i % 2 = 0
            JOIN qs x2 ON x2.doc_id = x.doc_id AND x2.i = x.i + 1 JOIN cs y2 ON y2.item_id = y.item_id AND y2.i = y.i + 1 AND x2.v = y2.v),
    j AS (SELECT doc_id, item_id, count(cw.t) * 1.0 / (max(qw.n) + max(z.n) - count(cw.t)) AS j FROM met JOIN qw USING (doc_id)
          JOIN (SELECT item_id, any_value(n) AS n FROM cw GROUP BY 1) z USING (item_id)
          LEFT JOIN cw ON cw.item_id = met.item_id AND cw.t = qw.t GROUP BY doc_id, item_id),
    top AS (SELECT doc_id, max(j) AS best, sum(j) AS s FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC) AS rn FROM j) WHERE rn <= 5 GROUP BY doc_id)
    SELECT q.doc_id, {r("CASE WHEN len(w) > 0 THEN coalesce(best, 0) END", "max_similarity")},
      {r("CASE WHEN len(w) > 0 THEN coalesce(s, 0) / least(m, 5) END", "mean_top_similarity")}
    FROM q LEFT JOIN top ON top.doc_id = q.doc_id, m""",
)
def nearest_items_approximate(spark, sf):
    """Similarity of documents to the benchmark items that share a MinHash band (SM7, approximate)."""
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda t: t != "")
    docs = load(spark, sf, "documents").select("doc_id", words.alias("w"))
    items = load(spark, sf, "benchmark").select("item_id", words.alias("w"))
    return rounded(similarity.nearest_approximate(docs, items, "doc_id", "w"))


@query(
    "nearest_summary",
    f"""WITH {NEAREST}, v AS (SELECT max_similarity AS x FROM near WHERE max_similarity IS NOT NULL)
    SELECT {r("quantile_cont(x, 0.5)", "median")}, {r("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "iqr")},
      {r("avg(x)", "mean")}, {r("count_if(x < 0.3) * 1.0 / count(*)", "fraction_below_0_3")},
      {r("count_if(x < 0.5) * 1.0 / count(*)", "fraction_below_0_5")},
      {r("count_if(x > 0.7) * 1.0 / count(*)", "fraction_above_0_7")} FROM v""",
)
def nearest_summary(spark, sf):
    """Summary of the nearest similarities (SM9)."""
    return rounded(similarity.summary(nearest(spark, sf)))
