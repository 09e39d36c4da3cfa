"""Census queries on documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.operators import census
from annoframe.plans.base import load, query, r, rounded


@query(
    "census_profile",
    """SELECT count(*) AS total_records, 'event_id,ts,user_id,event_type,value,props' AS fields,
       CAST(NULL AS VARCHAR) AS sequence_column, 'value' AS label_column FROM events""",
)
def census_profile(spark, sf):
    """Row count, fields and detected columns (CE1)."""
    return census.profile(load(spark, sf, "events"))


@query(
    "census_missing",
    f"""WITH j AS (SELECT d.doc_id, text, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
    m AS (SELECT count(*) AS n, count(*) - count(doc_id) AS a, count(*) - count(text) AS b,
                 count(*) - count(lang) AS c, count(*) - count(quality) AS e, count(*) - count(toxic) AS f FROM j),
    u AS (SELECT 'doc_id' AS "column", a AS missing, n FROM m UNION ALL SELECT 'text', b, n FROM m
          UNION ALL SELECT 'lang', c, n FROM m UNION ALL SELECT 'quality', e, n FROM m
          UNION ALL SELECT 'toxic', f, n FROM m)
    SELECT "column", missing, {r("100.0 * missing / n", "pct_missing")} FROM u WHERE missing > 0""",
)
def census_missing(spark, sf):
    """Missing values per column (CE3)."""
    df = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return rounded(census.missing(df, ["doc_id", "text", "lang", "quality", "toxic"]))


def _stats_sql(table: str, value: str, by: str) -> str:
    return f"""SELECT {by}, count({value}) AS count, {r(f"avg({value})", "mean")},
    {r(f"stddev_samp({value})", "std")}, {r(f"min({value})", "min")}, {r(f"max({value})", "max")},
    {r(f"quantile_cont({value}, 0.25)", "q25")}, {r(f"quantile_cont({value}, 0.5)", "median")},
    {r(f"quantile_cont({value}, 0.75)", "q75")} FROM {table} GROUP BY {by}"""


@query("census_numeric", _stats_sql("events", "value", "event_type"))
def census_numeric(spark, sf):
    """Exact summary of event values per type (CE4)."""
    return rounded(census.numeric_stats(load(spark, sf, "events"), "value", ["event_type"]))


@query("census_numeric_prices", _stats_sql("lineitem", "l_extendedprice", "l_linestatus"))
def census_numeric_prices(spark, sf):
    """Exact summary of line prices per status (CE4)."""
    df = load(spark, sf, "lineitem")
    return rounded(census.numeric_stats(df, "l_extendedprice", ["l_linestatus"]))


@query(
    "census_lengths",
    f"""SELECT lang, {r("avg(length(text))", "mean")}, {r("stddev_samp(length(text))", "std")},
    {r("min(length(text))", "min")}, {r("max(length(text))", "max")},
    {r("quantile_cont(length(text), 0.5)", "median")} FROM documents GROUP BY lang""",
)
def census_lengths(spark, sf):
    """Text length statistics per language (CE5)."""
    return rounded(census.length_stats(load(spark, sf, "documents"), "text", ["lang"]))


@query(
    "census_patterns",
    r"""WITH p AS (SELECT * FROM (VALUES ('contains_brackets', '[\[\]]'), ('contains_dashes', '-'),
         ('contains_lowercase', '\p{Ll}'), ('contains_special_chars', '[(){}*#]'),
         ('all_uppercase', '^\p{Lu}+$')) t(pattern, re)),
    h AS (SELECT pattern, doc_id, text FROM documents, p WHERE regexp_matches(text, re))
    SELECT p.pattern, count(doc_id) AS n, md5(arg_min(text, doc_id)) AS example
    FROM p LEFT JOIN h ON h.pattern = p.pattern GROUP BY p.pattern""",
)
def census_patterns(spark, sf):
    """Notation patterns with the first example (CE6)."""
    out = census.patterns(load(spark, sf, "documents"), "text", "doc_id")
    return out.withColumn("example", F.md5("example"))


@query("census_first", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def census_first(spark, sf):
    """First records by key (CE7)."""
    return census.first_records(load(spark, sf, "nation"), "n_nationkey")


@query("census_duplicates", "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def census_duplicates(spark, sf):
    """Copies after the first of each text (CE8)."""
    return census.duplicates(load(spark, sf, "documents"), "text")


@query(
    "census_outliers",
    """WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT count(value) AS n_values, sum(CASE WHEN abs(value - m) > 3 * s THEN 1 ELSE 0 END) AS n_outliers
    FROM events, m""",
)
def census_outliers(spark, sf):
    """Values beyond three standard deviations (CE9)."""
    return census.outliers(load(spark, sf, "events"), "value")


@query(
    "census_pair_potential",
    """WITH l AS (SELECT length(text) AS len, count(*) AS n, count(DISTINCT text) AS u FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS total_sequences, CAST(sum(u) AS BIGINT) AS unique_sequences,
           CAST(sum(n * (n - 1) // 2) AS BIGINT) AS rough_potential_pairs FROM l""",
)
def census_pair_potential(spark, sf):
    """Same-length pair potential (CE10)."""
    return census.pair_potential(load(spark, sf, "documents"), "text")


@query("census_length_histogram", "SELECT length(p_name) AS length, count(*) AS n FROM part GROUP BY 1")
def census_length_histogram(spark, sf):
    """Rows per text length (CE10)."""
    return census.length_histogram(load(spark, sf, "part"), "p_name")
