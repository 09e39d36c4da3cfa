"""The driver tables as annotated samples: an order is a sample, its lines are annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.functions.sequences import once
from annoframe.operators import similarity
from annoframe.plans.base import load

DIGITS_TO_LETTERS = ("0123456789abcdef", "ACDEFGHIKLMNPQRS")

# The same mapping in SQL: o (samples), ann (annotations, one row each).
PRELUDE = """
o AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS label, o_orderstatus AS status,
         o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS yr,
         substr(translate(md5(CAST(o_custkey AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'),
                1, CAST(6 + o_custkey % 7 AS INTEGER)) AS seq
  FROM orders),
lines AS (
  SELECT o.id, o.seq, CAST(length(o.seq) AS INTEGER) AS n, l_linenumber AS ln, l_returnflag AS rf,
         l_linestatus AS ls, CAST(l_partkey % length(o.seq) AS INTEGER) AS p,
         row_number() OVER (PARTITION BY o.id
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
  FROM o JOIN lineitem ON l_orderkey = o.id),
ann AS (
  SELECT id, seq, n, idx,
         CASE ln WHEN 1 THEN 'n_terminal' WHEN 2 THEN 'c_terminal' WHEN 3 THEN 'sidechain'
                 WHEN 4 THEN 'backbone' WHEN 5 THEN 'cyclization' WHEN 6 THEN 'substitution'
                 ELSE 'other' END AS family,
         CASE ln WHEN 1 THEN CASE rf WHEN 'A' THEN 'acetylation' ELSE 'n_acetylation' END
                 WHEN 2 THEN 'amidation'
                 WHEN 3 THEN CASE rf WHEN 'A' THEN 'acetylation' WHEN 'N' THEN 'phosphorylation'
                                     ELSE 'amidation' END
                 WHEN 4 THEN CASE rf WHEN 'A' THEN 'n_methylation' ELSE 'd_amino_acid' END
                 WHEN 5 THEN CASE rf WHEN 'A' THEN 'disulfide_bridge'
                                     ELSE 'head_to_tail_cyclization' END
                 WHEN 6 THEN CASE rf WHEN 'A' THEN 'd_amino_acid' ELSE 'non_standard_aa' END
                 ELSE 'lipidation' END AS type,
         CASE WHEN ln = 7 THEN 'global' WHEN ln = 6 AND ls = 'F' THEN 'inferred'
              WHEN ln = 4 AND ls = 'F' AND rf = 'R' THEN 'ambiguous' ELSE 'explicit' END AS kind,
         CASE ln WHEN 1 THEN [0] WHEN 2 THEN [n - 1] WHEN 5 THEN [0, n - 1]
                 WHEN 7 THEN CAST([] AS INTEGER[]) ELSE [p] END AS pos,
         rf AS raw,
         CASE WHEN ln = 5 AND ls = 'O' THEN n END AS ring_size
  FROM lines)
"""

# Per-sample keys in SQL: scaffold, profile, anchor status.
KEYS = """
ring AS (
  SELECT id, string_agg(CAST(q AS VARCHAR), '_' ORDER BY q) AS spots
  FROM (SELECT DISTINCT id, unnest(pos) AS q FROM ann WHERE family = 'cyclization') GROUP BY id),
prof AS (
  SELECT id, string_agg(family, '+' ORDER BY family) AS profile
  FROM (SELECT DISTINCT id, family FROM ann) GROUP BY id),
kinds AS (
  SELECT id, bool_and(kind = 'explicit') AS all_explicit, bool_or(kind = 'ambiguous') AS amb,
         bool_or(kind IN ('inferred', 'global')) AS weak, count(*) AS n_edits
  FROM ann GROUP BY id),
s AS (
  SELECT o.*, coalesce(n_edits, 0) AS n_edits,
         CASE WHEN ring.id IS NULL THEN seq ELSE seq || '_cyc_' || spots END AS scaffold,
         coalesce(profile, 'no_edits') AS profile,
         CASE WHEN kinds.id IS NULL THEN 'no_edits' WHEN all_explicit THEN 'explicit_anchor'
              WHEN amb THEN 'not_resolvable' WHEN weak THEN 'weakly_inferable'
              ELSE 'not_resolvable' END AS anchor_status
  FROM o LEFT JOIN ring ON ring.id = o.id LEFT JOIN prof ON prof.id = o.id
         LEFT JOIN kinds ON kinds.id = o.id)
"""


def sequence_of(key: str):
    text = F.translate(F.md5(F.col(key).cast("string")), *DIGITS_TO_LETTERS)
    return F.substring(text, F.lit(1), (F.lit(6) + F.col(key) % 7).cast("int"))


def orders_with_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples without their annotations."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("label"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("yr"),
        sequence_of("o_custkey").alias("sequence"),
    )


def samples(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders, as given or all, with an annotation array built from their lines.

    An annotation is computed per line, before the lines of an order are gathered.
    """
    orders = orders_with_sequence(spark, sf_dir) if orders is None else orders
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    lines = lines.join(orders_with_sequence(spark, sf_dir).select("id", "sequence"), "id")
    notes = lines.select("id", _annotation(F.col("sequence")).alias("a"))
    grouped = notes.groupBy("id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    edits = F.transform("a", lambda a, i: _edit(a, i, F.col("id")))
    grouped = grouped.select("id", edits.alias("edits"))
    none = F.array().cast(grouped.schema["edits"].dataType)
    joined = orders.join(grouped, "id", "left")
    return once(joined, edits=F.coalesce("edits", none))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (id, sequence, sig), ``sig`` as from ``similarity.signature``, without building annotations."""
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id").withColumn("_line", F.lit(True))
    rows = orders_with_sequence(spark, sf_dir).select("id", "sequence").join(lines, "id", "left")
    text = F.when(F.col("_line"), similarity.signed(_annotation(F.col("sequence"))))
    return rows.groupBy("id", "sequence").agg(F.array_sort(F.collect_set(text)).alias("sig"))


def edit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different annotation types of each order with lines. A line's type does not depend on the sequence."""
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    return lines.groupBy("id").agg(F.collect_set(_annotation(F.lit("A"))["edit_type"]).alias("types"))


def _annotation(seq):
    """One line as an annotation; the first four fields give the order within a sample."""
    ln, rf, ls = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    n = F.length(seq)
    p = (F.col("l_partkey") % n).cast("int")
    families = {
        1: "n_terminal",
        2: "c_terminal",
        3: "sidechain",
        4: "backbone",
        5: "cyclization",
        6: "substitution",
    }
    kind = (
        F.when(ln == 7, "global")
        .when((ln == 6) & (ls == "F"), "inferred")
        .when((ln == 4) & (ls == "F") & (rf == "R"), "ambiguous")
        .otherwise("explicit")
    )
    edit_type = (
        F.when(ln == 1, F.when(rf == "A", "acetylation").otherwise("n_acetylation"))
        .when(ln == 2, "amidation")
        .when(
            ln == 3,
            F.when(rf == "A", "acetylation").when(rf == "N", "phosphorylation").otherwise("amidation"),
        )
        .when(ln == 4, F.when(rf == "A", "n_methylation").otherwise("d_amino_acid"))
        .when(ln == 5, F.when(rf == "A", "disulfide_bridge").otherwise("head_to_tail_cyclization"))
        .when(ln == 6, F.when(rf == "A", "d_amino_acid").otherwise("non_standard_aa"))
        .otherwise("lipidation")
    )
    positions = (
        F.when(ln == 1, F.array(F.lit(0)))
        .when(ln == 2, F.array(n - 1))
        .when(ln == 5, F.array(F.lit(0), n - 1))
        .when(ln == 7, F.array().cast("array<int>"))
        .otherwise(F.array(p))
    )
    letter = lambda q: F.substring(seq, q + 1, F.lit(1))
    residues = (
        F.when(ln == 1, F.array(letter(F.lit(0))))
        .when(ln == 2, F.array(letter(n - 1)))
        .when(ln == 5, F.array(letter(F.lit(0)), letter(n - 1)))
        .when(ln == 7, F.array().cast("array<string>"))
        .otherwise(F.array(letter(p)))
    )
    return F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        _case(ln, families, "other").alias("edit_family"),
        edit_type.alias("edit_type"),
        kind.alias("anchor_kind"),
        positions.alias("anchor_positions"),
        residues.alias("anchor_residues"),
        rf.alias("chem_rep_raw"),
        F.when((ln == 5) & (ls == "O"), n).alias("ring_size"),
    )


def _edit(a, i, sample):
    return F.struct(
        F.concat(F.lit("ORDER_"), sample.cast("string"), F.lit("_edit_"), i.cast("string")).alias("edit_id"),
        *[
            a[k].alias(k)
            for k in ("edit_family", "edit_type", "anchor_kind", "anchor_positions", "anchor_residues", "chem_rep_raw")
        ],
        F.concat(a["edit_type"], F.lit("/"), a["chem_rep_raw"]).alias("chem_rep_canonical"),
        F.concat(a["edit_family"], F.lit("_"), a["chem_rep_raw"]).alias("attachment_semantics"),
        F.lit("success").alias("parser_status"),
        F.lit("line_v1").alias("rule_id"),
        F.when(
            a["ring_size"].isNotNull(), F.create_map(F.lit("ring_size"), a["ring_size"].cast("string"))
        )
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("edit_metadata"),
    )


def _case(col, pairs, default):
    items = list(pairs.items())
    out = F.when(col == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(col == k, v)
    return out.otherwise(default)
