"""Audit and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions import sequences as S
from annoframe.operators import audit, validate
from annoframe.plans.base import load, query, r, rounded
from annoframe.plans.samples import KEYS, PRELUDE, samples
from annoframe.session import shared_folder
from annoframe.sources import tables

# Letters whose capitals are several letters with one of the alphabet among them (ß is SS); SQL's upper leaves them alone.
_WIDE = "ßŉẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
_MARKERS = " OR ".join(f"contains(lower(mod), '{m}')" for m in C.AMBIGUOUS_MARKERS)
AUDIT = f"""
raw AS (
  SELECT d.doc_id, d.text, d.lang, d.source, n_chars,
    CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 11 = 0 THEN 'Unknown site' WHEN n_chars % 13 = 0 THEN ''
         WHEN n_chars % 5 = 0 THEN 'position ?' ELSE source END AS mod,
    CASE WHEN source = 'src7' THEN 'n/a' ELSE CAST(quality AS VARCHAR) END AS lab,
    CASE n_chars % 4 WHEN 1 THEN 'weakly_inferable' WHEN 2 THEN 'not_resolvable' ELSE 'explicit_anchor' END AS status,
    n_chars % 3 AS n_edits
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
flags AS (
  SELECT *, text IS NULL OR text = '' AS no_seq,
    NOT (text IS NULL OR text = '') AND NOT regexp_matches(upper(trim(text)), '[{C.LETTERS}]') AND NOT regexp_matches(text, '[{_WIDE}]') AS bad_seq,
    mod IS NULL OR mod = '' AS no_mod, NOT (mod IS NULL OR mod = '') AND ({_MARKERS}) AS bad_mod,
    lab IS NULL AS no_lab, lab IS NOT NULL AND TRY_CAST(lab AS DOUBLE) IS NULL AS text_lab,
    row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM raw),
marked AS (
  SELECT *, CASE WHEN NOT no_seq AND NOT bad_seq AND NOT no_mod AND NOT bad_mod THEN status ELSE 'unknown' END AS res
  FROM flags),
rows_ AS (
  SELECT *, list_filter([CASE WHEN no_seq THEN 'missing_sequence' END, CASE WHEN bad_seq THEN 'unparseable_sequence' END,
      CASE WHEN no_mod THEN 'missing_modification' END, CASE WHEN bad_mod THEN 'ambiguous_modification' END,
      CASE WHEN no_lab THEN 'missing_label' END, CASE WHEN text_lab THEN 'non_numeric_label' END,
      CASE WHEN res = 'not_resolvable' THEN 'no_anchor_resolvable' END,
      CASE WHEN res = 'weakly_inferable' THEN 'weak_anchor_only' END], lambda x: x IS NOT NULL) AS reasons FROM marked)
"""

_METRICS = """
  count(*) AS raw_sample_count, count_if(NOT no_seq AND NOT bad_seq) AS parseable_sample_count,
  count_if(no_seq OR bad_seq) AS unparseable_samples, count_if(NOT no_seq AND NOT bad_seq) AS sequence_available_count,
  count_if(no_seq OR bad_seq) AS missing_sequence_count,
  count_if(NOT no_mod AND NOT bad_mod) AS modification_available_count, count_if(no_mod) AS no_modification_count,
  count_if(bad_mod) AS ambiguous_modification_count, count_if(res = 'explicit_anchor') AS explicit_anchor_count,
  count_if(res = 'weakly_inferable') AS weakly_inferable_anchor_count,
  count_if(res = 'not_resolvable') AS not_resolvable_anchor_count,
  count_if(NOT no_lab AND NOT text_lab) AS continuous_label_count, count_if(no_lab) AS missing_label_count,
  count_if(text_lab) AS non_numeric_label_count, count_if(dup) AS duplicate_count,
  count_if(n_edits = 1) AS single_edit_count, count_if(n_edits > 1) AS multi_edit_count,
  count_if(len(reasons) = 0) AS usable_total,
  count_if(len(reasons) = 0 AND res = 'explicit_anchor') AS usable_with_explicit_anchor,
  count_if(len(reasons) = 0 AND res = 'weakly_inferable') AS usable_with_weak_anchor"""


def audited(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    mod = (
        F.when(n % 7 == 0, F.lit(None).cast("string"))
        .when(n % 11 == 0, "Unknown site")
        .when(n % 13 == 0, "")
        .when(n % 5 == 0, "position ?")
        .otherwise(F.col("source"))
    )
    lab = F.when(F.col("source") == "src7", "n/a").otherwise(F.col("quality").cast("string"))
    status = (
        F.when(n % 4 == 1, "weakly_inferable").when(n % 4 == 2, "not_resolvable").otherwise("explicit_anchor")
    )
    raw = docs.select(
        "doc_id",
        "text",
        "lang",
        "source",
        mod.alias("mod"),
        lab.alias("lab"),
        status.alias("status"),
        F.array_repeat(F.lit(1), (n % 3).cast("int")).alias("edits"),
    )
    return audit.flag_rows(
        raw,
        "doc_id",
        "text",
        "lab",
        modification="mod",
        assay="lang",
        anchor_status="status",
        edits="edits",
        duplicate_on=["text"],
    )


@query(
    "audit_rows",
    f"""WITH {AUDIT} SELECT doc_id, NOT no_seq AND NOT bad_seq AS has_sequence, NOT no_mod AND NOT bad_mod
    AS has_modification, NOT no_lab AND NOT text_lab AS has_label, res AS anchor_resolvability, dup AS is_duplicate,
    coalesce(n_edits = 1, FALSE) AS is_single_edit, array_to_string(reasons, ';') AS reasons FROM rows_""",
)
def audit_rows(spark, sf):
    """Flags and exclusion reasons of every document (AU1-AU5, AU13)."""
    return audited(spark, sf).select(
        "doc_id",
        "has_sequence",
        "has_modification",
        "has_label",
        "anchor_resolvability",
        "is_duplicate",
        "is_single_edit",
        F.array_join("exclusion_reasons", ";").alias("reasons"),
    )


@query(
    "audit_export",
    f"""WITH {AUDIT} SELECT doc_id, array_to_string(reasons, ';') AS exclusion_reasons FROM rows_ WHERE len(reasons) > 0""",
)
def audit_export(spark, sf):
    """Excluded documents written as CSV with their reasons, and read back (AU13)."""
    path = f"{shared_folder(spark).rstrip('/')}/annoframe-{uuid.uuid4().hex}"
    audit.export(audited(spark, sf).select("doc_id", "is_excluded", "exclusion_reasons"), path)
    return tables.read_raw_csv(spark, path, "doc_id bigint, is_excluded boolean, exclusion_reasons string").select("doc_id", "exclusion_reasons")


@query("audit_metrics", f"WITH {AUDIT} SELECT {_METRICS} FROM rows_")
def audit_metrics(spark, sf):
    """Census metrics over the audited rows (AU6)."""
    return audit.metrics(audited(spark, sf))


@query(
    "audit_exclusions",
    f"""WITH {AUDIT} SELECT lang, reason, count(*) AS n
    FROM (SELECT lang, unnest(reasons) AS reason FROM rows_) GROUP BY lang, reason""",
)
def audit_exclusions(spark, sf):
    """Exclusion reasons per language (AU7)."""
    return audit.exclusions(audited(spark, sf), ["lang"])


@query(
    "audit_assays",
    f"""SELECT lang AS assay_type, count(*) AS n,
    {r("100.0 * count(*) / (SELECT count(*) FROM documents)", "pct_of_raw")} FROM documents
    WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang""",
)
def audit_assays(spark, sf):
    """Assay type distribution (AU8)."""
    return rounded(audit.assay_distribution(audited(spark, sf)))


def _stages(pairs, base: str, pct: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS step, '{s}' AS stage, {c} AS n, {r(f'100.0 * {c} / greatest({base}, 1)', pct)} FROM m"
        for i, (s, c) in enumerate(pairs, 1)
    )


@query(
    "audit_funnel",
    f"WITH {AUDIT}, m AS (SELECT {_METRICS} FROM rows_) {_stages(audit.FUNNEL, 'raw_sample_count', 'pct_of_raw')}",
)
def audit_funnel(spark, sf):
    """Progressive filter stages (AU9)."""
    return rounded(audit.funnel(audit.metrics(audited(spark, sf))))


_RESOLVED = (
    ("Explicit Anchor", "explicit_anchor_count"),
    ("Weakly Inferable", "weakly_inferable_anchor_count"),
    ("Not Resolvable", "not_resolvable_anchor_count"),
)


@query(
    "audit_resolvability",
    f"""WITH {AUDIT}, m AS (SELECT {_METRICS} FROM rows_)
    {_stages(_RESOLVED, 'modification_available_count', 'pct_of_modified')}""",
)
def audit_resolvability(spark, sf):
    """Anchor classes as a share of annotated rows (AU10)."""
    return rounded(audit.resolvability(audit.metrics(audited(spark, sf))))


@query(
    "audit_feasibility",
    f"""WITH {AUDIT}, m AS (SELECT {_METRICS} FROM rows_)
    SELECT usable_total, CASE WHEN usable_total < 100 THEN 'INSUFFICIENT' WHEN usable_total < 300 THEN 'MARGINAL'
           ELSE 'SUFFICIENT' END AS feasibility,
           {r("single_edit_count * 1.0 / greatest(usable_total, 1)", "single_edit_ratio")},
           single_edit_count > 0 AND single_edit_count * 1.0 / greatest(usable_total, 1) < 0.1
             AS low_single_edit_warning FROM m""",
)
def audit_feasibility(spark, sf):
    """Split feasibility class (AU11)."""
    return rounded(audit.feasibility(audit.metrics(audited(spark, sf))))


_SUMS = (
    "raw_sample_count parseable_sample_count usable_total explicit_anchor_count weakly_inferable_anchor_count "
    "not_resolvable_anchor_count modification_available_count missing_sequence_count ambiguous_modification_count "
    "missing_label_count duplicate_count"
).split()


@query(
    "audit_combined",
    f"""WITH {AUDIT}, m AS (SELECT source, {_METRICS} FROM rows_ GROUP BY source),
    g AS (SELECT source AS dataset, FALSE AS total, {", ".join(_SUMS)} FROM m
          UNION ALL SELECT 'TOTAL', TRUE, {", ".join(f"CAST(sum({c}) AS BIGINT)" for c in _SUMS)} FROM m)
    SELECT dataset, {", ".join(_SUMS)}, {r("100.0 * usable_total / greatest(raw_sample_count, 1)", "usable_pct")},
      CASE WHEN total THEN NULL WHEN usable_total >= 100 THEN 'viable' WHEN usable_total >= 50 THEN 'marginal'
           ELSE 'insufficient' END AS viability FROM g""",
)
def audit_combined(spark, sf):
    """Per-source summary with a total row (AU12)."""
    return rounded(audit.combined(audited(spark, sf), "source"))


@query(
    "audit_examples",
    f"""WITH {AUDIT}, x AS (SELECT unnest(reasons) AS reason, doc_id FROM rows_)
    SELECT * FROM (SELECT reason, CAST(row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS INTEGER) AS rank,
      doc_id, count(*) OVER (PARTITION BY reason) AS n_rows FROM x) WHERE rank <= 10""",
)
def audit_examples(spark, sf):
    """First ten rows of each exclusion reason (AU14)."""
    return audit.examples(audited(spark, sf), "doc_id")


# --- validation ----------------------------------------------------------------------------


def sample_records(spark, sf):
    """Order samples as full records, with some rows broken on purpose."""
    df = samples(spark, sf).withColumn("status_key", S.anchor_status(F.col("edits")))
    moved = F.transform(
        "edits",
        lambda e: e.withField("anchor_positions", F.transform(e["anchor_positions"], lambda p: p + 1)),
    )
    cut = F.when(F.col("cust") % 89 == 0, F.lit(2)).otherwise(F.length("sequence"))
    return df.select(
        "id",
        F.when(F.col("id") % 101 == 0, F.concat(F.lit("order-"), F.col("id")))
        .otherwise(F.concat(F.lit("ORDER_"), F.col("id")))
        .alias("sample_id"),
        F.lit("orders").alias("dataset"),
        F.lower(F.substring("sequence", F.lit(1), cut)).alias("sequence"),
        F.when(F.col("cust") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("label")).alias("label"),
        F.lit("price").alias("label_type"),
        F.when(F.col("id") % 103 != 0, "usd").alias("label_unit"),
        F.lit("sale").alias("assay_type"),
        F.create_map(F.lit("priority"), F.col("priority")).alias("assay_metadata"),
        F.when(F.col("status") == "F", moved).otherwise(F.col("edits")).alias("edits"),
        F.when(F.col("priority") == "5-LOW", "explicit_anchor")
        .otherwise(F.col("status_key"))
        .alias("anchor_status"),
        F.struct(
            F.lit("orders").alias("source_file"),
            F.col("id").alias("source_row_index"),
            F.when(F.col("id") % 107 != 0, "1").alias("parser_version"),
        ).alias("provenance"),
        "priority",
    )


ERRORS = f"""
{PRELUDE}, {KEYS},
rec AS (
  SELECT s.id, s.priority, s.status, CASE WHEN s.id % 101 = 0 THEN 'order-' ELSE 'ORDER_' END || s.id AS sid,
    CASE WHEN cust % 89 = 0 THEN substr(seq, 1, 2) ELSE seq END AS seq2, cust % 97 = 0 AS nan_label,
    CASE WHEN s.priority = '5-LOW' THEN 'explicit_anchor' ELSE anchor_status END AS status2, n_edits
  FROM s),
e AS (
  SELECT ann.id, kind, rec.seq2, ann.seq AS full_seq, pos,
    CASE WHEN rec.status = 'F' THEN list_transform(pos, lambda x: x + 1) ELSE pos END AS pos2
  FROM ann JOIN rec ON rec.id = ann.id),
e2 AS (
  SELECT id, kind, len(list_filter(pos2, lambda x: x < 0 OR x >= length(seq2))) > 0 AS outside,
    pos2 <> list_sort(list_distinct(pos2)) AS unsorted,
    len(list_filter(range(len(pos2)), lambda i: substr(seq2, CAST(pos2[i + 1] + 1 AS INTEGER), 1)
        <> substr(full_seq, CAST(pos[i + 1] + 1 AS INTEGER), 1))) > 0 AS mismatch FROM e),
ea AS (
  SELECT id, bool_or(outside) AS outside, bool_or(unsorted) AS unsorted, bool_or(mismatch) AS mismatch,
    bool_and(kind = 'explicit') AS all_explicit, bool_or(kind IN ('inferred', 'ambiguous')) AS loose
  FROM e2 GROUP BY id),
checked AS (
  SELECT rec.id, rec.priority, array_to_string(list_filter([
    CASE WHEN NOT regexp_matches(sid, '^[A-Z_]+_[0-9]+$') THEN 'sample_id_format' END,
    CASE WHEN length(seq2) < 3 OR length(seq2) > 100 THEN 'sequence_length' END,
    CASE WHEN NOT regexp_matches(seq2, '^[{C.LETTERS}]+$') THEN 'sequence_alphabet' END,
    CASE WHEN nan_label THEN 'label_finite' END,
    CASE WHEN rec.id % 103 = 0 THEN 'label_unit_present' END,
    CASE WHEN rec.id % 107 = 0 THEN 'provenance_keys' END,
    CASE WHEN coalesce(unsorted, FALSE) THEN 'positions_sorted_unique' END,
    CASE WHEN coalesce(outside, FALSE) THEN 'positions_inside_sequence' END,
    CASE WHEN coalesce(mismatch, FALSE) THEN 'residues_match_sequence' END,
    CASE WHEN NOT CASE WHEN n_edits = 0 THEN status2 = 'no_edits' WHEN all_explicit THEN status2 = 'explicit_anchor'
              WHEN loose THEN status2 IN ('weakly_inferable', 'not_resolvable') ELSE TRUE END
         THEN 'anchor_status_consistent' END], lambda x: x IS NOT NULL), ';') AS errors
  FROM rec LEFT JOIN ea ON ea.id = rec.id)
"""


@query("validation_errors", f"WITH {ERRORS} SELECT id, errors FROM checked")
def validation_errors(spark, sf):
    """Broken rules of every sample record (VA1-VA11)."""
    checked = validate.with_errors(sample_records(spark, sf), validate.sample_rules())
    return checked.select("id", F.array_join("errors", ";").alias("errors"))


@query(
    "validation_report",
    f"""WITH {ERRORS} SELECT priority, count(*) AS total_samples, count_if(errors = '') AS valid_samples,
    count_if(errors <> '') AS invalid_samples FROM checked GROUP BY priority""",
)
def validation_report(spark, sf):
    """Valid and invalid rows per priority (VA12)."""
    checked = validate.with_errors(sample_records(spark, sf), validate.sample_rules())
    return validate.report(checked, ["priority"])


@query(
    "validation_error_counts",
    f"""WITH {ERRORS} SELECT error, count(*) AS n FROM (
    SELECT unnest(string_split(errors, ';')) AS error FROM checked WHERE errors <> '') GROUP BY error""",
)
def validation_error_counts(spark, sf):
    """Rows per broken rule (VA12)."""
    checked = validate.with_errors(sample_records(spark, sf), validate.sample_rules())
    return validate.error_counts(checked)


@query(
    "validation_legacy",
    f"""WITH x AS (SELECT p_partkey, upper(p_type) AS s, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 10 END AS p,
       p_size % 2 = 0 AS side FROM part)
    SELECT p_partkey, array_to_string(list_filter([
      CASE WHEN NOT regexp_matches(s, '^[{C.LETTERS}]*$') THEN 'sequence_alphabet' END,
      CASE WHEN p IS NOT NULL AND (p < 0 OR p >= length(s)) THEN 'position_in_range' END,
      CASE WHEN side AND p IS NULL THEN 'side_chain_has_position' END], lambda x: x IS NOT NULL), ';') AS errors FROM x""",
)
def validation_legacy(spark, sf):
    """Rules of the older record form (VA13)."""
    kind = F.when(F.col("p_size") % 2 == 0, "side_chain").otherwise("terminal")
    pos = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 10)
    df = load(spark, sf, "part").select(
        "p_partkey",
        F.upper("p_type").alias("s"),
        F.array(F.struct(pos.alias("position"), kind.alias("modification_type"))).alias("mods"),
    )
    checked = validate.with_errors(df, validate.legacy_rules("s", "mods"))
    return checked.select("p_partkey", F.array_join("errors", ";").alias("errors"))


_ATOM_ROWS = ", ".join(f"('{k}', '{a}')" for k, v in C.RESIDUE_ATOMS.items() for a in v)


@query(
    "attachment_checks",
    f"""WITH {PRELUDE}, atoms AS (SELECT * FROM (VALUES {_ATOM_ROWS}) t(res, atom)),
    x AS (SELECT id, idx, seq, pos[1] + idx % 3 AS p, CASE raw WHEN 'A' THEN 'A' ELSE substr(seq, pos[1] + 1, 1) END AS res,
          CASE idx % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'CB' WHEN 2 THEN 'SG' ELSE 'CG' END AS atom
          FROM ann WHERE len(pos) > 0),
    y AS (SELECT x.*, p >= 0 AND p < length(seq) AS in_range, atoms.res IS NOT NULL AS atom_allowed
          FROM x LEFT JOIN atoms ON atoms.res = x.res AND atoms.atom = x.atom)
    SELECT id, idx, in_range, in_range AND substr(seq, CAST(p + 1 AS INTEGER), 1) = res AS residue_match, atom_allowed,
      CASE WHEN NOT in_range THEN 'position_out_of_range'
           WHEN NOT (in_range AND substr(seq, CAST(p + 1 AS INTEGER), 1) = res) THEN 'residue_mismatch'
           WHEN NOT atom_allowed THEN 'atom_not_allowed' END AS attachment_error FROM y""",
)
def attachment_checks(spark, sf):
    """Attachment position, residue and atom checks (VA14)."""
    df = samples(spark, sf).select("id", "sequence", F.posexplode("edits").alias("idx", "e"))
    first = F.get("e.anchor_positions", F.lit(0))
    rows = df.filter(F.size("e.anchor_positions") > 0).select(
        "id",
        "idx",
        "sequence",
        (first + F.col("idx") % 3).alias("p"),
        F.when(F.col("e.chem_rep_raw") == "A", "A")
        .otherwise(F.substring("sequence", first + 1, F.lit(1)))
        .alias("res"),
        F.element_at(
            F.array(F.lit("CA"), F.lit("CB"), F.lit("SG"), F.lit("CG")), F.col("idx") % 4 + 1
        ).alias("atom"),
    )
    out = validate.attachments(rows, "sequence", "p", "res", "atom")
    return out.select("id", "idx", "in_range", "residue_match", "atom_allowed", "attachment_error")
