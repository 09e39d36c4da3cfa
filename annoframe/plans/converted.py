"""Conversion and canonicalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.operators import canonical, convert
from annoframe.plans.base import load, query, r, rounded
from annoframe.plans.samples import PRELUDE, samples

# A raw assay table derived from part: six letter tokens with prefixes from the key's digest,
# extra tokens by part type, shape by size, a label that is sometimes missing or text.
_TOKEN = """CASE WHEN instr('0123', substr(h, 2 * {i} - 1, 1)) > 0 THEN 'me'
 WHEN instr('4567', substr(h, 2 * {i} - 1, 1)) > 0 THEN 'd' WHEN instr('89', substr(h, 2 * {i} - 1, 1)) > 0 THEN 'Me_d'
 ELSE '' END || translate(substr(h, 2 * {i}, 1), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')"""
_TOKENS = ", ".join(_TOKEN.format(i=i) for i in range(1, 7))
RAW = f"""
raw AS (
  SELECT p_partkey AS rid, p_size, p_brand, p_type,
    CASE p_size % 3 WHEN 0 THEN 'Circle' WHEN 1 THEN 'Lariat' ELSE 'Linear' END AS shape,
    CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 17 = 0 THEN 'n.d.' ELSE CAST(p_size * 1.5 AS VARCHAR) END AS lab,
    list_filter(list_concat([CASE p_type WHEN 'ECONOMY' THEN 'ac-' WHEN 'PROMO' THEN 'Sar' WHEN 'SMALL' THEN 'Mono12' END],
      CASE WHEN p_size = 7 THEN [CAST(NULL AS VARCHAR)] ELSE [{_TOKENS}] END,
      [CASE p_type WHEN 'LARGE' THEN '-pip' WHEN 'MEDIUM' THEN 'Nle' WHEN 'STANDARD' THEN CASE WHEN p_size % 4 = 0
       THEN 'Zzz' END END]), lambda x: x IS NOT NULL) AS tokens
  FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part)),
tok AS (
  SELECT rid, i - 1 AS idx, tokens[i] AS t,
    tokens[i] LIKE 'ac-%' OR tokens[i] LIKE '-%' OR tokens[i] LIKE '%-' OR tokens[i] LIKE 'Mono%' AS skip,
    CASE WHEN tokens[i] = 'Sar' THEN 'G' WHEN tokens[i] = 'Nle' THEN 'L'
         WHEN regexp_matches(tokens[i], '^(me|d|Me_d)?[{C.LETTERS}]$') THEN right(tokens[i], 1) END AS letter
  FROM (SELECT rid, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM raw)),
placed AS (
  SELECT *, CASE WHEN NOT skip AND letter IS NOT NULL THEN
    sum(CASE WHEN NOT skip AND letter IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY idx) - 1 END AS pos
  FROM tok),
seqs AS (
  SELECT rid, string_agg(CASE WHEN NOT skip THEN letter END, '' ORDER BY idx) AS s,
    bool_or(NOT skip AND letter IS NULL) AS unknown FROM placed GROUP BY rid),
good_seq AS (SELECT rid, CASE WHEN NOT unknown AND length(s) >= 3 THEN s END AS s FROM seqs),
notes AS (
  SELECT rid, idx, 0 AS sub, 'n_acetylation@0' AS t FROM placed WHERE t = 'ac-' AND idx = 0
  UNION ALL SELECT p.rid, idx, 0, 'c_terminal_modification@' || (length(s) - 1) FROM placed p JOIN good_seq g USING (rid)
    WHERE p.t LIKE '-%'
  UNION ALL SELECT rid, idx, 0, 'd_amino_acid@' || CAST(pos AS BIGINT) FROM placed
    WHERE regexp_matches(t, '^(Me_)?d[{C.LETTERS}]$')
  UNION ALL SELECT rid, idx, 1, 'n_methylation@' || CAST(pos AS BIGINT) FROM placed
    WHERE regexp_matches(t, '^(me|Me_d)[{C.LETTERS}]$')
  UNION ALL SELECT rid, idx, 0, 'non_standard_aa@' || CAST(pos AS BIGINT) FROM placed WHERE t IN ('Sar', 'Nle')
  UNION ALL SELECT rid, 999, 0, 'head_to_tail_cyclization@0,' || (length(s) - 1) FROM raw JOIN good_seq USING (rid)
    WHERE shape = 'Circle'
  UNION ALL SELECT rid, 999, 0, 'lariat_cyclization@' FROM raw WHERE shape = 'Lariat'),
note_text AS (SELECT rid, string_agg(t, ';' ORDER BY idx, sub) AS notes FROM notes GROUP BY rid),
conv AS (
  SELECT raw.rid, 'PART_ASSAY_' || format('{{:06d}}', raw.rid) AS sample_id, s, TRY_CAST(lab AS DOUBLE) AS label,
    coalesce(notes, '') AS notes, shape, p_type, p_brand,
    CASE WHEN s IS NULL THEN 'Failed to parse sequence' WHEN lab IS NULL THEN 'Label is missing or null'
         WHEN TRY_CAST(lab AS DOUBLE) IS NULL THEN 'Cannot convert label to number: ' || lab END AS error
  FROM raw LEFT JOIN good_seq USING (rid) LEFT JOIN note_text ON note_text.rid = raw.rid)
"""


def raw_assay(spark, sf):
    h = F.md5(F.col("p_partkey").cast("string"))

    def token(i: int):
        c1, c2 = F.substring(h, 2 * i - 1, 1), F.substring(h, 2 * i, 1)
        prefix = (
            F.when(c1.isin(*"0123"), "me").when(c1.isin(*"4567"), "d").when(c1.isin(*"89"), "Me_d").otherwise("")
        )
        return F.concat(prefix, F.translate(c2, "0123456789abcdef", "ACDEFGHIKLMNPQRS"))

    kind, size = F.col("p_type"), F.col("p_size")
    head = F.when(kind == "ECONOMY", "ac-").when(kind == "PROMO", "Sar").when(kind == "SMALL", "Mono12")
    tail = (
        F.when(kind == "LARGE", "-pip")
        .when(kind == "MEDIUM", "Nle")
        .when((kind == "STANDARD") & (size % 4 == 0), "Zzz")
    )
    middle = [F.when(size != 7, token(i)) for i in range(1, 7)]
    tokens = F.array_compact(F.array(head, *middle, tail))
    text = F.concat(
        F.lit("["), F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")
    )
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("ID"),
        text.alias("Sequence"),
        F.when(size % 3 == 0, "Circle").when(size % 3 == 1, "Lariat").otherwise("Linear").alias("Molecule_Shape"),
        F.when(size % 10 == 0, None)
        .when(size % 17 == 0, "n.d.")
        .otherwise((size * F.lit(1.5)).cast("string"))
        .alias("Assay"),
        F.col("p_type").alias("Source"),
        F.col("p_brand").alias("Brand"),
    )


def converted(spark, sf):
    return convert.convert(
        raw_assay(spark, sf),
        "part assay",
        "ID",
        "Sequence",
        "Assay",
        shape="Molecule_Shape",
        metadata={"source_publication": "Source", "molecule_shape": "Molecule_Shape"},
    )


def _notes(edits):
    one = lambda e: F.concat(
        e["edit_type"],
        F.lit("@"),
        F.array_join(F.transform(e["anchor_positions"], lambda p: p.cast("string")), ","),
    )
    return F.array_join(F.transform(edits, one), ";")


@query(
    "converted_samples",
    f"""WITH {RAW} SELECT sample_id, s AS sequence, {r("label", "label")}, notes,
    CASE WHEN notes = '' THEN 'no_edits' WHEN shape = 'Lariat' THEN 'weakly_inferable' ELSE 'explicit_anchor' END
      AS anchor_status, p_type AS source, shape FROM conv WHERE error IS NULL""",
)
def converted_samples(spark, sf):
    """Samples from raw token lists, with annotations (CV1-CV10)."""
    good = convert.good(converted(spark, sf))
    return rounded(
        good.select(
            "sample_id",
            "sequence",
            "label",
            _notes(F.col("edits")).alias("notes"),
            "anchor_status",
            F.col("assay_metadata.source_publication").alias("source"),
            F.col("assay_metadata.molecule_shape").alias("shape"),
        )
    )


@query(
    "conversion_errors",
    f"""WITH {RAW} SELECT sample_id, rid AS row_index, 'ValueError' AS error_type, error FROM conv
    WHERE error IS NOT NULL""",
)
def conversion_errors(spark, sf):
    """Rows that failed to convert, with the reason (CV5, CV10)."""
    return convert.bad(converted(spark, sf))


@query(
    "conversion_report",
    f"""WITH {RAW} SELECT count(*) AS total_rows, count_if(error IS NULL) AS successful,
    count_if(error IS NOT NULL) AS failed, {r("count_if(error IS NULL) * 1.0 / greatest(count(*), 1)", "success_rate")}
    FROM conv""",
)
def conversion_report(spark, sf):
    """Conversion counts and success rate (CV11)."""
    return rounded(convert.report(converted(spark, sf)))


@query(
    "conversion_error_counts",
    f"""WITH {RAW} SELECT 'ValueError' AS error_type, error, count(*) AS n FROM conv WHERE error IS NOT NULL
    GROUP BY error""",
)
def conversion_error_counts(spark, sf):
    """Rows per conversion error (CV11)."""
    return convert.error_report(converted(spark, sf))


@query(
    "provenance_fields",
    f"""WITH {RAW} SELECT sample_id, 'part' AS source_file, rid AS row_index,
    CASE WHEN rid = 0 THEN NULL ELSE CAST(rid AS VARCHAR) END AS raw_id, shape AS raw_shape,
    lab AS raw_label FROM conv JOIN raw USING (rid)""".replace("SELECT sample_id, 'part'", "SELECT conv.sample_id, 'part'").replace(
        "shape AS raw_shape", "raw.shape AS raw_shape"
    ),
)
def provenance_fields(spark, sf):
    """Provenance of every raw row (CV7, CV9)."""
    raw = raw_assay(spark, sf)
    prov = convert.provenance(F.lit("part"), F.col("ID"), raw.columns)
    sid = convert.sample_id("part assay", F.col("ID"))
    rows = raw.select(sid.alias("sample_id"), prov.alias("p"))
    return rows.select(
        "sample_id",
        "p.source_file",
        F.col("p.source_row_index").alias("row_index"),
        F.col("p.raw_data_sample.ID").alias("raw_id"),
        F.col("p.raw_data_sample.Molecule_Shape").alias("raw_shape"),
        F.col("p.raw_data_sample.Assay").alias("raw_label"),
    )


@query(
    "samples_with_raw_rows",
    f"""WITH {RAW} SELECT conv.sample_id, p_brand AS brand, length(s) AS n_letters FROM conv WHERE error IS NULL""",
)
def samples_with_raw_rows(spark, sf):
    """Samples joined back to their raw rows by id (JN1)."""
    good = convert.good(converted(spark, sf)).select(
        "sample_id", "sequence", F.col("provenance.source_row_index").alias("ID")
    )
    joined = good.join(raw_assay(spark, sf).select("ID", "Brand"), "ID")
    return joined.select("sample_id", F.col("Brand").alias("brand"), F.length("sequence").alias("n_letters"))


def _ctx(p: str) -> str:
    start = f"greatest(0, {p} - 3)"
    return (
        f"'[' || lpad(substr(seq, CAST({start} + 1 AS INTEGER), CAST({p} - {start} AS INTEGER)), 3, '-') || '-' || "
        f"substr(seq, CAST({p} + 1 AS INTEGER), 1) || '-' || rpad(substr(seq, CAST({p} + 2 AS INTEGER), 3), 3, '-') || ']'"
    )


_MIRROR = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MIRRORED_STRUCTURES.items())


@query(
    "canonical_annotations",
    f"""WITH {PRELUDE},
    x AS (SELECT id, idx, seq, pos, CASE
        WHEN family = 'substitution' AND type = 'd_amino_acid' THEN '{canonical.MIRRORED}'
        WHEN family = 'cyclization' AND type = 'disulfide_bridge' AND len(pos) = 2 THEN '{canonical.BRIDGE}'
        WHEN type = 'acetylation' AND family IN ('sidechain', 'n_terminal') THEN '{canonical.ACETYL}'
        WHEN family = 'sidechain' AND type = 'phosphorylation' THEN '{canonical.PHOSPHATE}' END AS rule_id,
        family, pos[1] AS p, pos[2] AS q, substr(seq, pos[1] + 1, 1) AS res, substr(seq, pos[2] + 1, 1) AS res2 FROM ann),
    y AS (SELECT *, CASE rule_id WHEN '{canonical.MIRRORED}' THEN 'CA' WHEN '{canonical.BRIDGE}' THEN 'SG'
        WHEN '{canonical.ACETYL}' THEN CASE WHEN family = 'n_terminal' AND p = 0 THEN 'N' WHEN res = 'K' THEN 'NZ' END
        WHEN '{canonical.PHOSPHATE}' THEN CASE res WHEN 'S' THEN 'OG' WHEN 'T' THEN 'OG1' WHEN 'Y' THEN 'OH' END END AS atom
      FROM x),
    z AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'No matching canonicalization rule'
        WHEN rule_id = '{canonical.BRIDGE}' AND (res <> 'C' OR res2 <> 'C')
          THEN 'Both positions must be Cys, got ' || res || ', ' || res2
        WHEN rule_id = '{canonical.ACETYL}' AND atom IS NULL
          THEN 'Acetylation not supported for ' || res || ' at position ' || p
        WHEN rule_id = '{canonical.PHOSPHATE}' AND atom IS NULL THEN 'Phosphorylation not supported for ' || res
        WHEN rule_id = '{canonical.ACETYL}' AND atom = 'N' THEN 'Invalid attachment: ' || res || '.N' END AS canonical_error
      FROM y)
    SELECT id, idx, rule_id, canonical_error,
      CASE WHEN rule_id IS NULL THEN 'unsupported_modification'
           WHEN canonical_error IS NOT NULL THEN 'Failed with ' || rule_id || ': ' || canonical_error
           ELSE 'Parsed with ' || rule_id END AS canonical_note,
      CASE WHEN canonical_error IS NULL THEN
        CASE rule_id WHEN '{canonical.MIRRORED}' THEN 'd' || res WHEN '{canonical.BRIDGE}' THEN 'disulfide'
             WHEN '{canonical.ACETYL}' THEN 'Ac' ELSE 'PO3' END || '@' || res || p || '.' || atom || '.single' ||
        CASE WHEN rule_id = '{canonical.BRIDGE}' THEN '-C' || q || '.SG.single' ELSE '' END || ':' || {_ctx("p")} ||
        CASE WHEN rule_id = '{canonical.BRIDGE}' THEN '~' || {_ctx("q")} ELSE '' END END AS tagged,
      CASE WHEN canonical_error IS NULL THEN CASE rule_id WHEN '{canonical.MIRRORED}' THEN CASE res {_MIRROR} END
        WHEN '{canonical.BRIDGE}' THEN 'S-S' WHEN '{canonical.ACETYL}' THEN 'CC(=O)' ELSE 'OP(=O)(O)O' END END
        AS moiety_structure FROM z""",
)
def canonical_annotations(spark, sf):
    """Rule-table canonicalisation with tagged strings (SC3, SC4)."""
    df = samples(spark, sf).select("id", "sequence", F.posexplode("edits").alias("idx", "e"))
    out = canonical.canonicalise(df, "sequence", "e")
    return out.select("id", "idx", "rule_id", "canonical_error", "canonical_note", "tagged", "moiety_structure")
