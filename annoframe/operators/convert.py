"""Raw rows to annotated samples, as one projection without joins or Python.

A row either becomes a whole sample or lands in the error table with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions.sequences import anchor_status, number, once
from annoframe.operators import validate

PARSER_VERSION = "1.0.0"
LETTER_TOKEN = f"^(?:me|d|Me_d)?([{C.LETTERS}])$"


def parse_token_list(text: Column) -> Column:
    """A list literal such as ``['L', 'meL', 'it\\'s']`` to an array of tokens; NULL if it is none (CV1).

    Backslashes escape quotes, themselves, and n, t and r; before other letters they stay.
    """
    t = F.trim(text)
    item = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    shape = rf"^\[\s*(?:(?:{item})\s*(?:,\s*(?:{item})\s*)*,?\s*)?\]$"
    items = F.regexp_extract_all(t, F.lit(f"({item})"), F.lit(1))
    tokens = F.transform(items, lambda i: _unescaped(F.substring(i, F.lit(2), F.length(i) - 2)))
    return F.when(t.rlike(shape), tokens)


def _unescaped(token: Column) -> Column:
    # An escaped backslash is set aside, so that it does not escape what follows.
    aside = F.lit("\ue000")
    out = F.replace(token, F.lit("\\\\"), aside)
    for code, char in (("'", "'"), ('"', '"'), ("n", "\n"), ("t", "\t"), ("r", "\r")):
        out = F.replace(out, F.lit("\\" + code), F.lit(char))
    return F.when(F.instr(token, "\\") > 0, F.replace(out, aside, F.lit("\\"))).otherwise(token)


def map_tokens(token: Column, extra: dict[str, str] | None = None) -> Column:
    """Base letter of a token, NULL when unknown (CV2): a prefix rule, then a fixed table."""
    table = {**C.TOKEN_LETTERS, **(extra or {})}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    plain = F.regexp_extract(token, LETTER_TOKEN, 1)
    return F.when(plain != "", plain).otherwise(F.try_element_at(lookup, token))


def is_skipped(token: Column) -> Column:
    """Terminal groups and placeholders have no place in the backbone (CV3)."""
    return (
        token.startswith("ac-")
        | token.startswith("-")
        | token.endswith("-")
        | token.startswith("Mono")
        | token.isin(*C.SKIPPED_TOKENS)
    )


def placed_tokens(tokens: Column, extra: dict[str, str] | None = None) -> Column:
    """Each token with its index, whether it is skipped, and its base letter."""
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            t.alias("token"),
            i.alias("index"),
            is_skipped(t).alias("skip"),
            F.when(~is_skipped(t), map_tokens(t, extra)).alias("letter"),
        ),
    )


def backbone(placed: Column, strict: bool = True) -> Column:
    """Backbone text; NULL under 3 letters or, in strict mode, with an unmapped token (CV3)."""
    letters = F.array_compact(F.transform(placed, lambda p: p["letter"]))
    text = F.when(F.size(letters) >= C.MIN_LENGTH, F.array_join(letters, ""))
    if not strict:
        return text
    unknown = F.exists(placed, lambda p: ~p["skip"] & p["letter"].isNull())
    return F.when(~unknown, text)


_EDIT_FIELDS = (
    ("edit_family", "string"),
    ("edit_type", "string"),
    ("anchor_kind", "string"),
    ("anchor_positions", "array<int>"),
    ("anchor_residues", "array<string>"),
    ("chem_rep_raw", "string"),
    ("chem_rep_canonical", "string"),
    ("attachment_semantics", "string"),
    ("parser_status", "string"),
    ("rule_id", "string"),
    ("edit_metadata", "map<string,string>"),
)


def _entries(values: dict[str, Column | str]) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def _edit(
    family: str,
    kind: str,
    positions: Column,
    residues: Column,
    raw: Column,
    canonical: Column,
    semantics: str,
    rule: str,
    meta: dict[str, Column | str],
    edit_type: str,
    status: str = "success",
) -> Column:
    values = {
        "edit_family": F.lit(family),
        "edit_type": F.lit(edit_type),
        "anchor_kind": F.lit(kind),
        "anchor_positions": positions,
        "anchor_residues": residues,
        "chem_rep_raw": raw,
        "chem_rep_canonical": canonical,
        "attachment_semantics": F.lit(semantics),
        "parser_status": F.lit(status),
        "rule_id": F.lit(rule),
        "edit_metadata": _entries(meta),
    }
    return F.struct(*[values[name].cast(ddl).alias(name) for name, ddl in _EDIT_FIELDS])


def annotate(
    placed: Column,
    sequence: Column,
    shape: Column,
    sample_id: Column,
    rules: Mapping[str, str] = C.RULE_IDS,
) -> Column:
    """Annotations of a sample from its placed tokens and shape (CV4); ``rules`` names them.

    A token can give none, one or two annotations; the arrays are flattened in token order, the
    ring closure comes last, and ids count upwards within the sample.
    """
    first = F.substring(sequence, 1, 1)
    last_at = F.length(sequence) - 1
    last = F.substring(sequence, -1, 1)
    none = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in _EDIT_FIELDS) + ">>")
    before = lambda i: F.size(
        F.filter(F.slice(placed, F.lit(1), i), lambda q: q["letter"].isNotNull())
    )

    def at(p: Column) -> Column:
        return F.array(before(p["index"]).cast("int"))

    def mirrored(p: Column) -> Column:
        return _edit(
            "backbone", "explicit", at(p), F.array(p["letter"]), p["token"],
            F.concat(F.lit("D-"), p["letter"]), "backbone_stereochemistry",
            rules["mirrored"], {"stereochemistry": "D"}, "d_amino_acid",
        )

    def methylated(p: Column) -> Column:
        return _edit(
            "backbone", "explicit", at(p), F.array(p["letter"]), p["token"],
            F.concat(F.lit("N-Me-"), p["letter"]), "backbone_nitrogen",
            rules["methylated"], {}, "n_methylation",
        )

    def replaced(p: Column) -> Column:
        return _edit(
            "substitution", "explicit", at(p), F.array(p["letter"]), p["token"], p["token"],
            "residue_replacement", rules["replaced"],
            {"original_monomer": p["token"], "mapped_to": p["letter"]}, "non_standard_aa",
        )

    acetyl = _edit(
        "n_terminal", "explicit", F.array(F.lit(0)), F.array(first), F.lit("ac-"), F.lit("Ac-"),
        "n_terminus", rules["acetyl"], {}, "n_acetylation",
    )

    def tail(p: Column) -> Column:
        return _edit(
            "c_terminal", "explicit", F.array(last_at), F.array(last), p["token"], p["token"],
            "c_terminus", rules["tail"], {"c_term_group": p["token"]},
            "c_terminal_modification",
        )

    def of_token(p: Column) -> Column:
        t = p["token"]
        letter = f"[{C.LETTERS}]"
        return (
            F.when((t == "ac-") & (p["index"] == 0), F.array(acetyl))
            .when(t.startswith("-"), F.array(tail(p)))
            .when(p["letter"].isNull(), none)
            .when(t.rlike(f"^Me_d{letter}$"), F.array(mirrored(p), methylated(p)))
            .when(t.rlike(f"^d{letter}$"), F.array(mirrored(p)))
            .when(t.rlike(f"^me{letter}$"), F.array(methylated(p)))
            .when(t.rlike(f"^{letter}$"), none)
            .otherwise(F.array(replaced(p)))
        )

    kind = F.trim(shape)
    ring = _edit(
        "cyclization", "explicit", F.array(F.lit(0), last_at), F.array(first, last),
        F.lit("Circle"),
        F.concat(F.lit("cyclic(1-"), F.length(sequence).cast("string"), F.lit(")")),
        "backbone_cyclization", rules["ring"],
        {"cyclization_type": "head_to_tail", "ring_size": F.length(sequence).cast("string")},
        "head_to_tail_cyclization",
    )
    branch = _edit(
        "cyclization", "inferred", F.array().cast("array<int>"), F.array().cast("array<string>"),
        F.lit("Lariat"), F.lit("lariat"), "branch_cyclization", rules["branch"],
        {"cyclization_type": "lariat"}, "lariat_cyclization", "inferred",
    )
    closure = (
        F.when(kind == "Circle", F.array(ring)).when(kind == "Lariat", F.array(branch)).otherwise(none)
    )
    edits = F.concat(F.flatten(F.transform(placed, of_token)), closure)
    return F.transform(
        edits,
        lambda e, i: F.struct(
            F.concat(sample_id, F.lit("_edit_"), i.cast("string")).alias("edit_id"),
            *[e[n].alias(n) for n, _ in _EDIT_FIELDS],
        ),
    )


def label(text: Column) -> Column:
    """The label as a number, NULL for missing or non-numeric text (CV5)."""
    return number(text)


def sample_id(dataset: str, row_index: Column) -> Column:
    """``<DATASET>_<zero padded index>`` (CV7); the index must be a stable source key."""
    prefix = dataset.upper().replace(" ", "_").replace("-", "_")
    return F.format_string(f"{prefix}_%06d", row_index.cast("bigint"))


def assay_metadata(fields: dict[str, Column], constants: dict[str, str]) -> Column:
    """Non-null fields as a map after the constant ones (CV6)."""
    pairs = {**{k: F.lit(v) for k, v in constants.items()}, **fields}
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull() & (v != ""))


def provenance(
    source_file: Column,
    row_index: Column,
    raw: Sequence[str],
    version: str = PARSER_VERSION,
    max_fields: int | None = None,
    max_chars: int | None = None,
) -> Column:
    """Where a row came from, with its raw fields (CV9): all of them whole, unless cut by the two limits."""
    flat = []
    for name in list(raw)[:max_fields]:
        text = F.col(f"`{name}`").cast("string")
        text = text if max_chars is None else F.substring(text, 1, max_chars)
        falsy = (text == "") | (number(text) == 0) | (text == "false")
        flat += [F.lit(name), F.when(~F.coalesce(falsy, F.lit(False)), text)]
    return F.struct(
        source_file.alias("source_file"),
        row_index.cast("bigint").alias("source_row_index"),
        F.lit(version).alias("parser_version"),
        F.create_map(*flat).alias("raw_data_sample"),
    )


def convert(
    df: DataFrame,
    dataset: str,
    row_index: str,
    tokens: str,
    label_col: str,
    shape: str | None = None,
    metadata: dict[str, str] | None = None,
    year: str | None = None,
    assay_type: str = "assay",
    label_type: str = "value",
    label_unit: str = "unit",
    source_file: Column | str = "table",
    strict: bool = True,
    extra_tokens: dict[str, str] | None = None,
) -> DataFrame:
    """Every raw row as a sample plus ``error_type`` and ``error`` (CV10).

    ``error`` is NULL for good rows. Use ``good`` and ``bad`` to split; a failed row is never a
    partial sample.
    """
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    shape_col = F.col(shape) if shape else F.lit(None).cast("string")
    fields = {name: F.col(col) for name, col in (metadata or {}).items()}
    if year:
        fields["publication_year"] = number(F.col(year)).cast("int")
    raw = df.columns
    step = once(df, _tokens=parse_token_list(F.col(tokens)))
    step = once(step, _placed=placed_tokens(F.col("_tokens"), extra_tokens))
    step = once(
        step, _seq=backbone(F.col("_placed"), strict), _id=sample_id(dataset, F.col(row_index))
    )
    step = once(step, _edits=annotate(F.col("_placed"), F.col("_seq"), shape_col, F.col("_id")))
    lab = F.col(label_col)
    out = step.select(
        F.col("_id").alias("sample_id"),
        F.lit(dataset).alias("dataset"),
        F.col("_seq").alias("sequence"),
        label(lab).alias("label"),
        F.lit(label_type).alias("label_type"),
        F.lit(label_unit).alias("label_unit"),
        F.lit(assay_type).alias("assay_type"),
        assay_metadata(fields, {"assay_method": assay_type}).alias("assay_metadata"),
        F.col("_edits").alias("edits"),
        anchor_status(F.col("_edits")).alias("anchor_status"),
        provenance(source, F.col(row_index), raw).alias("provenance"),
        F.lit(None).cast("map<string,string>").alias("split_metadata"),
        F.array().cast("array<string>").alias("quality_flags"),
        lab.isNull().alias("_no_label"),
        lab.cast("string").alias("_label_text"),
    )
    checked = validate.with_errors(out, validate.sample_rules())
    error = (
        F.when(F.col("sequence").isNull(), "Failed to parse sequence")
        .when(F.col("_no_label"), "Label is missing or null")
        .when(
            F.col("label").isNull(),
            F.concat(F.lit("Cannot convert label to number: "), F.col("_label_text")),
        )
        .when(F.size("errors") > 0, F.array_join("errors", ","))
    )
    kind = (
        F.when(F.col("sequence").isNull() | F.col("label").isNull(), "ValueError")
        .when(F.size("errors") > 0, "ValidationError")
    )
    return checked.select(*out.columns[:-2], kind.alias("error_type"), error.alias("error"))


def good(converted: DataFrame) -> DataFrame:
    return converted.filter(F.col("error").isNull()).drop("error_type", "error")


def bad(converted: DataFrame) -> DataFrame:
    return converted.filter(F.col("error").isNotNull()).select(
        "sample_id", F.col("provenance.source_row_index").alias("row_index"), "error_type", "error"
    )


def report(converted: DataFrame) -> DataFrame:
    """total, successful, failed and success rate (CV11); an empty input gives rate 0."""
    agg = converted.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    rate = F.col("successful") / F.greatest(F.col("total_rows"), F.lit(1))
    return agg.withColumn("success_rate", rate)


def error_report(converted: DataFrame) -> DataFrame:
    """Rows per error text (CV11)."""
    return bad(converted).groupBy("error_type", "error").agg(F.count(F.lit(1)).alias("n"))
