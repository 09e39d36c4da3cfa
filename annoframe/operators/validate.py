"""Validation of annotated samples as named rules, all evaluated in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions.sequences import once
from annoframe.operators.metrics import finite

Rule = tuple[str, Column]
ALPHABET = f"^[{C.LETTERS}]+$"


def _all(edits: Column, test) -> Column:
    return F.coalesce(F.forall(edits, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def edit_rules(edits: Column, sequence: Column | None = None) -> list[Rule]:
    """Rules on each annotation of the array, and against the sequence when given."""
    letters = list(C.LETTERS)
    rules = [
        ("edit_id_format", _all(edits, lambda e: e["edit_id"].rlike(C.EDIT_ID_PATTERN))),
        ("edit_family_allowed", _all(edits, lambda e: e["edit_family"].isin(*C.FAMILIES))),
        ("anchor_kind_allowed", _all(edits, lambda e: e["anchor_kind"].isin(*C.ANCHOR_KINDS))),
        ("parser_status_allowed", _all(edits, lambda e: e["parser_status"].isin(*C.PARSER_STATUSES))),
        (
            "positions_sorted_unique",
            _all(
                edits,
                lambda e: e["anchor_positions"] == F.array_sort(F.array_distinct(e["anchor_positions"])),
            ),
        ),
        (
            "residues_in_alphabet",
            _all(edits, lambda e: F.forall(e["anchor_residues"], lambda r: r.isin(*letters))),
        ),
        (
            "positions_match_residues",
            _all(edits, lambda e: F.size(e["anchor_positions"]) == F.size(e["anchor_residues"])),
        ),
        (
            "global_has_no_positions",
            _all(
                edits,
                lambda e: (e["anchor_kind"] != "global")
                | ((F.size(e["anchor_positions"]) == 0) & (F.size(e["anchor_residues"]) == 0)),
            ),
        ),
    ]
    if sequence is not None:
        rules += [
            (
                "positions_inside_sequence",
                _all(
                    edits,
                    lambda e: F.forall(
                        e["anchor_positions"], lambda p: (p >= 0) & (p < F.length(sequence))
                    ),
                ),
            ),
            (
                "residues_match_sequence",
                _all(
                    edits,
                    lambda e: F.forall(
                        F.zip_with(
                            e["anchor_positions"],
                            e["anchor_residues"],
                            lambda p, r: F.substring(sequence, p + 1, F.lit(1)) == r,
                        ),
                        lambda ok: F.coalesce(ok, F.lit(True)),
                    ),
                ),
            ),
        ]
    return rules


def status_consistent(edits: Column, status: Column) -> Column:
    """The sample status agrees with the annotation kinds (VA10); mixed kinds accept two."""
    explicit = F.forall(edits, lambda e: e["anchor_kind"] == "explicit")
    loose = F.exists(edits, lambda e: e["anchor_kind"].isin("inferred", "ambiguous"))
    return (
        F.when(F.size(edits) == 0, status == "no_edits")
        .when(explicit, status == "explicit_anchor")
        .when(loose, status.isin("weakly_inferable", "not_resolvable"))
        .otherwise(F.lit(True))
    )


def sample_rules() -> list[Rule]:
    """Every field and cross-field rule of a sample (VA1-VA10); TRUE means the rule holds."""
    seq = F.upper("sequence")
    edits = F.col("edits")
    text = lambda c: F.length(c) >= 1
    rules: list[Rule] = [
        ("sample_id_format", F.col("sample_id").rlike(C.SAMPLE_ID_PATTERN)),
        ("dataset_present", text("dataset")),
        ("sequence_length", F.length(seq).between(C.MIN_LENGTH, C.MAX_LENGTH)),
        ("sequence_alphabet", seq.rlike(ALPHABET)),
        ("label_finite", finite(F.col("label").cast("double"))),
        ("label_type_present", F.col("label_type").isNotNull()),
        ("label_unit_present", F.col("label_unit").isNotNull()),
        ("assay_type_present", F.col("assay_type").isNotNull()),
        ("assay_metadata_present", F.size("assay_metadata") >= 1),
        ("anchor_status_allowed", F.col("anchor_status").isin(*C.ANCHOR_STATUSES)),
        (
            "provenance_keys",
            reduce(lambda a, b: a & b, [F.col(f"provenance.{k}").isNotNull() for k in C.PROVENANCE_KEYS]),
        ),
    ]
    rules += edit_rules(edits, seq)
    rules.append(("anchor_status_consistent", status_consistent(edits, F.col("anchor_status"))))
    return rules


def legacy_rules(sequence: str, mods: str) -> list[Rule]:
    """Rules of the older record form (VA13): ``mods`` holds structs with position and
    modification_type."""
    seq, arr = F.col(sequence), F.col(mods)
    inside = lambda m: m["position"].isNull() | (
        (m["position"] >= 0) & (m["position"] < F.length(seq))
    )
    placed = lambda m: (m["modification_type"] != "side_chain") | m["position"].isNotNull()
    return [
        ("sequence_alphabet", seq.rlike(f"^[{C.LETTERS}]*$")),
        ("position_in_range", _all(arr, inside)),
        ("side_chain_has_position", _all(arr, placed)),
    ]


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``errors``: the names of the rules a row breaks (NULL counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return once(df, errors=F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors) (VA11)."""
    checked = with_errors(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def normalise_sequence(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The stored form of a sequence is upper case (VA2)."""
    return df.withColumn(sequence, F.upper(sequence))


def report(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, valid and invalid rows per group (VA12)."""
    bad = F.size("errors") > 0
    aggs = [
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(~bad).alias("valid_samples"),
        F.count_if(bad).alias("invalid_samples"),
    ]
    return checked.groupBy(*by).agg(*aggs) if by else checked.agg(*aggs)


def error_counts(checked: DataFrame) -> DataFrame:
    """Rows per broken rule (VA12)."""
    long = checked.select(F.explode("errors").alias("error"))
    return long.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def attachments(
    df: DataFrame, sequence: str, position: str, residue: str, atom: str
) -> DataFrame:
    """Attachment checks per row (VA14): position in range, residue match, atom allowed.

    The residue-atom table is a fixed map of 20 letters, looked up in place.
    """
    seq, pos, res = F.col(sequence), F.col(position), F.col(residue)
    atoms = F.create_map(
        *[x for k, v in C.RESIDUE_ATOMS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    )
    in_range = (pos >= 0) & (pos < F.length(seq))
    match = in_range & (F.substring(seq, pos + 1, F.lit(1)) == res)
    allowed = F.coalesce(F.array_contains(F.try_element_at(atoms, res), F.col(atom)), F.lit(False))
    error = (
        F.when(~F.coalesce(in_range, F.lit(False)), "position_out_of_range")
        .when(~F.coalesce(match, F.lit(False)), "residue_mismatch")
        .when(~allowed, "atom_not_allowed")
    )
    return df.withColumns(
        {
            "in_range": F.coalesce(in_range, F.lit(False)),
            "residue_match": F.coalesce(match, F.lit(False)),
            "atom_allowed": allowed,
            "attachment_error": error,
        }
    )
