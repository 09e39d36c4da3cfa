"""Rule-table canonicalisation of annotations: the first matching rule decides (SC4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions.sequences import context, once, tagged_string

# Rule ids, in the order they are tried.
MIRRORED = "ncaa_d_amino_acid_v1"
BRIDGE = "cyclization_disulfide_v1"
ACETYL = "sidechain_acetylation_v1"
PHOSPHATE = "sidechain_phosphorylation_v1"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonicalise(df: DataFrame, sequence: str, edit: str) -> DataFrame:
    """Add canonical columns for one annotation struct per row.

    Outcomes: parsed (tagged string set), a matching rule that failed (error set), or no rule.
    """
    seq, e = F.col(sequence), F.col(edit)
    family, kind = e["edit_family"], e["edit_type"]
    spots = F.array_sort(e["anchor_positions"])
    rule = (
        F.when((family == "substitution") & (kind == "d_amino_acid"), MIRRORED)
        .when(
            (family == "cyclization") & (kind == "disulfide_bridge") & (F.size(spots) == 2), BRIDGE
        )
        .when((kind == "acetylation") & family.isin("sidechain", "n_terminal"), ACETYL)
        .when((family == "sidechain") & (kind == "phosphorylation"), PHOSPHATE)
    )
    rows = once(
        df,
        **{
            "rule_id": rule,
            "_p": F.when(rule == BRIDGE, F.get(spots, F.lit(0))).otherwise(
                F.get(e["anchor_positions"], F.lit(0))
            ),
            "_q": F.when(rule == BRIDGE, F.get(spots, F.lit(1))),
        }
    )
    r, p, q = F.col("rule_id"), F.col("_p"), F.col("_q")
    letter = F.substring(seq, p + 1, F.lit(1))
    second = F.substring(seq, q + 1, F.lit(1))
    rows = once(rows, _r=letter, _r2=second)
    letter, second = F.col("_r"), F.col("_r2")
    at_start = (family == "n_terminal") & (p == 0)
    atom = (
        F.when(r == MIRRORED, "CA")
        .when(r == BRIDGE, "SG")
        .when((r == ACETYL) & at_start, "N")
        .when((r == ACETYL) & (letter == "K"), "NZ")
        .when(r == PHOSPHATE, F.try_element_at(_table(C.PHOSPHATE_ATOMS), letter))
    )
    outside = (p < 0) | (p >= F.length(seq))
    words = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    allowed = F.create_map(
        *[x for k, v in C.RESIDUE_ATOMS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    )
    known_atom = F.coalesce(F.array_contains(F.try_element_at(allowed, letter), atom), F.lit(False))
    error = (
        F.when(r.isNull(), "No matching canonicalization rule")
        .when((r != BRIDGE) & p.isNull(), "Missing anchor position")
        .when(
            (r == BRIDGE) & ((p < 0) | (q >= F.length(seq))),
            words("Invalid positions ", p, ", ", q),
        )
        .when((r != BRIDGE) & outside, words("Invalid position ", p))
        .when(
            (r == BRIDGE) & ((letter != "C") | (second != "C")),
            words("Both positions must be Cys, got ", letter, ", ", second),
        )
        .when(
            (r == MIRRORED) & ~letter.isin(*C.LETTERS),
            words("No D-amino acid SMILES for ", letter),
        )
        .when(
            (r == ACETYL) & atom.isNull(),
            words("Acetylation not supported for ", letter, " at position ", p),
        )
        .when((r == PHOSPHATE) & atom.isNull(), words("Phosphorylation not supported for ", letter))
        .when(
            r.isin(ACETYL, PHOSPHATE) & ~known_atom,
            words("Invalid attachment: ", letter, ".", atom),
        )
    )
    name = (
        F.when(r == MIRRORED, F.concat(F.lit("d"), letter))
        .when(r == BRIDGE, "disulfide")
        .when(r == ACETYL, "Ac")
        .when(r == PHOSPHATE, "PO3")
    )
    structure = (
        F.when(r == MIRRORED, F.try_element_at(_table(C.MIRRORED_STRUCTURES), letter))
        .when(r == BRIDGE, "S-S")
        .when(r == ACETYL, "CC(=O)")
        .when(r == PHOSPHATE, "OP(=O)(O)O")
    )

    def point(pos: Column, residue: Column) -> Column:
        return F.struct(
            pos.alias("position"),
            residue.alias("residue"),
            F.col("_atom").alias("atom"),
            F.lit("single").alias("bond"),
        )

    rows = once(rows, canonical_error=error, _atom=atom, _name=name, _structure=structure)
    bad = F.col("canonical_error").isNotNull()
    attach, ctx = point(p, letter), context(seq, p)
    bridge = F.when(r == BRIDGE, point(q, second))
    tag = tagged_string(F.col("_name"), F.col("_structure"), attach, ctx, bridge, context(seq, q))
    note = (
        F.when(r.isNull(), "unsupported_modification")
        .when(bad, F.concat(F.lit("Failed with "), r, F.lit(": "), F.col("canonical_error")))
        .otherwise(F.concat(F.lit("Parsed with "), r))
    )
    out = rows.withColumns(
        {
            "tagged": F.when(~bad, tag),
            "moiety_structure": F.when(~bad, F.col("_structure")),
            "moiety_name": F.when(~bad, F.col("_name")),
            "attachment": F.when(~bad, attach),
            "bridge_attachment": F.when(~bad, bridge),
            "canonical_note": note,
        }
    )
    return out.drop("_p", "_q", "_r", "_r2", "_atom", "_name", "_structure")
