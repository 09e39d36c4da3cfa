"""String and array expressions on sequences and their annotation arrays.

Annotations are an array of structs with at least edit_family, edit_type, anchor_kind,
anchor_positions and anchor_residues. Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions.constants import LETTERS

LETTER_CLASS = f"[{LETTERS}]"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    A projection may be inlined into every later use, and a filter on it is pushed below it with
    the whole expression. Exploding a one-element array is a row-local step that neither crosses.
    """
    fields = [col.alias(name) for name, col in columns.items()]
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.array(F.struct(*fields))).alias("_once")).select(
        *keep, *[F.col(f"_once.{name}").alias(name) for name in columns]
    )


def letters_of(text: Column) -> Column:
    """Array of the characters of ``text``."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def window(text: Column, position: Column, width: int = 3) -> Column:
    """Characters from ``width`` before to ``width`` after a position, cut at the ends (SC1)."""
    start = F.greatest(F.lit(0), position - width)
    end = F.least(F.length(text), position + width + 1)
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def pair_window(source: Column, target: Column, position: Column, width: int = 3) -> Column:
    """The same window in the source and the target of a pair (SC1)."""
    start = F.greatest(F.lit(0), position - width)

    def cut(text: Column) -> Column:
        end = F.least(F.length(text), position + width + 1)
        return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))

    return F.struct(cut(source).alias("source"), cut(target).alias("target"))


def context(text: Column, position: Column, width: int = 3) -> Column:
    """Struct before, anchor, after; both sides padded with ``-`` to ``width`` (SC2)."""
    start = F.greatest(F.lit(0), position - width)
    before = F.substring(text, start + 1, position - start)
    after = F.substring(text, position + 2, F.lit(width))
    return F.struct(
        F.lpad(before, width, "-").alias("before"),
        F.substring(text, position + 1, F.lit(1)).alias("anchor"),
        F.rpad(after, width, "-").alias("after"),
    )


def context_text(ctx: Column) -> Column:
    return F.concat(F.lit("["), ctx["before"], F.lit("-"), ctx["anchor"], F.lit("-"), ctx["after"], F.lit("]"))


def attachment_text(attachment: Column) -> Column:
    """``<residue><position>.<atom>.<bond>``."""
    return F.concat(
        attachment["residue"],
        attachment["position"].cast("string"),
        F.lit("."),
        attachment["atom"],
        F.lit("."),
        attachment["bond"],
    )


def tagged_string(
    name: Column,
    structure: Column,
    attachment: Column,
    ctx: Column,
    bridge: Column | None = None,
    bridge_ctx: Column | None = None,
) -> Column:
    """``moiety@attachment:[context]``; a bridge joins two attachments and two contexts (SC3)."""
    moiety = F.when(F.length(name) > 0, name).otherwise(structure)
    single = F.concat(moiety, F.lit("@"), attachment_text(attachment), F.lit(":"), context_text(ctx))
    if bridge is None:
        return single
    double = F.concat(
        moiety,
        F.lit("@"),
        attachment_text(attachment),
        F.lit("-"),
        attachment_text(bridge),
        F.lit(":"),
        context_text(ctx),
        F.lit("~"),
        context_text(bridge_ctx),
    )
    return F.when(bridge.isNotNull(), double).otherwise(single)


def explicit_anchors(edits: Column) -> Column:
    """First position and canonical text of each explicit annotation with positions (SC5)."""
    kept = F.filter(
        edits, lambda e: (e["anchor_kind"] == "explicit") & (F.size(e["anchor_positions"]) > 0)
    )
    return F.transform(
        kept,
        lambda e: F.struct(
            F.get(e["anchor_positions"], F.lit(0)).alias("position"),
            e["chem_rep_canonical"].alias("text"),
        ),
    )


def of_family(edits: Column, *families: str) -> Column:
    return F.filter(edits, lambda e: e["edit_family"].isin(*families))


def scaffold_key(sequence: Column, edits: Column) -> Column:
    """The sequence, followed by ``_cyc_`` and the sorted distinct ring positions if any (SC6)."""
    rings = of_family(edits, "cyclization")
    spots = F.array_sort(
        F.array_distinct(F.flatten(F.transform(rings, lambda e: e["anchor_positions"])))
    )
    text = F.array_join(F.transform(spots, lambda p: p.cast("string")), "_")
    return F.when(F.size(rings) > 0, F.concat(sequence, F.lit("_cyc_"), text)).otherwise(sequence)


def profile_key(edits: Column) -> Column:
    """Sorted distinct families joined with ``+``, or ``no_edits`` (SC7)."""
    names = F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["edit_family"])))
    return F.when(F.size(edits) > 0, F.array_join(names, "+")).otherwise("no_edits")


def modified_positions(positions: Column) -> Column:
    """Sorted non-null positions, copies kept (SC8)."""
    return F.array_sort(F.array_compact(positions))


def is_cyclic(ring_info: Column) -> Column:
    """True when ring information is present (SC8)."""
    return ring_info.isNotNull()


def family_key(source: Column, length: Column, shape: Column) -> Column:
    """``source|len=n|shape`` (SC9)."""
    return F.concat(source, F.lit("|len="), length.cast("int").cast("string"), F.lit("|"), shape)


def trailing_number(name: Column) -> Column:
    """The last run of digits in a name as a number, 0 if there is none (SC10)."""
    digits = F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))
    last = F.when(F.size(digits) > 0, F.element_at(digits, -1))
    return F.coalesce(last.try_cast("bigint"), F.lit(0).cast("bigint"))


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance (SC11)."""
    return F.levenshtein(left, right)


def zero_nonfinite(value: Column) -> Column:
    """NaN, infinite and NULL become 0 (SC13)."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


def anchor_status(edits: Column) -> Column:
    """Overall status from the annotation kinds (CV8)."""
    kind = lambda k: F.exists(edits, lambda e: e["anchor_kind"] == k)
    return (
        F.when(F.size(edits) == 0, "no_edits")
        .when(F.forall(edits, lambda e: e["anchor_kind"] == "explicit"), "explicit_anchor")
        .when(kind("ambiguous"), "not_resolvable")
        .when(kind("inferred") | kind("global"), "weakly_inferable")
        .otherwise("not_resolvable")
    )


def flatten_record(record: Column, paths: dict[str, str]) -> list[Column]:
    """Nested fields as flat columns: {output name: dotted path} (SC12)."""
    out = []
    for name, path in paths.items():
        col = record
        for part in path.split("."):
            col = col[part]
        out.append(col.alias(name))
    return out


# What a number may look like: no type suffixes such as 1d or 5f, which a cast would take.
_NUMBER = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"


def number(text: Column) -> Column:
    """The text as a double, NULL if it is not written as a number."""
    plain = F.trim(text.cast("string"))
    return F.when(plain.rlike(_NUMBER), F.regexp_replace(plain, "_", "").try_cast("double"))
