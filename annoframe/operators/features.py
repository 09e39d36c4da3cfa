"""Feature columns on sequences and annotation arrays, and train-fitted transforms.

Every block is a list of named double columns over one row, so Spark prunes the blocks a model
does not use and no shuffle happens before the model step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions.sequences import of_family, once, zero_nonfinite
from annoframe.operators import ranks


def _dbl(col: Column, name: str) -> Column:
    return col.cast("double").alias(name)


def _letter_count(text: Column, letters: str) -> Column:
    """Number of characters of ``text`` that are in ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def composition(sequence: Column) -> list[Column]:
    """Share of each of the 20 letters (FE1); an empty sequence gives 0."""
    s, n = F.upper(sequence), F.greatest(F.length(sequence), F.lit(1))
    return [_dbl(_letter_count(s, a) / n, f"aa_{a}") for a in C.LETTERS]


def property_composition(sequence: Column) -> list[Column]:
    """Share of each of the 8 overlapping letter groups (FE2)."""
    s, n = F.upper(sequence), F.greatest(F.length(sequence), F.lit(1))
    return [_dbl(_letter_count(s, group) / n, f"prop_{k}") for k, group in C.PROPERTY_GROUPS.items()]


def bigram_map(sequence: Column) -> Column:
    """Share of each overlapping letter pair that occurs, as a map (FE3)."""
    s = F.upper(sequence)
    n = F.length(s) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    known = F.filter(pairs, lambda p: p.rlike(f"^[{C.LETTERS}]{{2}}$"))
    entries = F.transform(
        F.array_distinct(known),
        lambda p: F.struct(p, (F.size(F.filter(known, lambda q: q == p)) / n).alias("v")),
    )
    return F.map_from_entries(entries)


def bigrams(sequence: Column) -> list[Column]:
    """All 400 letter-pair shares as columns (FE3)."""
    shares = bigram_map(sequence)
    return [
        _dbl(F.coalesce(F.try_element_at(shares, F.lit(a + b)), F.lit(0.0)), f"di_{a}{b}")
        for a in C.LETTERS
        for b in C.LETTERS
    ]


def _property_sum(text: Column, table: dict[str, float]) -> Column:
    """Sum of a letter property over a text, as counts times values."""
    total = F.lit(0.0)
    for letter, value in table.items():
        total = total + _letter_count(text, letter) * F.lit(float(value))
    return total


def basic(sequence: Column) -> list[Column]:
    """Length, mass, charge, mean hydropathy and aromatic share (FE4)."""
    s = F.upper(sequence)
    n = F.greatest(F.length(s), F.lit(1))
    return [
        _dbl(F.length(s), "length"),
        _dbl(_property_sum(s, C.MASS), "molecular_weight"),
        _dbl(_letter_count(s, "KR") - _letter_count(s, "DE"), "charge"),
        _dbl(_property_sum(s, C.HYDROPATHY) / n, "hydrophobicity"),
        _dbl(_letter_count(s, "FYW") / n, "aromaticity"),
    ]


def composition_vector(
    sequence: Column, properties: bool = True, pairs: bool = False, extras: bool = True
) -> list[Column]:
    """Letter shares with optional groups, pairs and basics: 33 or 433 columns (FE5)."""
    out = composition(sequence)
    if properties:
        out += property_composition(sequence)
    if pairs:
        out += bigrams(sequence)
    if extras:
        out += basic(sequence)
    return out


def _placed(edits: Column) -> Column:
    return F.filter(
        edits, lambda e: (e["anchor_kind"] != "global") & (F.size(e["anchor_positions"]) > 0)
    )


def anchor_positions(edits: Column) -> Column:
    """Positions of all non-global annotations, copies kept (FE6)."""
    return F.flatten(F.transform(_placed(edits), lambda e: e["anchor_positions"]))


def anchor_residues(edits: Column) -> Column:
    """Residues of all non-global annotations that have positions, copies kept (FE6)."""
    return F.flatten(F.transform(_placed(edits), lambda e: e["anchor_residues"]))


def position_stats(positions: Column, sequence: Column) -> list[Column]:
    """Six position statistics with the population sd (FE7); no positions gives zeros."""
    n = F.size(positions)
    total = F.aggregate(positions, F.lit(0.0), lambda a, p: a + p)
    mean = total / n
    spread = F.aggregate(positions, F.lit(0.0), lambda a, p: a + (p - mean) * (p - mean))
    distinct = F.size(F.array_distinct(positions))
    some = n > 0
    values = {
        "anchor_count_total": n,
        "anchor_count_unique": distinct,
        "anchor_density": distinct / F.greatest(F.length(sequence), F.lit(1)),
        "anchor_pos_mean": mean,
        "anchor_pos_std": F.sqrt(spread / n),
        "anchor_pos_range": F.array_max(positions) - F.array_min(positions),
    }
    return [_dbl(F.when(some, v).otherwise(0), k) for k, v in values.items()]


def residue_text(residues: Column) -> Column:
    """Anchor residues as one text, so that letter counts need no array functions."""
    return F.array_join(residues, "")


def _share(residues: Column, letters: str) -> Column:
    n = F.length(residues)
    return F.when(n > 0, _letter_count(residues, letters) / n).otherwise(0)


def residue_composition(residues: Column) -> list[Column]:
    """Share of each letter in the text of anchor residues (FE8)."""
    return [_dbl(_share(residues, a), f"anchor_res_{a}") for a in C.LETTERS]


def residue_properties(residues: Column, edits: Column) -> list[Column]:
    """Six residue group shares and three terminal counts (FE9) from the text of anchor residues;
    all zero without anchors."""
    some = F.length(residues) > 0
    out = [_dbl(_share(residues, g), f"anchor_{k}_frac") for k, g in C.ANCHOR_GROUPS.items()]
    ends = F.size(of_family(edits, "n_terminal", "c_terminal"))
    tails = {
        "anchor_terminal_frac": ends / F.greatest(F.size(edits), F.lit(1)),
        "anchor_n_terminal_count": F.size(of_family(edits, "n_terminal")),
        "anchor_c_terminal_count": F.size(of_family(edits, "c_terminal")),
    }
    return out + [_dbl(F.when(some, v).otherwise(0), k) for k, v in tails.items()]


def family_block(edits: Column) -> list[Column]:
    """Annotations per family (FE10)."""
    return [_dbl(F.size(of_family(edits, f)), f"edit_family_{f}") for f in C.FAMILIES]


def type_entropy(types: Column) -> Column:
    """Shannon entropy in bits of the values of an array; empty gives 0."""
    n = F.size(types)
    share = lambda t: F.size(F.filter(types, lambda x: x == t)) / n
    return F.aggregate(F.array_distinct(types), F.lit(0.0), lambda a, t: a - share(t) * F.log2(share(t)))


def diversity_block(edits: Column) -> list[Column]:
    """Distinct types, type entropy, distinct attachments, ring and backbone flags (FE11)."""
    types = F.transform(edits, lambda e: e["edit_type"])
    attached = F.transform(edits, lambda e: e["attachment_semantics"])
    return [
        _dbl(F.size(F.array_distinct(types)), "edit_type_count_unique"),
        _dbl(type_entropy(types), "edit_type_entropy"),
        _dbl(F.size(F.array_distinct(attached)), "attachment_type_count_unique"),
        _dbl(F.size(of_family(edits, "cyclization")) > 0, "has_cyclization"),
        _dbl(F.size(of_family(edits, "backbone")) > 0, "has_backbone_mod"),
    ]


def type_block(edits: Column) -> list[Column]:
    """Annotations of nine named types and of all others (FE12)."""
    def of_type(t: str) -> Column:
        return F.size(F.filter(edits, lambda e: e["edit_type"] == t))

    named = [_dbl(of_type(t), f"edit_type_{t}") for t in C.COUNTED_TYPES]
    others = F.size(F.filter(edits, lambda e: ~e["edit_type"].isin(*C.COUNTED_TYPES)))
    return [*named, _dbl(others, "edit_type_other")]


def aggregate_block(edits: Column, positions: Column, sequence: Column) -> list[Column]:
    """Multi-anchor count, ring size, overlap, length, ring flag, annotations per residue (FE13)."""
    sizes = F.transform(
        of_family(edits, "cyclization"),
        lambda e: F.try_element_at(e["edit_metadata"], F.lit("ring_size")).try_cast("double"),
    )
    sizes = F.filter(sizes, lambda v: v.isNotNull() & (v != 0))
    overlap = F.filter(
        F.array_distinct(positions), lambda p: F.size(F.filter(positions, lambda q: q == p)) > 1
    )
    n = F.length(sequence)
    return [
        _dbl(F.size(F.filter(edits, lambda e: F.size(e["anchor_positions"]) > 1)), "anchor_pair_count"),
        _dbl(F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0)), "cyclization_ring_size"),
        _dbl(F.size(overlap), "edit_anchor_overlap"),
        _dbl(n, "sequence_length"),
        _dbl(F.size(of_family(edits, "cyclization")) > 0, "sequence_cyclic"),
        _dbl(F.size(edits) / F.greatest(n, F.lit(1)), "modification_rate"),
    ]


def descriptor_block(names: Sequence[str], edits: Column) -> list[Column]:
    """External descriptors (missing is 0) and the two annotation counts: block A (JN13)."""
    families = F.array_distinct(F.transform(edits, lambda e: e["edit_family"]))
    return [
        *[_dbl(zero_nonfinite(F.col(n)), n) for n in names],
        _dbl(F.size(edits), "num_edits"),
        _dbl(F.size(families), "num_edit_families"),
    ]


# Blocks of each representation.
MODES = {
    "full": ("A", "B1", "B2", "B3", "C"),
    "chemistry_only": ("A",),
    "chemistry_position": ("A", "B1"),
    "chemistry_residue": ("A", "B2"),
    "chemistry_context": ("A", "B3"),
    "chemistry_attachment": ("A", "C"),
    "chemistry_anchors": ("A", "B1", "B2", "B3"),
    "site_context_only": ("B1", "B2", "B3", "C"),
    "site_only": ("B1", "B2", "B3"),
    "context_only": ("C",),
    "position_only": ("B1",),
}


def with_anchors(df: DataFrame, edits: str = "edits") -> DataFrame:
    """Helper columns the blocks share, computed once per row: ``_pos`` and ``_res``."""
    ann = F.col(edits)
    return once(df, _pos=anchor_positions(ann), _res=residue_text(anchor_residues(ann)))


def block_columns(
    mode: str,
    sequence: str = "sequence",
    edits: str = "edits",
    descriptors: Sequence[str] = C.DESCRIPTORS,
) -> list[Column]:
    """Feature columns of a representation, in fixed order (FE14), over ``with_anchors`` rows."""
    seq, ann = F.col(sequence), F.col(edits)
    positions, residues = F.col("_pos"), F.col("_res")
    blocks = {
        "A": lambda: descriptor_block(descriptors, ann),
        "B1": lambda: position_stats(positions, seq),
        "B2": lambda: residue_composition(residues),
        "B3": lambda: residue_properties(residues, ann),
        "C": lambda: [
            *family_block(ann),
            *diversity_block(ann),
            *type_block(ann),
            *aggregate_block(ann, positions, seq),
        ],
    }
    if mode not in MODES:
        raise ValueError(f"unknown representation {mode!r}; one of {sorted(MODES)}")
    return [c for b in MODES[mode] for c in blocks[b]()]


def feature_names(mode: str, descriptors: Sequence[str] = C.DESCRIPTORS) -> list[str]:
    """Names matching ``block_columns`` without needing a DataFrame (FE14)."""
    b1 = list(C.ATTRIBUTION_B1)
    names = {
        "A": [*descriptors, "num_edits", "num_edit_families"],
        "B1": b1,
        "B2": [f"anchor_res_{a}" for a in C.LETTERS],
        "B3": list(C.ATTRIBUTION_B3),
        "C": [
            *[f"edit_family_{f}" for f in C.FAMILIES],
            "edit_type_count_unique",
            "edit_type_entropy",
            "attachment_type_count_unique",
            "has_cyclization",
            "has_backbone_mod",
            *[f"edit_type_{t}" for t in C.COUNTED_TYPES],
            "edit_type_other",
            "anchor_pair_count",
            "cyclization_ring_size",
            "edit_anchor_overlap",
            "sequence_length",
            "sequence_cyclic",
            "modification_rate",
        ],
    }
    return [n for b in MODES[mode] for n in names[b]]


def select_blocks(df: DataFrame, mode: str, keep: Sequence[str], **columns) -> DataFrame:
    """``keep`` columns and the features of a representation; unused blocks are never computed."""
    ready = with_anchors(df, columns.get("edits", "edits"))
    return ready.select(*keep, *block_columns(mode, **columns))


def count_features(edits: Column) -> list[Column]:
    """Annotation and family counts without any structure (FE17)."""
    families = F.array_distinct(F.transform(edits, lambda e: e["edit_family"]))
    return [
        _dbl(F.size(edits), "num_edits"),
        _dbl(F.size(families), "num_edit_families"),
        *family_block(edits),
    ]


def join_descriptors(
    df: DataFrame,
    descriptors: DataFrame,
    key: str,
    names: Sequence[str],
    salt: int = 1,
) -> DataFrame:
    """Left join of a descriptor table by structure key; missing or non-finite becomes 0 (JN13).

    ``salt`` spreads a hot key: rows get a hashed salt and the descriptor rows one copy per salt.
    """
    right = descriptors.select(key, *names)
    if salt > 1:
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int"))
        joined = left.join(right, [key, "_salt"], "left").drop("_salt")
    else:
        joined = df.join(right, key, "left")
    return joined.withColumns({n: zero_nonfinite(F.col(n)) for n in names})


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str = "profile_") -> DataFrame:
    """0/1 columns for the given values (LK3)."""
    return df.withColumns(
        {f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values}
    )


def seen_families(train: DataFrame, edits: str = "edits") -> list[str]:
    """Families that occur in the training rows (FE15): at most the fixed vocabulary."""
    rows = train.select(F.explode(edits).alias("e")).select("e.edit_family").distinct()
    known = rows.filter(F.col("edit_family").isin(*C.FAMILIES))
    return sorted(r[0] for r in known.limit(len(C.FAMILIES)).collect())


def family_counts(edits: Column, families: Sequence[str]) -> list[Column]:
    """Total and per-family counts for families fixed on the training rows (FE15)."""
    return [
        _dbl(F.size(edits), "total_edits"),
        *[_dbl(F.size(of_family(edits, f)), f"count_{f}") for f in families],
    ]


def window_mean(
    df: DataFrame,
    keep: Sequence[str],
    sequence: str = "sequence",
    edits: str = "edits",
    width: int = 2,
) -> DataFrame:
    """``keep`` columns and the window features at the first position of each annotation, averaged
    over the annotations that have one (FE16): three letter properties per offset and the
    relative position.

    The letters met at one offset are joined to a text, once per row, so a mean is letter counts
    times property values. Offsets outside the sequence count as 0; no annotation gives zeros.
    """
    seq = F.col(sequence)
    spots = F.transform(edits, lambda e: F.get(e["anchor_positions"], F.lit(0)))
    rows = once(df, _spots=F.array_compact(spots))
    pad = "-" * width
    padded = F.concat(F.lit(pad), seq, F.lit(pad))

    def met(d: int) -> Column:
        return F.array_join(
            F.transform("_spots", lambda p: F.substring(padded, p + width + d + 1, F.lit(1))), ""
        )

    offsets = range(-width, width + 1)
    rows = once(rows, **{f"_at{i}": met(d) for i, d in enumerate(offsets)})
    n = F.size("_spots")

    def mean(total: Column) -> Column:
        return F.when(n > 0, total / n).otherwise(0)

    out = []
    for i, d in enumerate(offsets):
        text = F.col(f"_at{i}")
        out += [
            _dbl(mean(_property_sum(text, C.HYDROPATHY)), f"pos{d}_hydrophobicity"),
            _dbl(mean(_property_sum(text, C.WINDOW_CHARGE)), f"pos{d}_charge"),
            _dbl(mean(_letter_count(text, C.WINDOW_LARGE)), f"pos{d}_size"),
        ]
    relative = F.aggregate("_spots", F.lit(0.0), lambda a, p: a + p)
    out.append(_dbl(mean(relative) / F.greatest(F.length(seq), F.lit(1)), "normalized_position"))
    return rows.select(*keep, *out)


def window_names(width: int = 2) -> list[str]:
    parts = ("hydrophobicity", "charge", "size")
    return [f"pos{d}_{p}" for d in range(-width, width + 1) for p in parts] + ["normalized_position"]


def shingles(tokens: Column, n: int = 2) -> Column:
    """Distinct runs of ``n`` neighbouring tokens."""
    count = F.size(tokens) - n + 1
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.array_join(F.slice(tokens, i, n), " "),
    )
    return F.when(count > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hashed_tokens(items: Column, n_bits: int = 2048) -> Column:
    """Sorted distinct hash slots of an array of tokens: a sparse set fingerprint (SM8)."""
    slot = lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(n_bits)
    ).cast("int")
    return F.array_sort(F.array_distinct(F.transform(items, slot)))


class MedianImputer:
    """Fill NULL and NaN with medians of the training rows (FE18); an all-null column gets 0."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.medians: dict[str, float] = {}

    def fit(self, train: DataFrame) -> MedianImputer:
        long = train.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                        for c in self.columns
                    ]
                )
            ).alias("e")
        ).select("e.name", "e.v")
        found = ranks.quantiles(long, "v", {"median": 0.5}, ["name"])
        # One row per column of the feature matrix.
        seen = {r["name"]: r["median"] for r in found.collect()}
        self.medians = {c: float(seen.get(c, 0.0)) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {}
        for c in self.columns:
            v = F.col(c).cast("double")
            fill[c] = F.when(v.isNull() | F.isnan(v), F.lit(self.medians[c])).otherwise(v)
        return df.withColumns(fill)


class Standardiser:
    """Zero mean and unit population sd from the training rows (FE19); constants divide by 1."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.scale: dict[str, tuple[float, float]] = {}

    def fit(self, train: DataFrame) -> Standardiser:
        aggs = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(self.columns)]
        aggs += [F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(self.columns)]
        row = train.agg(*aggs).first()
        self.scale = {
            c: (float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0) or 1.0)
            for i, c in enumerate(self.columns)
        }
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scale.items()}
        )


