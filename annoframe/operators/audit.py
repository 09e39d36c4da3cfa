"""Row audit: flags and exclusion reasons, and the reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions.sequences import LETTER_CLASS, number, once

MIN_VIABLE = 100
RECOMMENDED = 300
LOW_SINGLE_EDIT = 0.1
COMBINED_VIABLE = 100
COMBINED_MARGINAL = 50
EXAMPLES_PER_REASON = 10


def parseable(text: Column) -> Column:
    """At least one letter of the alphabet is present, case ignored (AU2)."""
    return F.upper(F.trim(text)).rlike(LETTER_CLASS)


def ambiguous(text: Column) -> Column:
    """The annotation text holds one of the ambiguity markers (AU3)."""
    low = F.lower(text)
    hit = F.lit(False)
    for marker in C.AMBIGUOUS_MARKERS:
        hit = hit | low.contains(marker)
    return hit


def numeric(label: Column) -> Column:
    """The label text reads as a number (AU4)."""
    return number(label).isNotNull()


def flag_rows(
    df: DataFrame,
    key: str,
    sequence: str,
    label: str,
    modification: str | None = None,
    assay: str | None = None,
    anchor_status: str | None = None,
    edits: str | None = None,
    duplicate_on: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Flags and exclusion reasons for every row (AU1-AU5).

    ``anchor_status`` names a status column (see ``sequences.anchor_status``); ``edits`` an
    annotation array that gives edit_count; ``duplicate_on`` columns whose copies after the
    first, by key, are flagged without being excluded.
    """
    seq = F.col(sequence)
    lab = F.col(label)
    no_seq = seq.isNull() | (F.length(seq) == 0)
    bad_seq = ~no_seq & ~parseable(seq)
    is_nan = F.lower(F.trim(lab.cast("string"))) == "nan"
    no_label = lab.isNull() | F.coalesce(is_nan, F.lit(False))
    text_label = ~no_label & ~numeric(lab)
    if modification:
        mod = F.col(modification)
        no_mod = mod.isNull() | (F.length(mod) == 0)
        bad_mod = ~no_mod & ambiguous(mod)
    else:
        no_mod = bad_mod = F.lit(False)
    has_seq = ~no_seq & ~bad_seq
    has_mod = (~no_mod & ~bad_mod) if modification else F.lit(False)
    status = F.col(anchor_status) if anchor_status else F.lit(None).cast("string")
    resolvability = F.when(has_seq & has_mod, F.coalesce(status, F.lit("unknown"))).otherwise("unknown")
    weak = resolvability == "weakly_inferable"
    reasons = [
        (no_seq, "missing_sequence"),
        (bad_seq, "unparseable_sequence"),
        (no_mod, "missing_modification"),
        (bad_mod, "ambiguous_modification"),
        (no_label, "missing_label"),
        (text_label, "non_numeric_label"),
        (resolvability == "not_resolvable", "no_anchor_resolvable"),
    ]
    if strict:
        reasons.append((weak, "weak_anchor_only"))
    df = once(df, exclusion_reasons=F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons])))
    found = F.col("exclusion_reasons")
    count = F.size(edits) if edits else F.lit(None).cast("int")
    out = df.select(
        "*",
        has_seq.alias("has_sequence"),
        has_seq.alias("is_parseable"),
        has_mod.alias("has_modification"),
        bad_mod.alias("is_ambiguous"),
        (~no_label & ~text_label).alias("has_label"),
        resolvability.alias("anchor_resolvability"),
        F.when(weak, "heuristic").alias("anchor_inference_method"),
        count.alias("edit_count"),
        F.coalesce(count == 1, F.lit(False)).alias("is_single_edit"),
        (F.col(assay) if assay else F.lit(None).cast("string")).alias("audit_assay_type"),
        (F.size(found) > 0).alias("is_excluded"),
    )
    return _mark_duplicates(out, key, duplicate_on)


def _mark_duplicates(df: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """Flag every copy after the first. A partial aggregate finds the first key of each kind, so
    a kind that holds most rows is never sorted in one task."""
    if not on:
        return df.withColumn("is_duplicate", F.lit(False))
    first = df.groupBy(*on).agg(F.min(key).alias("_first")).select("_first").distinct()
    out = df.join(first, df[key] == first["_first"], "left")
    return out.withColumn("is_duplicate", F.col("_first").isNull()).drop("_first")


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Census metrics of audited rows in one aggregate (AU6)."""
    reason = lambda r: F.array_contains("exclusion_reasons", r)
    anchor = lambda s: F.col("anchor_resolvability") == s
    usable = ~F.col("is_excluded")
    aggs = [
        F.count(F.lit(1)).alias("raw_sample_count"),
        _count(F.col("is_parseable"), "parseable_sample_count"),
        _count(~F.col("is_parseable"), "unparseable_samples"),
        _count(F.col("has_sequence"), "sequence_available_count"),
        _count(~F.col("has_sequence"), "missing_sequence_count"),
        _count(F.col("has_modification"), "modification_available_count"),
        _count(~F.col("has_modification") & reason("missing_modification"), "no_modification_count"),
        _count(reason("ambiguous_modification"), "ambiguous_modification_count"),
        _count(anchor("explicit_anchor"), "explicit_anchor_count"),
        _count(anchor("weakly_inferable"), "weakly_inferable_anchor_count"),
        _count(anchor("not_resolvable"), "not_resolvable_anchor_count"),
        _count(F.col("has_label"), "continuous_label_count"),
        _count(reason("missing_label"), "missing_label_count"),
        _count(reason("non_numeric_label"), "non_numeric_label_count"),
        _count(F.col("is_duplicate"), "duplicate_count"),
        _count(F.col("is_single_edit"), "single_edit_count"),
        _count(F.col("edit_count") > 1, "multi_edit_count"),
        _count(usable, "usable_total"),
        _count(usable & anchor("explicit_anchor"), "usable_with_explicit_anchor"),
        _count(usable & anchor("weakly_inferable"), "usable_with_weak_anchor"),
    ]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def exclusions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per exclusion reason; a row counts once for each of its reasons (AU7)."""
    long = rows.select(*by, F.explode("exclusion_reasons").alias("reason"))
    return long.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def assay_distribution(rows: DataFrame, assay: str = "audit_assay_type") -> DataFrame:
    """Rows per assay type with the share of all raw rows (AU8)."""
    counts = rows.groupBy(F.col(assay).alias("assay_type")).agg(F.count(F.lit(1)).alias("n"))
    # The table has one row per assay type; the total is the sum over it.
    total = F.greatest(F.sum("n").over(W.partitionBy(F.lit(0))), F.lit(1))
    out = counts.withColumn("pct_of_raw", 100.0 * F.col("n") / total)
    return out.filter(F.col("assay_type").isNotNull() & (F.col("assay_type") != ""))


# Stages of the filtering funnel, in order.
FUNNEL = (
    ("Raw samples", "raw_sample_count"),
    ("Parseable", "parseable_sample_count"),
    ("With sequence", "sequence_available_count"),
    ("With modification", "modification_available_count"),
    ("With label", "continuous_label_count"),
    ("Explicit anchor", "explicit_anchor_count"),
    ("Weak anchor", "weakly_inferable_anchor_count"),
    ("Usable (conservative)", "usable_total"),
)


def _unpivot(m: DataFrame, stages: Sequence[tuple[str, str]], base: str, pct: str) -> DataFrame:
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"), F.col(c).alias("n"))
        for i, (s, c) in enumerate(stages, 1)
    ]
    rows = m.select(F.col(base).alias("_b"), F.explode(F.array(*entries)).alias("e"))
    share = 100.0 * F.col("e.n") / F.greatest(F.col("_b"), F.lit(1))
    return rows.select(F.col("e.i").alias("step"), "e.stage", "e.n", share.alias(pct))


def funnel(m: DataFrame) -> DataFrame:
    """Progressive filter stages with count and share of raw rows (AU9)."""
    return _unpivot(m, FUNNEL, "raw_sample_count", "pct_of_raw")


def resolvability(m: DataFrame) -> DataFrame:
    """Anchor classes as a share of rows with annotation (AU10)."""
    stages = [
        ("Explicit Anchor", "explicit_anchor_count"),
        ("Weakly Inferable", "weakly_inferable_anchor_count"),
        ("Not Resolvable", "not_resolvable_anchor_count"),
    ]
    return _unpivot(m, stages, "modification_available_count", "pct_of_modified")


def feasibility(m: DataFrame) -> DataFrame:
    """Size class of the usable rows and the low single-edit warning (AU11)."""
    usable = F.col("usable_total")
    ratio = F.col("single_edit_count") / F.greatest(usable, F.lit(1))
    size = (
        F.when(usable < MIN_VIABLE, "INSUFFICIENT")
        .when(usable < RECOMMENDED, "MARGINAL")
        .otherwise("SUFFICIENT")
    )
    low = (F.col("single_edit_count") > 0) & (ratio < LOW_SINGLE_EDIT)
    return m.select(
        usable.alias("usable_total"),
        size.alias("feasibility"),
        ratio.alias("single_edit_ratio"),
        low.alias("low_single_edit_warning"),
    )


def combined(rows: DataFrame, dataset: str) -> DataFrame:
    """Per-dataset summary with a TOTAL row and a viability class (AU12)."""
    per = metrics(rows, [dataset])
    sums = [
        "raw_sample_count",
        "parseable_sample_count",
        "usable_total",
        "explicit_anchor_count",
        "weakly_inferable_anchor_count",
        "not_resolvable_anchor_count",
        "modification_available_count",
        "missing_sequence_count",
        "ambiguous_modification_count",
        "missing_label_count",
        "duplicate_count",
    ]
    rolled = per.rollup(dataset).agg(
        F.grouping(dataset).alias("_g"), *[F.sum(c).alias(c) for c in sums]
    )
    usable = F.col("usable_total")
    viability = (
        F.when(F.col("_g") == 1, F.lit(None).cast("string"))
        .when(usable >= COMBINED_VIABLE, "viable")
        .when(usable >= COMBINED_MARGINAL, "marginal")
        .otherwise("insufficient")
    )
    pct = 100.0 * usable / F.greatest(F.col("raw_sample_count"), F.lit(1))
    return rolled.select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(dataset)).alias("dataset"),
        *sums,
        pct.alias("usable_pct"),
        viability.alias("viability"),
    )


def export(rows: DataFrame, path: str, excluded_only: bool = True) -> None:
    """Write audited rows as CSV, reasons joined by ``;`` (AU13)."""
    kept = rows.filter("is_excluded") if excluded_only else rows
    flat = kept.withColumn("exclusion_reasons", F.array_join("exclusion_reasons", ";"))
    flat.write.mode("overwrite").option("header", True).csv(path)


def examples(
    rows: DataFrame, key: str, reasons: str = "exclusion_reasons", n: int = EXAMPLES_PER_REASON
) -> DataFrame:
    """Count of each reason and its first ``n`` rows by key (AU14).

    The examples come from a bounded partial aggregate, not from sorting a reason's rows.
    """
    long = rows.select(F.explode(reasons).alias("reason"), F.col(key).alias("_k"))
    # Rows are spread over slices first; a slice and then a reason keeps at most n keys.
    sliced = long.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(256)))
    first = W.partitionBy("reason", "_s").orderBy("_k")
    kept = sliced.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
    final = W.partitionBy("reason").orderBy("_k")
    kept = kept.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
    counts = long.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
    return kept.select("reason", "rank", F.col("_k").alias(key)).join(counts, "reason")
