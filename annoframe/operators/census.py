"""Profile jobs on a raw table: counts, missing values, statistics, notation patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.functions import constants as C
from annoframe.functions.joins import join_keys
from annoframe.operators import ranks

# Notation patterns of a sequence text.
PATTERNS = {
    "contains_brackets": r"[\[\]]",
    "contains_dashes": r"-",
    "contains_lowercase": r"\p{Ll}",
    "contains_special_chars": r"[(){}*#]",
    "all_uppercase": r"^\p{Lu}+$",
}


def detect_column(columns: Sequence[str], parts: Sequence[str]) -> str | None:
    """First column, in column order, whose name contains one of ``parts``."""
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def profile(df: DataFrame, permeability: bool = False) -> DataFrame:
    """Row count, fields and the detected sequence and label columns in one row (CE1)."""
    label_parts = C.PERMEABILITY_NAME_PARTS if permeability else C.LABEL_NAME_PARTS
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        "total_records",
        F.lit(",".join(df.columns)).alias("fields"),
        F.lit(detect_column(df.columns, C.SEQUENCE_NAME_PARTS)).alias("sequence_column"),
        F.lit(detect_column(df.columns, label_parts)).alias("label_column"),
    )


def _absent(df: DataFrame, name: str) -> Column:
    col = F.col(f"`{name}`")
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return (col.isNull() | F.isnan(col)) if floating else col.isNull()


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values and their share for every column that has some, in one pass (CE3)."""
    names = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_absent(df, n)).alias(f"m_{i}") for i, n in enumerate(names)],
    )
    entries = [
        F.struct(F.lit(n).alias("column"), F.col(f"m_{i}").alias("missing"))
        for i, n in enumerate(names)
    ]
    rows = wide.select("_rows", F.explode(F.array(*entries)).alias("e"))
    return rows.filter(F.col("e.missing") > 0).select(
        "e.column", "e.missing", (100.0 * F.col("e.missing") / F.col("_rows")).alias("pct_missing")
    )


def numeric_stats(
    df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """count, mean, sample sd, min, max, median and quartiles of a column (CE4).

    Exact quantiles interpolate linearly; ``exact=False`` uses approximate ones in one pass.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    rows, keys = ranks.keyed(rows, by)
    aggs = [
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    ]
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    if not exact:
        aggs += [F.percentile_approx("_v", p).alias(n) for n, p in probs.items()]
        return rows.groupBy(*keys).agg(*aggs).select(*by, "count", "mean", "std", "min", "max", *probs)
    qs = ranks.quantiles(rows, "_v", probs, keys)
    out = join_keys(rows.groupBy(*keys).agg(*aggs), qs, keys)
    return out.select(*by, "count", "mean", "std", "min", "max", *probs)


def length_stats(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, min, max and median of text length (CE5)."""
    lengths = df.select(*by, F.length(F.col(text).cast("string")).alias("_len"))
    return numeric_stats(lengths, "_len", by).select(*by, "mean", "std", "min", "max", "median")


def patterns(df: DataFrame, text: str, key: str) -> DataFrame:
    """How many texts match each notation pattern, with the first example by ``key`` (CE6)."""
    t = F.col(text)
    aggs = []
    for name, regex in PATTERNS.items():
        hit = t.rlike(regex)
        aggs.append(
            F.struct(
                F.lit(name).alias("pattern"),
                F.count_if(hit).alias("n"),
                F.min_by(t, F.when(hit, F.col(key))).alias("example"),
            )
        )
    row = df.filter(t.isNotNull()).agg(F.array(*aggs).alias("_p"))
    return row.select(F.explode("_p").alias("e")).select("e.pattern", "e.n", "e.example")


def first_records(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` records by key (CE7)."""
    return df.orderBy(key).limit(n)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values after the first of each kind; NULL counts as one value (CE8)."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    return sizes.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"))


def outliers(df: DataFrame, value: str, sds: float = 3.0) -> DataFrame:
    """Values further than ``sds`` sample standard deviations from the mean (CE9)."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("_v"), F.lit(0).alias("_all"))
    moments = rows.groupBy("_all").agg(
        F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"), F.count("_v").alias("n_values")
    )
    far = F.abs(F.col("_v") - F.col("_m")) > F.lit(sds) * F.col("_s")
    # One row on the right: it is broadcast by size.
    return rows.join(F.broadcast(moments), "_all").agg(
        F.count("_v").alias("n_values"), F.count_if(far).alias("n_outliers")
    )


def pair_potential(df: DataFrame, text: str) -> DataFrame:
    """Total and unique texts and the number of same-length pairs (CE10).

    Texts are collapsed to distinct ones first, so the shuffle carries each text once.
    """
    sizes = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    lengths = sizes.groupBy(F.length("_t").alias("_len")).agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_u")
    )
    return lengths.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_sequences"),
        F.coalesce(F.sum("_u"), F.lit(0)).alias("unique_sequences"),
        F.coalesce(F.sum((F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint")), F.lit(0)).alias(
            "rough_potential_pairs"
        ),
    )


def length_histogram(df: DataFrame, text: str) -> DataFrame:
    """Rows per text length (CE10)."""
    rows = df.filter(F.col(text).isNotNull())
    return rows.groupBy(F.length(text).alias("length")).agg(F.count(F.lit(1)).alias("n"))


