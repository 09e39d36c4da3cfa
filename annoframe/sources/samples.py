"""Read and write annotated samples as JSON Lines or Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.session import shared_folder
from annoframe.sources.schema import FLAT_COLUMNS, NESTED_DDL, SAMPLE_DDL

CORRUPT = "_corrupt_record"
SPLITS = ("train", "val", "test")


def read_samples_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with the sample schema (IO1); blank lines are skipped and unreadable lines are
    kept in ``_corrupt_record``."""
    schema = f"{SAMPLE_DDL}, {CORRUPT} string"
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, unreadable lines) of ``read_samples_json``."""
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_samples_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """JSON Lines, one sample per line (IO2), in compressed files; ``none`` writes plain text."""
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


def to_flat(df: DataFrame) -> DataFrame:
    """The 13-column layout with nested fields as JSON text (IO4); a NULL becomes ``null``."""
    cols = []
    for name in FLAT_COLUMNS:
        if name.endswith("_json"):
            col = F.to_json(F.col(name[: -len("_json")]), {"ignoreNullFields": "false"})
            cols.append(F.coalesce(col, F.lit("null")).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def from_flat(df: DataFrame) -> DataFrame:
    """Nested samples from the flat layout (IO3); the text ``null`` reads as NULL."""
    cols = []
    for name in FLAT_COLUMNS:
        if name.endswith("_json"):
            field = name[: -len("_json")]
            text = F.when(F.col(name) != "null", F.col(name))
            cols.append(F.from_json(text, NESTED_DDL[field]).alias(field))
        elif name == "label":
            cols.append(F.col(name).cast("double").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def read_samples_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet in the native or the flat layout (IO3)."""
    df = spark.read.parquet(path)
    return from_flat(df) if "edits_json" in df.columns else df


def write_samples_parquet(df: DataFrame, path: str, nested: str = "json", mode: str = "overwrite"):
    """Parquet with nested fields as JSON text or as native columns (IO4)."""
    if nested not in ("json", "native"):
        raise ValueError(f"nested must be 'json' or 'native', got {nested!r}")
    (to_flat(df) if nested == "json" else df).write.mode(mode).parquet(path)


def write_both(df: DataFrame, folder: str, name: str) -> dict[str, int]:
    """Both formats from one evaluation, with the row counts written (IO5)."""
    # A checkpoint would keep the rows uncompressed, several times the size of both formats.
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/annoframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    once = spark.read.schema(df.schema).parquet(path)
    write_samples_json(once, f"{folder}/{name}.jsonl")
    write_samples_parquet(once, f"{folder}/{name}.parquet")
    n = once.count()
    return {"jsonl": n, "parquet": n}


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix (IO6); an unknown one is an error, and so is any line that cannot be read.

    ``readable(read_samples_json(...))`` gives good and bad lines apart.
    """
    if path.endswith((".jsonl", ".json")):
        lines = read_samples_json(spark, path)
        # A column of its own has to be read along with the unreadable lines.
        bad = lines.agg(F.count(CORRUPT), F.count("sample_id")).first()[0]
        if bad:
            raise ValueError(f"{bad} lines of {path} cannot be read")
        return readable(lines)[0]
    if path.endswith(".parquet"):
        return read_samples_parquet(spark, path)
    raise ValueError(f"unknown sample format: {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Train, val and test sets of a folder with a ``split`` column (IO7); Parquet first, then
    JSON Lines."""
    out = None
    for name in SPLITS:
        paths = [f"{folder}/{name}.parquet", f"{folder}/{name}.jsonl"]
        path = next((p for p in paths if _exists(spark, p)), None)
        if path is None:
            raise FileNotFoundError(f"no split file: tried {paths}")
        part = read_samples(spark, path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
