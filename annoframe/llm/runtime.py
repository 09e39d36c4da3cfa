"""Tables that cut lineage, and sizes that follow the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.session import shared_folder, ship  # noqa: F401  (ship: for the operators)

def folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def table(df: DataFrame, spent: list[str] | None = None, *, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it: whatever is lost later, this stays.

    The path is added to ``spent``, if given, for ``remove`` when nothing reads it any more.
    """
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    if spent is not None:
        spent.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, spent: list[str]) -> None:
    """Delete tables that no lazy result reads."""
    for name in spent:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spent.clear()


def groups_for(docs: DataFrame, text: str, bytes_per_group: int) -> int:
    """How many groups keep each near ``bytes_per_group`` of text: one more pass over the texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-int(total) // bytes_per_group))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of ``docs``: the columns themselves where they fit, so that equal plans stay equal."""
    same = id_col == "doc_id" and text_col == "text" and docs.schema[id_col].dataType.typeName() == "long"
    return docs.select("doc_id", "text") if same else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
