"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null equal to null, keeping the left side's key columns.

    Still an equality join: Spark hashes null-safe keys like others.
    """
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys])
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])
