"""Two-sided 95% Student t quantile as a Spark expression on the degrees of freedom."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_LIMIT = 60


def _central_mass(t: float, df: int) -> float:
    """P(|T| < t) for an integer number of degrees of freedom (finite trigonometric sum)."""
    theta = math.atan(t / math.sqrt(df))
    cos, sin = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = cos, cos if df > 1 else 0.0
        for k in range(3, df - 1, 2):
            term *= cos * cos * (k - 1) / k
            total += term
        return 2.0 / math.pi * (theta + sin * total)
    term = total = 1.0
    for k in range(2, df - 1, 2):
        term *= cos * cos * (k - 1) / k
        total += term
    return sin * total


@lru_cache(maxsize=None)
def t_975(df: int) -> float:
    """0.975 quantile for integer ``df`` by bisection."""
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if _central_mass(mid, df) < 0.95:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_975_column(df: Column) -> Column:
    """Exact up to ``TABLE_LIMIT`` degrees of freedom, Cornish-Fisher expansion beyond."""
    z = 1.959963984540054
    v = df.cast("double")
    tail = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / v
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (v * v)
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (v * v * v)
        + F.lit((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
        / (v * v * v * v)
    )
    exact = F.array(*[F.lit(t_975(k)) for k in range(1, TABLE_LIMIT + 1)])
    return (
        F.when(df < 1, F.lit(None).cast("double"))
        .when(df <= TABLE_LIMIT, F.get(exact, (df - 1).cast("int")))
        .otherwise(tail)
    )
