"""Deterministic randomness: every draw is a hash of a seed and row keys.

The result does not depend on partitioning or task order, survives recomputation, and can be
reproduced by any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 60 bits, so that draws reach every row of any table.
SPACE = 1 << 60


def unit(seed: int | str, *keys: Column | str) -> Column:
    """A uniform integer in [0, 2**60) drawn from ``seed`` and ``keys``."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def below(limit: Column | int, seed: int | str, *keys: Column | str) -> Column:
    """A uniform integer in [0, limit)."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.pmod(unit(seed, *keys), limit)
