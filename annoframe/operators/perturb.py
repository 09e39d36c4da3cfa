"""Anchor perturbation controls: projections with hashed randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annoframe.functions import draws


def clamp(position: Column, length: Column) -> Column:
    """``position`` moved into [0, length - 1]."""
    return F.least(F.greatest(F.lit(0), position), length - 1)


def wrong_anchor(
    position: Column, length: Column, key: Column, seed: int = 42, reach: int = 5
) -> Column:
    """A different position at a random non-zero offset of at most ``reach`` (PE1).

    Offsets are put in hash order and the first that stays inside is used. If none does, the far
    end is used.
    """
    offsets = [d for d in range(-reach, reach + 1) if d]
    options = F.array(
        *[
            F.struct(
                draws.unit(seed, key, position, F.lit(d)).alias("u"), (position + d).alias("p")
            )
            for d in offsets
        ]
    )
    inside = F.array_sort(F.filter(options, lambda o: (o["p"] >= 0) & (o["p"] < length)))
    far = F.when(position < F.floor(length / 2), length - 1).otherwise(F.lit(0))
    return F.coalesce(F.get(inside, F.lit(0))["p"], far).cast("int")


def tertile(position: Column, length: Column) -> Column:
    """Centre of the third of the sequence that holds the position (PE2)."""
    third = F.floor(length / 3)
    half = F.floor(third / 2)
    centre = (
        F.when(position < third, half)
        .when(position < 2 * third, third + half)
        .otherwise(2 * third + half)
    )
    return clamp(centre, length).cast("int")


def noise(position: Column, length: Column, key: Column, seed: int = 42, reach: int = 3) -> Column:
    """Position moved by a hashed integer in -reach..reach, zero allowed, clamped (PE3)."""
    step = draws.below(2 * reach + 1, f"{seed}:noise", key, position) - reach
    return clamp(position + step, length).cast("int")


def shift(position: Column, length: Column, distance: int) -> Column:
    """Position moved by a fixed distance and clamped; 0 leaves it alone (PE4)."""
    return position if distance == 0 else clamp(position + distance, length)


def perturb_anchors(anchors: Column, change) -> Column:
    """Apply a position change to every entry of an explicit-anchor array."""
    return F.transform(anchors, lambda a: F.struct(change(a["position"]).alias("position"), a["text"].alias("text")))
