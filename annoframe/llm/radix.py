"""Stable radix order of numpy columns: counting passes over 16-bit digits, least significant first."""

from __future__ import annotations

import numpy as np

DIGIT_BITS = 16
_MASK = np.uint64((1 << DIGIT_BITS) - 1)


def digit(values: np.ndarray, shift: int) -> np.ndarray:
    """The 16-bit digit of unsigned numbers at ``shift``."""
    return ((values >> np.uint64(shift)) & _MASK).astype(np.uint16)


def order(*columns: np.ndarray) -> np.ndarray:
    """The stable order by unsigned ``columns``, the first one the most significant.

    numpy sorts 16-bit numbers by counting; digits that are the same in all rows cost no pass.
    """
    out = np.arange(len(columns[0]))
    if not len(out):
        return out
    for values in reversed(columns):
        values = values.astype(np.uint64, copy=False)
        varies = int(np.bitwise_or.reduce(values ^ values[0]))
        for shift in range(0, 64, DIGIT_BITS):
            if (varies >> shift) & int(_MASK):
                out = out[np.argsort(digit(values, shift)[out], kind="stable")]
    return out


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in columns that are in order."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for values in columns:
        new[1:] |= values[1:] != values[:-1]
    return new
