"""Columns of 64-bit numbers in binary cells, for rows that carry a whole batch's numbers for one group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first bytes, then all second bytes, ...: Spark's codec shortens that best."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(cell: bytes, kind: type = np.uint64) -> np.ndarray:
    """The numbers of a cell made by ``planes``."""
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def joined(cells: list[bytes], kind: type = np.uint64) -> np.ndarray:
    """The numbers of several cells, one after the other."""
    return np.concatenate([numbers(c, kind) for c in cells]) if cells else np.zeros(0, kind)


def group_of(names: np.ndarray, groups: int) -> np.ndarray:
    """The group of each 64-bit name: equal ranges of the name space."""
    return ((names >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """As ``planes``, and compressed, for numbers that are small or that are kept on disk too."""
    data = planes(values)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(cell: bytes, kind: type = np.uint64) -> np.ndarray:
    """The numbers of a cell made by ``packed``."""
    size = int.from_bytes(cell[:8], "little")
    return numbers(pa.decompress(cell[8:], size, codec="zstd", asbytes=True), kind)
