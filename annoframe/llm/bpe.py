"""Byte-level BPE over a rank file: a minimal perfect hash for known pre-tokens, a heap for the others.

Each match of the pattern is encoded by itself. A match that is in the vocabulary as a whole is one
id: by the rules of BPE every entry merges up to itself, which the constructor verifies, and a
minimal perfect hash over the entries gives its rank (``PerfectHash``). Other matches start as single
bytes in a linked list; a heap holds the neighbouring pairs that can merge, lowest rank first.
Matches are found in distinct chunks of the texts only (``tokens.Coder``).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.llm import runtime, tokens
from annoframe.llm.spans import hash_spans, mix, ranges, slices

_STEP = np.uint64(0xD6E8FEB86659FD93)


class PerfectHash:
    """n different 64-bit names to the numbers 0 .. n - 1, without gaps: hash, displace.

    Names fall into buckets; from the fullest on, a bucket takes the first displacement that sends
    all its names to free places. A bucket of one name is sent to a free place directly.
    """

    def __init__(self, names: np.ndarray, values: np.ndarray, load: int = 3):
        n = len(names)
        if len(np.unique(names)) != n:
            raise ValueError("names repeat")
        self.n, self.buckets = n, max(1, n // load)
        self.seed = np.zeros(self.buckets, np.int64)
        self.names, self.values = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        bucket = (names % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(at), kind="stable"):
            own = order[at[b] : at[b + 1]]
            if len(own) < 2:
                break
            k, tries = 0, 16
            while True:
                places = self._place(names[own][None, :], (k + np.arange(tries))[:, None])
                good = free[places].all(axis=1)
                good[good] = (np.diff(np.sort(places[good], axis=1)) > 0).all(axis=1)
                if good.any():
                    k += int(np.argmax(good))
                    place = places[int(np.argmax(good))]
                    break
                k, tries = k + tries, min(2 * tries, 4096)
            free[place] = False
            self.seed[b] = k
            self.names[place], self.values[place] = names[own], values[own]
        single = np.flatnonzero(np.diff(at) == 1)
        place, own = np.flatnonzero(free), order[at[single]]
        self.seed[single] = -1 - place
        self.names[place], self.values[place] = names[own], values[own]

    def _place(self, names: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
        return (mix(names + np.asarray(seed).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The value of each name, -1 for names that it was not built from."""
        if not self.n:
            return np.full(len(names), -1)
        seed = self.seed[(names % np.uint64(self.buckets)).astype(np.int64)]
        place = np.where(seed < 0, -1 - seed, self._place(names, np.maximum(seed, 0)))
        return np.where(self.names[place] == names, self.values[place], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost first among equals."""
    n = len(piece)
    end, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if gone[i] or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], gone[middle] = stop, 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def spans_of(pieces: list[bytes]) -> np.ndarray:
    """Names of some byte strings."""
    end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    return hash_spans(buf, np.concatenate([[0], end[:-1]]), end)


class Vocabulary:
    """A rank file with its perfect hash, its decoding table, and a coder for a pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pieces, ids = list(self.ranks), np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        whole = np.fromiter((len(merge(p, self.ranks)) == 1 for p in pieces), bool, len(pieces))
        self.hash = PerfectHash(spans_of(pieces)[whole], ids[whole])
        size = np.zeros(int(ids.max()) + 1, np.int64)
        size[ids] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        by_id = sorted(self.ranks, key=self.ranks.__getitem__)
        self.bytes, self.size, self.start = np.frombuffer(b"".join(by_id), np.uint8), size, np.cumsum(size) - size
        self.split = regex.compile(pattern).findall
        self.coder = tokens.Coder(self._encode)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        split = [[m.encode() for m in self.split(c)] for c in chunks]
        flat = [p for ps in split for p in ps]
        found = self.hash.find(spans_of(flat)).tolist()
        missed: dict[bytes, list[int]] = {}
        out, k = [], 0
        for ps in split:
            ids: list[int] = []
            for p in ps:
                if found[k] >= 0:
                    ids.append(found[k])
                else:
                    if p not in missed:
                        missed[p] = merge(p, self.ranks)
                    ids += missed[p]
                k += 1
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids."""
        size = self.size[ids]
        data = self.bytes[ranges(self.start[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file; one for each worker, file and pattern."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an ``array<int>`` of the ids of every whole text (null: empty).

    All columns stay; ``out_col`` must be a new name. Special strings are ordinary text.
    """
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} is there already")
    runtime.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for x in slices(batch.column(at)):
                ids, first = v.coder(x)
                column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                part = batch.slice(x.first, x.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of each row's ids (null: none), as ``binary``: ids may end within a character."""
    if out_col in rows.columns:
        raise ValueError(f"column {out_col} is there already")
    runtime.ship(rows.sparkSession)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(at).fill_null([])
            ids, first = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            column = pa.array(v.decode(ids, first), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes within one task, keeping digests only."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for x in slices(batch.column(1)):
                ids, first = v.coder(x)
                hexes = [hashlib.sha256(np.ascontiguousarray(ids[a:b], "<u4")).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                back = [hashlib.sha256(b).hexdigest() for b in v.decode(ids, first)]
                columns = [batch.column(0).slice(x.first, x.rows), pa.array(np.diff(first)), pa.array(hexes), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
