"""Best-fit packing of token sequences with a bounded number of open bins.

Whole documents become pieces of at most ``capacity`` ids; only longer documents are cut. Full
pieces are sequences of their own. The rest is packed online: each task takes pieces as they come,
puts each into the open sequence with the least free space that is enough, and opens a new sequence
if there is none. Open sequences are kept by free space, with a bit set of the free spaces in use, so
that the best fit is one shift and one lowest bit. When the fixed number of open sequences is
exceeded, the fullest one closes. A task's memory is that number, whatever the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import runtime, tokens
from annoframe.llm.spans import ranges, slices

CAPACITY = 4096
OPEN_BINS = 4096
#: Pieces that one packing task takes; each task leaves at most ``OPEN_BINS`` sequences partly filled.
PIECES_PER_TASK = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open sequences by free space; ``put`` gives the number and offset where a piece goes."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: dict[int, list[int]] = {}
        self.bits = self.count = self.opened = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = tokens.library_coder(path)
    for batch in batches:
        for x in slices(batch.column(1)):
            ids, first = tokens.with_end(*coder(x), end_id)
            size = np.diff(first)
            count = -(-size // capacity)
            row = np.repeat(np.arange(x.rows), count)
            piece = ranges(np.zeros(x.rows, np.int64), count)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = first[row] + start
            columns = [
                batch.column(0).take(pa.array(x.first + row)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array([tokens.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, vocabulary: str, *, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and ``end_id``, cut at ``capacity``.

    A null text is empty and gives one piece, the end id. Rows are taken as they are: repeated ids
    give repeated pieces. Other columns are not read.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(lambda batches: _pieces(batches, vocabulary, end_id, capacity, with_ids), schema)


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    bins = Bins(capacity, open_bins)
    for batch in batches:
        placed = [bins.put(n) for n in batch.column("length").to_pylist()]
        number = np.array([p[0] for p in placed], np.int64) | (np.int64(part + 1) << 40)
        offset = np.array([p[1] for p in placed], np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])


def pack(parts: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Offsets are gapless from 0 in each sequence, and no sequence is longer than ``capacity``. Pieces
    come in an order hashed from their keys, so that a task that is run again packs the same way and
    long and short ones are mixed. The number of tasks follows from the number of pieces alone.
    """
    runtime.ship(parts.sparkSession)
    parts = runtime.table(parts)  # ids are made once, not for the count and again for packing
    full = F.col("length") >= capacity
    rest = parts.filter(~full)
    tasks = max(1, -(-rest.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "length")
    schema = parts.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    packed = (
        rest.repartition(tasks, F.pmod(order, F.lit(1 << 20)))
        .sortWithinPartitions(order, *[c for c in ("doc_id", "piece", "length") if c in parts.columns])
        .mapInArrow(lambda batches: _packed(batches, capacity, open_bins), schema)
    )
    alone = parts.filter(full).withColumns({"sequence_id": F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def best_fit(docs: DataFrame, vocabulary: str, *, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids."""
    return pack(pieces(docs, vocabulary, end_id=end_id, capacity=capacity, with_ids=with_ids), capacity=capacity, open_bins=open_bins, pieces_per_task=pieces_per_task)
