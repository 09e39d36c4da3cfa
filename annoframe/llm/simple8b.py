"""Token-id files: Simple-8b words in blocks, written in document order and read back block-wise.

Format (version 1). A file is a Parquet file whose rows are segments; rows and files are in ascending
order of documents. Parquet is only the container: it brings task-wise commit, so that a lost or
repeated task leaves no half file, and it can be written to and read from any store.

============  ======  ==========================================================================
column        type    meaning
============  ======  ==========================================================================
part          int     number of the file in document order
base          long    ids of the file before this segment
doc_id        long[]  documents of the segment, in order; a document is never split over segments
n_tokens      long[]  ids of each document
block_at      int[]   first word of each block of ``BLOCK`` ids, and the end; the last block may be short
escape_at     int[]   first escape of each block, and the end
words         binary  little-endian 64-bit words
escapes       binary  little-endian 64-bit values that no selector holds
============  ======  ==========================================================================

The upper 4 bits of a word are its selector: selector s > 0 says how many values of how many bits the
lower 60 bits hold, the first value lowest. Selector 0 is an escape: the lower bits number an entry
of the block's ``escapes``. Blocks can be decoded on their own; all words of a segment with the same
selector are decoded by one vector operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.llm import runtime, tokens
from annoframe.llm.spans import slices

BLOCK = 1024
#: A segment ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 20
# Fixed values of the format: bits of each value by selector, from 1 on; 60 // bits values fit.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
SEGMENTS = "part int, base long, doc_id array<long>, n_tokens array<long>, block_at array<int>, escape_at array<int>, words binary, escapes binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, first word and first escape of each block (and the ends)."""
    values = np.asarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    grid = np.zeros(blocks * BLOCK + BLOCK, np.uint64)  # zeros fill the last word of a block
    grid[: len(values)] = values
    size = np.full(blocks, BLOCK)
    size[-1] = len(values) - (blocks - 1) * BLOCK
    # The best selector at each position if a word began there: the longest run that is narrow enough.
    need = np.searchsorted((np.uint64(1) << np.array(BITS, np.uint64)) - np.uint64(1), grid)
    best = np.zeros(len(grid), np.int8)
    row_end = np.append(np.repeat((np.arange(blocks) + 1) * BLOCK, BLOCK), np.full(BLOCK, (blocks + 1) * BLOCK))
    room = row_end - np.arange(len(grid))
    for s, bits in enumerate(BITS):
        wide = np.concatenate([[0], np.cumsum(need > s)])
        end = np.minimum(np.arange(len(grid)) + 60 // bits, row_end)
        fits = (wide[end] == wide[:-1]) & (room > 0) & (best == 0)
        best[fits] = s + 1
    # All blocks step from word to word together.
    jump = np.array([1, *(60 // b for b in BITS)])
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        where = live * BLOCK + at[live]
        found.append(where)
        at[live] += jump[best[where]]
        live = live[at[live] < size[live]]
    where = np.sort(np.concatenate(found))
    selector = best[where].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, bits in enumerate(BITS):
        mine = np.flatnonzero(selector == s + 1)
        if len(mine):
            n = 60 // bits
            cells = where[mine][:, None] + np.arange(n)
            inside = (cells // BLOCK) == (where[mine] // BLOCK)[:, None]
            held = np.where(inside, grid[np.minimum(cells, len(grid) - 1)], np.uint64(0))
            words[mine] |= np.bitwise_or.reduce(held << (np.arange(n, dtype=np.uint64) * np.uint64(bits)), axis=1)
    block = where // BLOCK
    escaped = np.flatnonzero(selector == 0)
    escape_at = np.searchsorted(block[escaped], np.arange(blocks + 1))
    words[escaped] = (np.arange(len(escaped)) - escape_at[block[escaped]]).astype(np.uint64)
    return words, grid[where[escaped]], np.searchsorted(block, np.arange(blocks + 1)), escape_at


def decode(words: np.ndarray, escapes: np.ndarray, block_at: np.ndarray, escape_at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of these blocks."""
    blocks = len(block_at) - 1
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([1, *(60 // b for b in BITS)])[selector]
    # A block's last word may hold more than is left; each block begins at its own place.
    total = np.concatenate([[0], np.cumsum(count)])
    lead = total[block_at[:-1]]
    block = np.repeat(np.arange(blocks), np.diff(block_at))
    place = total[:-1] - lead[block] + block * BLOCK
    out = np.zeros(blocks * BLOCK + 60, np.uint64)
    for s, bits in enumerate(BITS):
        mine = np.flatnonzero(selector == s + 1)
        if len(mine):
            k = 60 // bits
            held = (words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            cells = place[mine][:, None] + np.arange(k)
            inside = cells < ((block[mine] + 1) * BLOCK)[:, None]
            out[cells[inside]] = held[inside]
    mine = np.flatnonzero(selector == 0)
    out[place[mine]] = escapes[escape_at[block[mine]] + words[mine].astype(np.int64)]
    return out[:n]


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, base = (context.partitionId() if context else 0), 0
    coder = tokens.library_coder(path)
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        nonlocal base
        ids = np.concatenate(held)
        words, escapes, block_at, escape_at = encode(ids)
        row = [part, base, np.concatenate(docs), np.concatenate(sizes), block_at, escape_at, words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
        base += len(ids)
        docs.clear(), sizes.clear(), held.clear()
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["part", "base", "doc_id", "n_tokens", "block_at", "escape_at", "words", "escapes"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        key = np.array(batch.column(0).to_pylist(), dtype=object)
        for x in slices(batch.column(1)):
            ids, first = tokens.with_end(*coder(x), end_id)
            docs.append(key[x.first : x.first + x.rows])
            sizes.append(np.diff(first))
            held.append(ids)
            if sum(map(len, held)) >= SEGMENT_IDS:
                yield flush()
    if held:
        yield flush()


def write_ids(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), add ``end_id``, write the ids under ``path``.

    Documents go in ascending order of id (null first), repeated ids by a hash of the
    text. Only ids and texts are
    read; further columns are left alone. An empty table gives no segments.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")  # the sample of the range cuts goes to the driver: numbers, not texts
    (
        rows.repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie, "text")
        .mapInArrow(lambda batches: _segments(batches, vocabulary, end_id), SEGMENTS)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = np.array(row["n_tokens"], np.int64)
            block_at, escape_at = np.array(row["block_at"]), np.array(row["escape_at"])
            ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), block_at, escape_at, int(size.sum()))
            at = np.concatenate([[0], np.cumsum(size)])
            step = max(1, int(np.searchsorted(at, SEGMENT_IDS)))
            for i in range(0, len(size), step):
                j = min(i + step, len(size))
                columns = [[row["part"]] * (j - i), row["doc_id"][i:j], row["base"] + at[i:j], size[i:j]]
                if "ids_crc32" in schema.names:
                    columns.append([tokens.crc32(ids[at[k] : at[k + 1]]) for k in range(i, j)])
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(at[i : j + 1] - at[i], pa.int32()), pa.array(ids[at[i] : at[j]].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_ids(spark, path: str, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from files of ``write_ids``; with ``digest`` ids_crc32 instead of ids.

    ``start`` counts the ids of all documents before it: those of the earlier files, of which there
    is one number each, and those of the own file.
    """
    runtime.ship(spark)
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), last])
    files = spark.read.schema(SEGMENTS).parquet(path)
    found = files.mapInArrow(
        lambda batches: _documents(batches, schema),
        "part int, doc_id long, start_in_part long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"),
    )
    sizes = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each file that was written.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    start: Column = F.col("start_in_part") + F.col("before")
    return found.join(before, "part").select("doc_id", start.alias("start"), "n_tokens", last.name)
