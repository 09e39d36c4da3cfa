"""Importance resampling of documents towards a target, by hashed n-gram features.

*Weights.* Features are the runs of 1 to ``n`` words of a text; a feature's bucket is the crc32 of its bytes modulo
``buckets``. crc32 is linear, so a run's crc comes from those of its words: the bytes of a word are taken one position
at a time for all words of a slice, and a table for each word length moves a run's crc over the next word. Bucket counts
of corpus and target are added up in tasks, then by Spark; the gains are one array of ``buckets`` numbers, which scores all
features of a document at once.

*Draw.* A document's score is its weight plus Gumbel noise from a hash of its id. The ranks come from a distributed
least-significant-digit radix sort of the key (score falling, id rising). Rows lie at positions, in blocks of ``BLOCK_ROWS``
positions. A pass counts each block's digits; running sums over (digit, block) give the place where a block's rows of
a digit begin, and a stable counting sort inside the block gives the rest. Rows then move to the block of their new
position: blocks are equally large however the keys are distributed. The number of passes follows the range of
the keys. After the last pass the position is the rank.

Null texts have no words. A null id has no noise: its score and rank are null, and it counts for nothing in the draw, but
its text counts in the corpus. Rows of one id and score are ranked one after the other, those with fewer features first. An
empty table gives no rows; an empty target gives all features gains against zero counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoframe.llm import radix, runtime
from annoframe.llm.spans import SMALL_SLICE, Texts, lower, rows_of, runs, slices

BUCKETS = 10_000
NGRAM = 2
LEAST_WORDS = 20
#: Rows of one block of the sort: what a task holds at a time.
BLOCK_ROWS = 1 << 17
#: Longer words go through zlib one by one.
LONG_WORD = 64

# Words of a lower-cased text: 0-9, a-z and bytes from 0x80 on.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


@lru_cache(maxsize=4096)
def _shift_table(length: int) -> np.ndarray:
    """What each byte of a crc register becomes after ``length`` zero bytes: (4, 256)."""
    table = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(length):
        table = (table >> np.uint32(8)) ^ _byte_table()[table & np.uint32(255)]
    return table


def _registers(buf: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The crc register after each span's bytes, from the registers ``begin``."""
    out, table = begin.copy(), _byte_table()
    near = np.flatnonzero(length <= LONG_WORD)
    # Longest first, so that the words that still have a byte are a leading part.
    near = near[np.argsort(-length[near], kind="stable")]
    register, at, falling = out[near], start[near], -length[near]
    for k in range(int(-falling[0]) if len(near) else 0):
        left = int(np.searchsorted(falling, -k, side="left"))
        r = register[:left]
        register[:left] = (r >> np.uint32(8)) ^ table[(r ^ buf[at[:left] + k]) & np.uint32(255)]
    out[near] = register
    for i in np.flatnonzero(length > LONG_WORD):
        # zlib inverts the register before and after.
        data = buf[start[i] : start[i] + length[i]].tobytes()
        out[i] = zlib.crc32(data, int(begin[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def feature_buckets(x: Texts, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature of the rows, its row, and each row's number of words."""
    x = Texts(lower(x.buf), x.at, x.first)
    start, end, first = runs(x, _WORD)
    row, length = rows_of(first, len(start)), end - start
    ones = np.full(len(start), 0xFFFFFFFF, np.uint32)
    crc = _registers(x.buf, start, length, ones)
    found, owner = [crc], [row]
    if n > 1 and len(start) > 1:
        # A word after a space, from a register of zeros: what it adds to any register that is moved over it.
        space = np.full(len(start), _byte_table()[32], np.uint32)
        added = _registers(x.buf, start, length, space)
        for k in range(1, n):
            later = np.flatnonzero(row[k:] == row[:-k]) + k
            before, moved = found[-1][later - 1 if k == 1 else np.searchsorted(at, later - 1)], np.zeros(len(later), np.uint32)
            size = length[later] + 1
            for s in np.unique(size[size <= LONG_WORD + 1]).tolist():
                same = np.flatnonzero(size == s)
                table, r = _shift_table(s), before[same]
                moved[same] = table[0][r & np.uint32(255)] ^ table[1][(r >> np.uint32(8)) & np.uint32(255)] ^ table[2][(r >> np.uint32(16)) & np.uint32(255)] ^ table[3][r >> np.uint32(24)]
            out = moved ^ added[later]
            for i in np.flatnonzero(size > LONG_WORD + 1):
                data = b" " + x.buf[start[later[i]] : end[later[i]]].tobytes()
                out[i] = zlib.crc32(data, int(before[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            found.append(out)
            owner.append(row[later])
            at = later
    crc = np.concatenate(found) ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate(owner), np.diff(first)


def bucket_counts(docs: DataFrame, text_col: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in slices(batch.column(0), SMALL_SLICE):
                total += np.bincount(feature_buckets(x, n, buckets)[0], minlength=buckets)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], ["bucket", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of each bucket's smoothed share in the target over that in the source)."""
    b, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, *, id_col: str, text_col: str, n: int, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score): the floored mean gain, and with noise from the id."""
    spark, buckets = docs.sparkSession, len(gain)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch.column(1), SMALL_SLICE):
                cell, row, n_words = feature_buckets(x, n, buckets)
                size = np.bincount(row, minlength=x.rows)
                total = np.zeros(x.rows, np.int64)
                np.add.at(total, row, shared.value[cell])
                found = (size, n_words, total // np.maximum(size, 1))
                part = batch.column(0).slice(x.first, x.rows)
                yield pa.RecordBatch.from_arrays([part, *(pa.array(c.astype(np.int64)) for c in found)], ["doc_id", "n_features", "n_words", "weight"])

    rows = runtime.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def _passes(low: int, high: int) -> list[int]:
    """Shifts of the 16-bit digits of keys ``low`` to ``high``, taken less ``low``."""
    return list(range(0, max(int(high - low).bit_length(), 1), radix.DIGIT_BITS))


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (all columns long, none null) with ``position``, from 0, by ``keys`` (column, falling), the most significant first."""
    spark = rows.sparkSession
    runtime.ship(spark)
    columns = rows.columns
    ends = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c, _ in keys for name, f in (("min", F.min), ("max", F.max)))).first()
    if not ends.n:
        return rows.withColumn("position", F.lit(None).cast("long"))
    plan = [(c, falling, int(ends[f"min_{c}"]), int(ends[f"max_{c}"]), s) for c, falling in reversed(keys) for s in _passes(ends[f"min_{c}"], ends[f"max_{c}"])]
    at = {c: i for i, c in enumerate(columns)}

    def digits(i: int, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        column, falling, low, high, shift = plan[i]
        value = np.asarray(table.column(at[column]))
        # Differences in unsigned arithmetic hold for any two 64-bit numbers.
        value = np.uint64(high % (1 << 64)) - value.astype(np.uint64) if falling else value.astype(np.uint64) - np.uint64(low % (1 << 64))
        return radix.digit(value, shift)

    def begins(i: int, df: DataFrame, spent: list[str]) -> DataFrame:
        """(block, digit, begin): where the rows of a block with a digit begin in the next order."""

        def sent(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for block, n in total.items():
                d = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), block), pa.int32()), pa.array(d, pa.int32()), pa.array(n[d])], ["block", "digit", "n"])
            total.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                d, b = digits(i, batch), np.asarray(batch.column(len(columns) + 1))
                for block in np.unique(b).tolist():
                    total[block] = total.get(block, 0) + np.bincount(d[b == block], minlength=1 << radix.DIGIT_BITS)
                if len(total) > 64:
                    yield from sent(total)
            yield from sent(total)

        counted = df.mapInArrow(run, "block int, digit int, n long").groupBy("block", "digit").agg(F.sum("n").alias("n"))
        counted = runtime.table(counted, spent)
        # At most 65,536 digits, whatever the input is.
        before = counted.groupBy("digit").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("digit")) - F.col("all"))
        running = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
        return counted.withColumn("begin", running).join(before.select("digit", "before"), "digit").select("block", "digit", (F.col("begin") + F.col("before")).alias("begin"))

    def moved(i: int, df: DataFrame, begin: DataFrame) -> DataFrame:
        """The rows with their place in the next order, and the block of it."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            # Counting sort of the block's rows, in the order they have, by the digit.
            order = np.argsort(np.asarray(left.column(len(columns))), kind="stable")
            d = digits(i, left)[order]
            again = np.argsort(d, kind="stable")
            order, d = order[again], d[again]
            first = np.zeros(1 << radix.DIGIT_BITS, np.int64)
            first[np.asarray(right.column("digit"))] = np.asarray(right.column("begin"))
            position = first[d] + np.arange(len(d)) - np.searchsorted(d, d)
            rest = left.select(columns).take(pa.array(order))
            return pa.Table.from_arrays([*rest.columns, pa.array(position), pa.array(position // block_rows, pa.int32())], [*columns, "position", "block"])

        schema = ", ".join([*(f"{c} long" for c in columns), "position long", "block int"])
        return df.groupBy("block").cogroup(begin.groupBy("block")).applyInArrow(run, schema)

    # Any first order will do: rows equal in all keys may change places.
    blocks = -(-int(ends.n) // block_rows)
    spent: list[str] = []
    number = F.monotonically_increasing_id()
    current = runtime.table(rows.select(*columns, number.alias("position")).withColumn("block", F.pmod("position", F.lit(blocks)).cast("int")), spent)
    for i in range(len(plan)):
        old, spent = spent, []
        placed = moved(i, current, begins(i, current, old))
        current = runtime.table(placed, spent)
        runtime.remove(spark, old)
    return current.select(*columns, "position")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = 25,
    seed: int = 7,
    n: int = NGRAM,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; the floor of ``percent`` % of the rows with ``least_words`` words that
    score highest have a rank, from 1, the others none."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text, n, buckets))
    scored = runtime.table(weights(docs, gain, id_col=id_col, text_col=text_col, n=n, seed=seed))
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    open_ = scored.filter(may).select("doc_id", "n_features", "weight", "score")
    drawn = percent * open_.count() // 100
    placed = ranked(open_, [("score", True), ("doc_id", False), ("n_features", False)])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    rest = scored.filter(~may).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).union(rest)
