"""Spearman of all replicates of a grouped bootstrap from one ordering of the rows.

A replicate only changes how often a row counts. Every group therefore carries the vector of its multiplicities, one number
for each replicate of a block, and so does every distinct value: the sum over its rows. Prefix sums of these vectors in
the order of values give a value's weighted mid-rank in all replicates at once; rows are put in order once, not once for each
replicate. Values lie in order-preserving buckets: totals of buckets are added up first, then the inside of each bucket.
A row's two rank vectors meet by value, and the sums of their products are added up in tasks.

Where a key has few groups, no vector of replicates is needed: a row's rank in a replicate is 1/2 plus the sum over groups of
the group's multiplicity times the group's rows before the value, half of those at it. The sums of products over all
rows are therefore cubic forms in the multiplicities, and their coefficients, one for each three groups, take one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.functions.joins import join_keys
from annoframe.operators import ranks
from annoframe.session import settle, ship

#: Replicates that travel as one vector.
BLOCK = 128
#: Groups of a key up to which the sums are cubic forms in the multiplicities.
FEW = 64
#: Distinct (value, group) rows in a bucket: the vectors of so many are one task's matrix.
BUCKET_ROWS = 8192


def _vectors(cells: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Binary cells of one length as the rows of a matrix."""
    return np.stack([np.frombuffer(c.as_buffer(), kind) for c in cells]) if len(cells) else np.zeros((0, BLOCK), kind)


def _cells(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _multiplicities(picks: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """(keys, group, _block, mult): how often a group counts in each replicate of a block."""
    ship(picks.sparkSession)
    rows = picks.select(*keys, group, F.floor((F.col("replicate") - 1) / BLOCK).cast("int").alias("_block"), F.pmod(F.col("replicate") - 1, F.lit(BLOCK)).alias("_at"), "multiplicity")
    lists = rows.groupBy(*keys, group, "_block").agg(F.collect_list(F.struct(F.col("_at").cast("int").alias("at"), F.col("multiplicity").cast("double").alias("n"))).alias("_of"))
    schema = T.StructType([*lists.schema.fields[:-1], T.StructField("mult", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(batch.num_columns - 1)
            at = np.diff(np.asarray(part.offsets))
            flat = part.flatten()
            matrix = np.zeros((len(at), BLOCK))
            matrix[np.repeat(np.arange(len(at)), at), np.asarray(flat.field("at"))] = np.asarray(flat.field("n"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _cells(matrix)], schema.names)

    return settle(lists.mapInArrow(run, schema))


def _ranks(values: DataFrame, keys: list[str], group: str, mult: DataFrame, value: str) -> DataFrame:
    """(keys, value, _block, rank, weight): weighted mid-ranks of each distinct value, and how often it counts."""
    rows = ranks.with_bucket(values, keys, value, bucket_rows=BUCKET_ROWS)
    rows = join_keys(rows, mult, [*keys, group]).select(*keys, "_block", "_bucket", value, F.col("_c").cast("double").alias("_c"), "mult")
    rows = settle(rows)
    by = [*keys, "_block", "_bucket"]
    kinds = {f.name: f for f in rows.schema.fields}
    total_schema = T.StructType([kinds[c] for c in by] + [T.StructField("_total", T.BinaryType())])
    schema = T.StructType([kinds[c] for c in [*keys, "_block", value]] + [T.StructField("rank", T.BinaryType()), T.StructField("weight", T.BinaryType())])
    k = len(by)

    def key_columns(batch: pa.RecordBatch, n: int, columns: Sequence[int]) -> list[pa.Array]:
        return [pa.concat_arrays([batch.column(i).slice(0, 1)]).take(pa.array(np.zeros(n, np.int64))) for i in columns]

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK)
        for batch in batches:
            total += np.asarray(batch.column(k + 1)) @ _vectors(batch.column(k + 2))
            last = batch
        yield pa.RecordBatch.from_arrays([*key_columns(last, 1, range(k)), _cells(total[None])], total_schema.names)

    def running(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One vector for each bucket of a key.
        table = pa.Table.from_batches(list(batches)).sort_by("_bucket").combine_chunks().to_batches()[0]
        matrix = _vectors(table.column(k))
        yield pa.RecordBatch.from_arrays([*table.columns[:k], _cells(np.cumsum(matrix, axis=0) - matrix)], total_schema.names)

    def inside(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        before = np.frombuffer(right.column(k)[0].as_buffer())
        v, c = np.asarray(left.column(k)), np.asarray(left.column(k + 1))
        order = np.argsort(v, kind="stable")
        first = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
        cells = left.column(k + 2).combine_chunks()
        weight = np.zeros((len(first), BLOCK))
        which = np.empty(len(v), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        for i in range(0, len(v), 4096):
            np.add.at(weight, which[i : i + 4096], _vectors(cells.slice(i, 4096)) * c[i : i + 4096, None])
        rank = before + np.cumsum(weight, axis=0) - weight + (weight + 1) / 2
        batch = left.combine_chunks().to_batches()[0]
        names = [batch.schema.get_field_index(f) for f in [*keys, "_block"]]
        return pa.Table.from_arrays([*key_columns(batch, len(first), names), pa.array(v[order][first]), _cells(rank), _cells(weight)], schema.names)

    totals = rows.groupBy(*by).applyInArrow(summed, total_schema)
    before = totals.groupBy(*keys, "_block").applyInArrow(running, total_schema)
    return rows.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(inside, schema)


def _standing(values: DataFrame, keys: list[str], value: str, width: int, name: str) -> DataFrame:
    """(keys, value, ``name``): of each distinct value, the rows of every group before it and half of those at it."""
    rows = ranks.with_bucket(values, keys, value, bucket_rows=BUCKET_ROWS).select(*keys, "_bucket", value, "_g", "_c")
    rows = settle(rows)
    by, k = [*keys, "_bucket"], len(keys) + 1
    kinds = {f.name: f for f in rows.schema.fields}
    before_schema = T.StructType([kinds[c] for c in by] + [T.StructField("_before", T.BinaryType())])
    schema = T.StructType([kinds[c] for c in [*keys, value]] + [T.StructField(name, T.BinaryType())])

    def running(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row for each bucket and group of a key.
        table = pa.Table.from_batches(list(batches)).sort_by("_bucket").combine_chunks().to_batches()[0]
        first = np.flatnonzero(np.r_[True, np.diff(np.asarray(table.column("_bucket"))) != 0])
        matrix = np.zeros((len(first), width))
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        matrix[at, np.asarray(table.column("_g"))] = np.asarray(table.column("_n"))
        cells = _cells(np.cumsum(matrix, axis=0) - matrix)
        yield pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(first)) for c in by), cells], before_schema.names)

    def inside(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        before = np.frombuffer(right.column(k)[0].as_buffer())
        v = np.asarray(left.column(k))
        order = np.argsort(v, kind="stable")
        first = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        own = np.zeros((len(first), width))
        own[at, np.asarray(left.column("_g"))[order]] = np.asarray(left.column("_c"))[order]
        batch = left.combine_chunks().to_batches()[0]
        same = pa.array(np.zeros(len(first), np.int64))
        columns = [batch.column(i).slice(0, 1).take(same) for i in range(k - 1)]
        return pa.Table.from_arrays([*columns, pa.array(v[order][first]), _cells(before + np.cumsum(own, axis=0) - own / 2)], schema.names)

    totals = rows.groupBy(*by, "_g").agg(F.sum("_c").cast("double").alias("_n"))
    before = totals.groupBy(*keys).applyInArrow(running, before_schema)
    return rows.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(inside, schema)


def _few_groups(slim: DataFrame, keys: list[str], group: str, codes: DataFrame, width: int, picks: DataFrame) -> DataFrame:
    """``spearman`` of keys with at most ``width`` groups, ``codes`` (keys, group, _g) numbering them.

    With W rows in a replicate the variances and the covariance of ranks, times W, are the cubic forms less W^3 / 4.
    """
    ship(slim.sparkSession)
    found = join_keys(slim, codes, [*keys, group]).drop(group)
    found = settle(found.withColumn("_c", F.col("_c").cast("double")))
    rows, k = found, len(keys)
    for v, name in (("_x", "rx"), ("_y", "ry")):
        values = rows.groupBy(*keys, "_g", v).agg(F.sum("_c").alias("_c"))
        found = join_keys(found, _standing(values, keys, v, width, name), [*keys, v]).drop(v)
    found = found.select(*keys, "_g", "_c", "rx", "ry")
    kinds = [f for f in found.schema.fields[:k]]
    schema = T.StructType([*kinds, T.StructField("_salt", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 16
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], types[i]) for i in range(k)]
            cells = pa.array([m.tobytes() for m in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(held), pa.int32()), cells], schema.names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(k)]
            keys_of = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True))
            numbers: dict[tuple, int] = {}
            code = np.fromiter((numbers.setdefault(x, len(numbers)) for x in keys_of), np.int64, len(keys_of))
            g, c = np.asarray(batch.column(k)), np.asarray(batch.column(k + 1))
            x, y = _vectors(batch.column(k + 2)), _vectors(batch.column(k + 3))
            for key, number in numbers.items():
                if key not in held:
                    held[key] = np.zeros((3, width, width * width))
                for h in np.unique(g[code == number]):
                    at = (code == number) & (g == h)
                    a, b, n = x[at], y[at], c[at, None]
                    for part, (left, right) in enumerate(((a, a), (b, b), (a, b))):
                        held[key][part, h] += ((left * n).T @ right).ravel()
            if len(held) * 3 * width**3 > 1 << 23:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for cell in batch.column(k + 1):
                total = total + np.frombuffer(cell.as_buffer())
            last = batch
        yield pa.RecordBatch.from_arrays([*(last.column(i).slice(0, 1) for i in range(k + 1)), _cells(total[None])], schema.names)

    out_schema = T.StructType([*kinds, T.StructField("replicate", T.IntegerType()), T.StructField("spearman", T.DoubleType())])

    def correlated(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        forms = np.frombuffer(right.column(k + 1)[0].as_buffer()).reshape(3, width, width * width)
        which, at = np.unique(np.asarray(left.column("replicate")), return_inverse=True)
        m, w = np.zeros((len(which), width)), np.zeros(len(which))
        g, times = np.asarray(left.column("_g")), np.asarray(left.column("_m"))
        m[at, g] = times
        np.add.at(w, at, times * np.asarray(left.column("_n")))
        raw = [np.einsum("ri,rij,rj->r", m, (m @ f).reshape(-1, width, width), m) for f in forms]
        vx, vy, xy = (z - w**3 / 4 for z in raw)
        # What rounding leaves of a constant side is no spread.
        ok = (vx > 1e-9 * raw[0]) & (vy > 1e-9 * raw[1])
        rho = xy / np.sqrt(np.where(ok, vx * vy, 1))
        same = pa.array(np.zeros(len(which), np.int64))
        batch = left.combine_chunks().to_batches()[0]
        columns = [batch.column(i).slice(0, 1).take(same) for i in range(k)]
        return pa.Table.from_arrays([*columns, pa.array(which, pa.int32()), pa.array(rho, mask=~ok)], out_schema.names)

    sums = found.mapInArrow(products, schema)
    sums = sums.groupBy(*keys, "_salt").applyInArrow(added, schema)
    sums = settle(sums.groupBy(*keys).applyInArrow(added, schema))
    sizes = rows.groupBy(*keys, "_g").agg(F.sum("_c").alias("_n"))
    numbered = join_keys(join_keys(picks, codes, [*keys, group]), sizes, [*keys, "_g"])
    drawn = numbered.select(
        *keys, F.col("replicate").cast("int").alias("replicate"), "_g", "_n", F.col("multiplicity").cast("double").alias("_m"),
        F.floor((F.col("replicate") - 1) / BLOCK).cast("int").alias("_block"),
    )
    # Every block of replicates has the forms of its key.
    forms = join_keys(sums, drawn.select(*keys, F.col("_block").alias("_of")).distinct(), keys).select(*keys, "_salt", "sums", "_of")
    return drawn.groupBy(*keys, "_block").cogroup(forms.groupBy(*keys, "_of")).applyInArrow(correlated, out_schema)


def spearman(
    df: DataFrame, keys: Sequence[str], group: str, truth: str, pred: str, picks: DataFrame, weight: str | None = None
) -> DataFrame:
    """(keys, replicate, spearman) of the resamples ``picks`` (keys, replicate, group, multiplicity).

    Rows with a null truth or prediction take no part. A replicate in which one side is constant has a null Spearman.
    ``weight`` says of how many equal rows a row is one; such rows are all different and settled.
    """
    keys = list(keys)
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    slim = df.filter(t.isNotNull() & p.isNotNull())
    if weight is None:
        slim = settle(slim.groupBy(*keys, group, t.alias("_x"), p.alias("_y")).agg(F.count(F.lit(1)).alias("_c")))
    else:
        slim = slim.select(*keys, group, t.alias("_x"), p.alias("_y"), F.col(weight).alias("_c"))
    codes = settle(slim.select(*keys, group).distinct())
    most = codes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= FEW:
        numbered = codes.withColumn("_g", F.row_number().over(W.partitionBy(*keys).orderBy(group)) - 1)
        return _few_groups(slim, keys, group, numbered, max(most, 1), picks)
    mult = _multiplicities(picks, keys, group)
    found = slim
    side = {}
    for v, name in (("_x", "rx"), ("_y", "ry")):
        values = slim.groupBy(*keys, group, v).agg(F.sum("_c").alias("_c"))
        side[v] = _ranks(values, keys, group, mult, v).withColumnRenamed("rank", name)
    found = join_keys(found, mult, [*keys, group])
    found = join_keys(found, side["_x"].drop("weight"), [*keys, "_block", "_x"])
    found = join_keys(found, side["_y"].drop("weight"), [*keys, "_block", "_y"])
    found = found.select(*keys, "_block", F.col("_c").cast("double").alias("_c"), "mult", "rx", "ry")
    k = len(keys) + 1
    names = [*found.columns[:k], "_salt", "sums"]
    schema = T.StructType([*found.schema.fields[:k], T.StructField("_salt", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 16
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], kinds[i]) for i in range(k)]
            cells = pa.array([m.tobytes() for m in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(held), pa.int32()), cells], names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(k)]
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                keys_of = list(zip(*(part.column(i).to_pylist() for i in range(k)), strict=True))
                numbers: dict[tuple, int] = {}
                code = np.fromiter((numbers.setdefault(x, len(numbers)) for x in keys_of), np.int64, len(keys_of))
                w = _vectors(part.column(k + 1)) * np.asarray(part.column(k))[:, None]
                rx, ry = _vectors(part.column(k + 2)), _vectors(part.column(k + 3))
                for key, number in numbers.items():
                    at = code == number
                    a, x, y = w[at], rx[at], ry[at]
                    sums = np.stack([a.sum(axis=0), *((a * z).sum(axis=0) for z in (x, y, x * x, y * y, x * y))])
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > 4096:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + _vectors(batch.column(k + 1)).sum(axis=0)
            last = batch
        yield pa.RecordBatch.from_arrays([*(last.column(i).slice(0, 1) for i in range(k + 1)), _cells(total[None])], names)

    out_schema = T.StructType([*found.schema.fields[: k - 1], T.StructField("replicate", T.IntegerType()), T.StructField("spearman", T.DoubleType())])

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, x, y, xx, yy, xy = np.frombuffer(batch.column(k + 1)[i].as_buffer()).reshape(6, BLOCK)
                some = np.flatnonzero(w > 0)
                w, x, y, xx, yy, xy = (z[some] for z in (w, x, y, xx, yy, xy))
                vx, vy = xx - x * x / w, yy - y * y / w
                # What rounding leaves of a constant side is no spread.
                ok = (vx > 1e-9 * xx) & (vy > 1e-9 * yy)
                rho = (xy - x * y / w) / np.sqrt(np.where(ok, vx * vy, 1))
                first = [batch.column(j).slice(i, 1).take(pa.array(np.zeros(len(some), np.int64))) for j in range(k - 1)]
                at = batch.column(k - 1)[i].as_py() * BLOCK + some + 1
                yield pa.RecordBatch.from_arrays([*first, pa.array(at, pa.int32()), pa.array(rho, mask=~ok)], out_schema.names)

    sums = found.mapInArrow(products, schema)
    sums = sums.groupBy(*keys, "_block", "_salt").applyInArrow(added, schema)
    sums = sums.groupBy(*keys, "_block").applyInArrow(added, schema)
    return sums.mapInArrow(correlated, out_schema)
