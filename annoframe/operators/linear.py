"""Ridge and elastic net from sums of squares: any number of fits and trials in one pass over the rows.

With z = (1, x, y) the matrix G = sum of z z' of some rows holds all that a linear least-squares fit needs of them. It is
mergeable: tasks add up their rows by group, Spark adds the tasks' matrices, and sums and differences of groups
give other row sets: all rows but a family's, all rows before a cutoff. A fit is then a matter of a
(columns x columns) system, and the error of a fit on other rows is a quadratic form of their matrix, so that every
penalty of a search is scored without reading a row again.

Features are standardised by the training rows before the penalty applies, as their means and deviations follow from G too.
Coefficients are returned on the scale of the columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.functions.joins import join_keys
from annoframe.functions.sequences import zero_nonfinite
from annoframe.session import settle, ship

#: A task sends its matrices on when they take this many bytes.
HELD_BYTES = 64 << 20
#: Partial sums of one group are first added up under so many keys.
SALTS = 32
SWEEPS = 5000
TOLERANCE = 1e-12


@dataclass(frozen=True)
class Gram:
    """The sums of products of (1, columns, label) over some rows."""

    matrix: np.ndarray

    @classmethod
    def of(cls, cell: bytes) -> Gram:
        values = np.frombuffer(cell)
        size = math.isqrt(2 * len(values))
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = values
        return cls(matrix + np.triu(matrix, 1).T)

    def cell(self) -> bytes:
        return self.matrix[np.triu_indices(len(self.matrix))].tobytes()

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.matrix + other.matrix)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.matrix - other.matrix)

    @property
    def n(self) -> float:
        return self.matrix[0, 0]

    def only(self, columns: Sequence[int]) -> Gram:
        """The matrix of some of the columns (numbered from 0)."""
        keep = [0, *(c + 1 for c in columns), len(self.matrix) - 1]
        return Gram(self.matrix[np.ix_(keep, keep)])

    def standardised(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """X'X and X'y of the centred and scaled columns, means, label mean, and deviations (1 where there is none)."""
        sums, squares = self.matrix[0], self.matrix
        mean = sums[1:] / self.n
        centred = squares[1:, 1:] - self.n * np.outer(mean, mean)
        variance = np.diag(centred)[:-1] / self.n
        # What rounding leaves of a constant column is no deviation.
        constant = variance <= 1e-12 * np.maximum(np.diag(squares)[1:-1] / self.n, 1e-300)
        scale = np.where(constant, 1.0, np.sqrt(np.maximum(variance, 0)))
        centred[:-1][constant] = 0
        centred[:, :-1][:, constant] = 0
        return centred[:-1, :-1] / np.outer(scale, scale), centred[:-1, -1] / scale, mean[:-1], float(mean[-1]), scale

    def rmse(self, coefficients: np.ndarray) -> float:
        """Root mean squared error of (intercept, coefficients) on these rows."""
        back = np.append(-coefficients, 1.0)
        return math.sqrt(max(float(back @ self.matrix @ back), 0.0) / self.n)


def ridge(gram: Gram, alpha: float = 1.0) -> np.ndarray:
    """(intercept, coefficients) of least squares with ``alpha`` times the squared norm (ML1)."""
    xx, xy, mean, level, scale = gram.standardised()
    lower = np.linalg.cholesky(xx + alpha * np.eye(len(xx)))
    w = np.linalg.solve(lower.T, np.linalg.solve(lower, xy)) / scale
    return np.concatenate([[level - mean @ w], w])


def elastic_net(gram: Gram, alpha: float = 1.0, l1_ratio: float = 0.5, sweeps: int = SWEEPS) -> np.ndarray:
    """(intercept, coefficients) of half the mean squared error with the mixed penalty, by coordinate descent (ML2)."""
    xx, xy, mean, level, scale = gram.standardised()
    xx, xy = xx / gram.n, xy / gram.n
    w, fitted = np.zeros(len(xy)), np.zeros(len(xy))
    thrust, shrink = alpha * l1_ratio, np.diag(xx) + alpha * (1 - l1_ratio)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            rest = xy[j] - fitted[j] + xx[j, j] * w[j]
            new = math.copysign(max(abs(rest) - thrust, 0.0), rest) / shrink[j] if shrink[j] > 0 else 0.0
            if new != w[j]:
                fitted += xx[j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most <= TOLERANCE * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    w = w / scale
    return np.concatenate([[level - mean @ w], w])


FITS: dict[str, Callable[..., np.ndarray]] = {"ridge": ridge, "elasticnet": elastic_net}


def fit(kind: str, params: Mapping[str, float], gram: Gram) -> np.ndarray:
    """(intercept, coefficients) of an estimator; unknown parameters are errors."""
    return FITS[kind](gram, **params)


def prepared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The feature columns as doubles, non-finite values as 0."""
    return df.withColumns({c: zero_nonfinite(F.col(c).cast("double")) for c in columns})


def _design(columns: Sequence[pa.Array]) -> np.ndarray:
    """A column of ones and the feature columns, non-finite values as 0: what ``prepared`` gives, without an expression for each column."""
    z = np.ones((len(columns[0]) if columns else 0, len(columns) + 1))
    for i, column in enumerate(columns):
        z[:, i + 1] = column.to_numpy(zero_copy_only=False)
    return np.nan_to_num(z, copy=False, nan=0.0, posinf=0.0, neginf=0.0)


def _doubles(columns: Sequence[str]) -> list[Column]:
    """The feature columns under names of their own."""
    return [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]


def grams(df: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, gram): the matrix of every group's rows; a null key is a group. Rows without a label are left out.

    Tasks add up in bounded memory. A group of very many rows has a partial matrix for each task, which are added
    under salted keys first, so no task gets all of them.
    """
    ship(df.sparkSession)
    by, k = list(by), len(by)
    rows = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    rows = rows.select(*by, *_doubles(columns), F.col(label).cast("double").alias("_label"))
    kinds = [rows.schema[c] for c in by]
    schema = T.StructType([*kinds, T.StructField("salt", T.IntegerType()), T.StructField("gram", T.BinaryType())])
    size, upper = len(columns) + 2, np.triu_indices(len(columns) + 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[tuple, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            keys = [pa.array([key[i] for key in held], batch_types[i]) for i in range(k)]
            cells = pa.array([m[upper].tobytes() for m in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*keys, pa.array([salt] * len(held), pa.int32()), cells], [*by, "salt", "gram"])

        batch_types: list[pa.DataType] = []
        for batch in batches:
            batch_types = [batch.schema.field(i).type for i in range(k)]
            z = np.ones((batch.num_rows, size))
            if size > 2:
                z[:, :-1] = _design(batch.columns[k:-1])
            z[:, -1] = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * batch.num_rows
            numbers: dict[tuple, int] = {}
            code = np.fromiter((numbers.setdefault(x, len(numbers)) for x in keys), np.int64, len(keys))
            order = np.argsort(code, kind="stable")
            z, ends = z[order], np.cumsum(np.bincount(code, minlength=len(numbers)))
            for key, a, b in zip(numbers, [0, *ends[:-1]], ends, strict=True):
                part = z[a:b].T @ z[a:b]
                held[key] = held[key] + part if key in held else part
            if len(held) * size * size * 8 > HELD_BYTES:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(batch.num_columns - 1):
                values = np.frombuffer(cell.as_buffer())
                total = values.copy() if total is None else total + values
            last = batch
        arrays = [last.column(i).slice(0, 1) for i in range(last.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([total.tobytes()], pa.binary())], last.schema.names)

    found = rows.mapInArrow(partial, schema)
    found = found.groupBy(*by, "salt").applyInArrow(added, schema)
    return found.groupBy(*by).applyInArrow(added, schema).drop("salt")


def total(found: DataFrame) -> Gram | None:
    """The sum of all matrices of a table; None without any."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for cell in batch.column(0):
                values = np.frombuffer(cell.as_buffer())
                whole = values.copy() if whole is None else whole + values
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["gram"])

    # One matrix for each partition reaches the driver.
    cells = [bytes(r.gram) for r in found.select("gram").mapInArrow(added, "gram binary").toLocalIterator()]
    out = None
    for cell in cells:
        out = Gram.of(cell) if out is None else out + Gram.of(cell)
    return out


def value(columns: Sequence[str], coefficients: Column) -> Column:
    """Intercept plus coefficients times columns, from an array column of them."""
    out = F.get(coefficients, 0)
    for i, c in enumerate(columns):
        out = out + F.get(coefficients, i + 1) * F.col(c)
    return out


@dataclass
class Fitted:
    """A fit that scores rows by their columns, like other models."""

    columns: Sequence[str]
    parameters: np.ndarray

    @property
    def coefficients(self) -> np.ndarray:
        return self.parameters[1:]

    def transform(self, df: DataFrame) -> DataFrame:
        whole = F.array(*[F.lit(float(v)) for v in self.parameters])
        return df.withColumn("prediction", value(self.columns, whole))


def search(
    kind: str, train: Gram, val: Gram, draws: Sequence[Mapping[str, float]]
) -> tuple[np.ndarray, dict, list[dict]]:
    """Every draw of parameters fitted on one matrix and scored by RMSE on another (ML5): the fit of the best, its
    parameters and the trials. The first of equally good draws wins."""
    trials, best = [], None
    for number, params in enumerate(draws):
        found = fit(kind, params, train)
        trials.append({"number": number, "value": val.rmse(found), **params})
        if best is None or trials[-1]["value"] < best[0]:
            best = (trials[-1]["value"], found, dict(params))
    return best[1], best[2], trials


def _places(columns: Sequence[str], feature_sets: Mapping[str, Sequence[str]]) -> dict[str, list[int]]:
    at = {c: i for i, c in enumerate(columns)}
    return {name: [at[c] for c in part] for name, part in feature_sets.items()}


def _whole(coefficients: np.ndarray, places: Sequence[int], width: int) -> list[float]:
    """Coefficients of some columns as those of all, 0 for the others."""
    out = np.zeros(width + 1)
    out[0], out[[p + 1 for p in places]] = coefficients[0], coefficients[1:]
    return out.tolist()


def union_of(feature_sets: Mapping[str, Sequence[str]]) -> list[str]:
    """All columns of some feature sets, each once, in order of appearance."""
    return list(dict.fromkeys(c for part in feature_sets.values() for c in part))


def time_forward_runs(
    df: DataFrame,
    key: str,
    label: str,
    cutoffs: Sequence[int],
    feature_sets: Mapping[str, Sequence[str]],
    kind: str = "ridge",
    params: Mapping[str, float] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Train before and score after every cutoff, for every feature set (ML10).

    ``df`` carries ``train_for`` and ``test_for`` of ``splits.time_forward``. A row trains for the latest cutoffs, as many as
    ``train_for`` has, so the rows' matrices by that number, added up, are those of all cutoffs: one pass for all fits.
    Cutoffs without a training row have no predictions.
    """
    columns, cutoffs = union_of(feature_sets), sorted(set(cutoffs))
    spark = df.sparkSession
    wanted = F.array(*[F.lit(c) for c in cutoffs])
    ready = df.withColumn("_serves", F.size(F.array_intersect("train_for", wanted)))
    # At most one matrix for each cutoff.
    bands = {r["_serves"]: Gram.of(bytes(r["gram"])) for r in grams(ready.filter("_serves > 0"), columns, label, ["_serves"]).collect()}
    fits, places = {}, _places(columns, feature_sets)
    for i, cutoff in enumerate(cutoffs):
        parts = [g for serves, g in bands.items() if serves >= len(cutoffs) - i]
        if parts:
            whole = sum(parts[1:], parts[0])
            fits[cutoff] = [_whole(fit(kind, params or {}, whole.only(at)), at, len(columns)) for at in places.values()]
    # Cutoffs times feature sets, whatever the input is.
    return _scored(df.withColumn("_asked", F.array_intersect("test_for", F.array(*[F.lit(c) for c in fits]).cast("array<int>"))), key, label, columns, list(places), fits, carry)


def _scored(
    df: DataFrame, key: str, label: str, columns: Sequence[str], models: list[str], fits: Mapping[int, list[list[float]]], carry: Sequence[str]
) -> DataFrame:
    """Every row by the fits of all ``models`` for each cutoff in ``_asked``, as products of matrices in tasks."""
    ship(df.sparkSession)
    rows = df.filter(F.size("_asked") > 0)
    rows = rows.select(F.col(key).alias("sample_id"), F.col(label).cast("double").alias("y_true"), *carry, F.col("_asked").cast("array<int>"), *_doubles(columns))
    kinds = {f.name: f for f in rows.schema.fields}
    first = [T.StructField("cutoff", T.IntegerType()), T.StructField("model", T.StringType()), kinds["sample_id"], kinds["y_true"]]
    schema = T.StructType([*first, T.StructField("y_pred", T.DoubleType()), *(kinds[c] for c in carry)])
    cutoffs, n = np.array(sorted(fits), np.int64), len(models)
    # Columns of ones and features by cutoffs and models.
    weights = np.array([fits[c] for c in sorted(fits)], np.float64).reshape(len(cutoffs) * n, len(columns) + 1).T
    at = 2 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                asked = batch.column(at)
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
                cutoff = np.asarray(asked.flatten()).astype(np.int64)
                values = (_design(batch.columns[at + 1 :]) @ weights).reshape(batch.num_rows, len(cutoffs), n)
                values = values[row, np.searchsorted(cutoffs, cutoff)].ravel()
                back = pa.array(np.repeat(row, n))
                names = pa.array(models, pa.string()).take(pa.array(np.tile(np.arange(n), len(row))))
                kept = [batch.column(i).take(back) for i in range(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cutoff, n), pa.int32()), names, *kept[:2], pa.array(values), *kept[2:]], schema.names
                )

    return rows.mapInArrow(run, schema)


def leave_family_runs(
    df: DataFrame,
    roles: DataFrame,
    key: str,
    label: str,
    family: str,
    feature_sets: Mapping[str, Sequence[str]],
    kind: str = "ridge",
    params: Mapping[str, float] | None = None,
) -> DataFrame:
    """Train on all other families plus the family's support rows, score its query rows, for every family of ``roles``
    and every feature set (ML11).

    ``roles`` comes from ``splits.support_query``. What a family's fit leaves out are its query rows, so its matrix is
    the total less theirs: one pass for all families, and one small system for each family and feature set, solved in tasks.
    A null family is a family.
    """
    columns = union_of(feature_sets)
    marked = prepared(df, columns).join(roles.select(key, F.col("role").alias("_role")), key, "left")
    marked = settle(marked.withColumn("_query", F.coalesce(F.col("_role") == "query", F.lit(False))))
    found = settle(grams(marked, columns, label, [family, "_query"]))
    whole = total(found)
    asked = found.filter("_query").select(family, "gram")
    shared = df.sparkSession.sparkContext.broadcast((whole, _places(columns, feature_sets)))
    steps, width = dict(params or {}), len(columns)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows, places = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                train = all_rows - Gram.of(batch.column(1)[i].as_py())
                fits = [_whole(fit(kind, steps, train.only(at)), at, width) for at in places.values()]
                fam = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(fits))
                yield pa.RecordBatch.from_arrays([fam, pa.array(list(places), pa.string()), pa.array(fits, pa.list_(pa.float64()))], [family, "model", "_fit"])

    schema = T.StructType([marked.schema[family], T.StructField("model", T.StringType()), T.StructField("_fit", T.ArrayType(T.DoubleType()))])
    fits = asked.mapInArrow(solved, schema)
    out = join_keys(marked.filter("_query"), fits, [family])
    return out.select(
        F.col(family).alias("family_id"),
        "model",
        F.col(key).alias("sample_id"),
        F.col(label).cast("double").alias("y_true"),
        value(columns, F.col("_fit")).alias("y_pred"),
    )
