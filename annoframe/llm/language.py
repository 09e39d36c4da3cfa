"""Language proportions of a document by expectation-maximisation over letter n-gram likelihoods.

*Model.* For each language, smoothed frequencies of letter trigrams (UTF-8 bytes, ASCII lower-cased,
everything that is no letter as a space), hashed to ``BUCKETS`` cells. They are counted over all
labelled rows that may be learned from; each task adds up its own cells first. The model has languages
times ``BUCKETS`` numbers, whatever the input is, and is broadcast.

*Prediction.* A word's likelihood in a language is the product over its trigrams. A document is a mixture of
languages, one for each word; expectation-maximisation gives the proportions. The set of languages is
chosen by penalised likelihood: beginning with the best single language, the one with the next largest
proportion joins if it raises the log-likelihood by more than ``PENALTY`` times log(words) plus ``SLACK`` for
each word. The language with the largest proportion in that set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.llm import runtime
from annoframe.llm.spans import SMALL_SLICE, Texts, rows_of, slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
STEPS = 8
PENALTY = 1.0
#: A word of one language is often a little likelier in another; this much gain for each word is no evidence.
SLACK = 0.05
UNKNOWN = "und"

# A-Z as a-z; other ASCII as space; all bytes of other characters stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Model:
    """Log-frequencies by language and cell."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()


def _cells(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around all letters; their positions; whether each begins a word; its row's first position."""
    folded = np.full(len(x.buf) + 2, 32, np.uint8)
    folded[1:-1] = _FOLD[x.buf]
    spot = np.flatnonzero(folded[1:-1] != 32)
    edge = np.zeros(len(x.buf) + 1, bool)
    edge[x.at] = True
    before = np.where(edge[spot], 32, folded[spot]).astype(np.uint32)
    after = np.where(edge[spot + 1], 32, folded[spot + 2]).astype(np.uint32)
    code = (before << np.uint32(16)) | (folded[spot + 1].astype(np.uint32) << np.uint32(8)) | after
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return cell.astype(np.int64), spot, before == 32, np.searchsorted(spot, x.at)


def _has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        names = sorted(set(languages))
        number = np.array([names.index(v) for v in languages])
        for x in slices(batch.column(1), SMALL_SLICE):
            cell, _, _, first = _cells(x)
            key = number[x.first + rows_of(first, len(cell))] * BUCKETS + cell
            found = np.bincount(key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, found, strict=True):
                total[name] = total[name] + row if name in total else row
    for name in sorted(total):
        cell = np.flatnonzero(total[name])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(total[name][cell])], ["lang", "cell", "n"])


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows whose language is not null. With no such row there are no languages, and all is ``und``."""
    runtime.ship(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    found = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    index = {v: i for i, v in enumerate(names)}
    of = np.array([index[v] for v in found.column("lang").to_pylist()], np.int64)
    counts[of, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return Model(names, counts)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each row's words."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _mixture(like: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps from ``share``, and the log-likelihood before the last step (less each word's top)."""
    row, count = rows_of(first, len(like)), np.maximum(np.diff(first), 1)[:, None]
    for _ in range(steps):
        joint = like * share[row]
        whole = joint.sum(axis=1, keepdims=True)
        share = _sums(joint / whole, first) / count
    return share, _sums(np.log(whole[:, 0]), first)


def predict(model: Model, x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language (-1: none), score, and proportions of each row."""
    k = len(model.languages)
    best, score, shares = np.full(x.rows, -1), np.zeros(x.rows), np.zeros((x.rows, k))
    cell, _, begins, at = _cells(x)
    lettered = np.diff(at) > 0
    data = x.buf
    ascii_ = np.concatenate([[0], np.cumsum(_FOLD[data] < 128, dtype=np.int64) - np.cumsum(_FOLD[data] == 32, dtype=np.int64)])
    for i in np.flatnonzero(lettered & (ascii_[x.at[1:]] == ascii_[x.at[:-1]])):
        lettered[i] = _has_letter(data[x.at[i] : x.at[i + 1]].tobytes())
    if not k or not len(cell):
        return best, score, shares
    start = np.flatnonzero(begins)
    log = np.add.reduceat(model.log[cell].astype(np.float64), start, axis=0)
    first = np.searchsorted(start, at)
    whole = _sums(log, first)
    like = np.exp(log - log.max(axis=1, keepdims=True))
    like = np.maximum(like, 1e-30)
    share, _ = _mixture(like, first, np.full((x.rows, k), 1.0 / k), STEPS)
    # One language only: its posterior; then more as long as the penalised likelihood rises.
    single = whole.argmax(axis=1)
    away = np.exp(np.clip(whole - whole.max(axis=1, keepdims=True), -700, 0))
    chosen = np.zeros((x.rows, k), bool)
    chosen[np.arange(x.rows), single] = True
    shares[chosen] = 1
    score = away[np.arange(x.rows), single] / away.sum(axis=1)
    top = _sums(log.max(axis=1), first)
    reached = whole.max(axis=1) - top
    open_ = np.flatnonzero(lettered)
    while len(open_) and chosen[open_[0]].sum() < k:
        trial = chosen[open_].copy()
        nextbest = np.where(trial, -1.0, share[open_]).argmax(axis=1)
        trial[np.arange(len(open_)), nextbest] = True
        size = np.diff(first)[open_]
        part = np.concatenate([[0], np.cumsum(size)])
        words = np.repeat(first[:-1][open_] - part[:-1], size) + np.arange(part[-1])
        begin = np.where(trial, np.maximum(share[open_], 1e-6), 0)
        found, gained = _mixture(like[words], part, begin / begin.sum(axis=1, keepdims=True), STEPS)
        better = gained - reached[open_] > PENALTY * np.log(np.maximum(size, 2)) + SLACK * size
        won = open_[better]
        chosen[won], shares[won], reached[won] = trial[better], found[better], gained[better]
        score[won] = found[better].max(axis=1)
        open_ = won
    best = np.where(lettered, np.where(chosen.sum(axis=1) > 1, shares.argmax(axis=1), single), -1)
    score = np.where(lettered, np.clip(score, 0, 1), 0.0)
    shares[~lettered] = 0
    return best, score, shares


def likeliest(model: Model, x: Texts) -> np.ndarray:
    """Number of the one language under which each row's trigrams are likeliest (-1 without any)."""
    cell, _, _, first = _cells(x)
    some = np.diff(first) > 0
    best = np.full(x.rows, -1)
    if model.languages and some.any():
        best[some] = np.add.reduceat(model.log[cell], first[:-1][some], axis=0).argmax(axis=1)
    return best


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion, or its posterior if it is alone) and ``languages``.

    ``languages`` is a map from each language of the chosen set to its proportion. A text that is null,
    empty or without any letter gets ``und``, score 0 and no languages. Only the text is looked at; all
    columns stay, and the new names (after ``prefix``) must not be among them.
    """
    names = [prefix + c for c in ("lang_pred", "score", "languages")]
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {names} must be new; set prefix")
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for x in slices(batch.column(at), SMALL_SLICE):
                best, score, shares = predict(m, x)
                sets = [[(m.languages[j], float(s[j])) for j in np.flatnonzero(s > 0)] for s in shares]
                found = [
                    pa.array([m.languages[b] if b >= 0 else UNKNOWN for b in best], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(sets, pa.map_(pa.string(), pa.float64())),
                ]
                part = batch.slice(x.first, x.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType()))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True))])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3; null does not count."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
