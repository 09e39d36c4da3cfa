"""Toxicity of documents by a convolutional text classifier, written and trained in numpy.

*Network.* A word is the sum of hashed embeddings: one of the word and one for each of its leading parts of 3 to 7 bytes, so
that words of one stem share what is learned. Hashes have 31 bits, so that a very long text does not meet learned ones by
chance. Filters of widths 1, 2 and 3 run over the words of a whole text; each filter's maximum over the text goes through
a rectifier into one logistic unit. Embeddings of features that too few of the learning rows have are zero and take no
room, so that what was never learned says nothing.

*Learning.* Every labelled row that may be used is learned from, whole. Rows are dealt by a hash of their id to parts of about
``PART_BYTES`` of text, each of which is one task's. The first part gives a network by ``EPOCHS`` passes of mini-batches and adaptive
steps; every other part goes on from it for ``LATER_EPOCHS`` passes, all of them at once, and their moves are averaged: those of an
embedding over the parts that moved it, by how often they met it, all others by rows. Embeddings belong to the ``FEATURES`` features that most rows have, counted
over all rows, so that the network's size has a limit and it can be broadcast. One row in five, by hash, does not learn.

*Thresholds by language.* All the rows held back from learning give them, counted by language and logit in steps of
1 / ``GRID``. The language of a text is what its letter n-grams say (``language.likeliest``), never a column.
A language's threshold is moved to ``CUT`` in the score by a shift of the logit, so that one limit serves all languages. A
language with few such rows of a class takes the threshold of all.

Null and empty texts, and texts without a word, get the score of no words. Equal texts get equal scores. If one of the
classes has no row to learn from, all scores are the share of label 1 (0 without any label).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoframe.llm import language, radix, runtime
from annoframe.llm.spans import SMALL_SLICE, Texts, hash_spans, lower, mix, rows_of, runs, slices

#: Hashed names of words and parts; only those that were learned have an embedding.
CELLS = (1 << 31) - 1
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Lengths of the leading parts of a word that have embeddings of their own.
LEADS = (3, 4, 5, 6, 7)
#: Text that one task learns from.
PART_BYTES = 32 << 20
#: Features with an embedding, at most.
FEATURES = 1 << 17
EPOCHS = 6
#: Passes over the rows of all parts but the first.
LATER_EPOCHS = 2
BATCH = 32
STEP = 0.1
#: Embeddings begin near zero, so that rare words do not disturb the maxima.
SPREAD = 0.02
#: Places of words that filters run over at a time.
PLACES = 1 << 15
#: A feature is learned if so many rows have it.
LEAST_ROWS = 8
#: Distinct features of so many words and rows are counted before they are sent on.
HELD = 1 << 20
#: Groups of embeddings that are averaged together, and the unit in which their moves travel as 16-bit numbers.
GROUPS, UNIT = 32, 1 / 1024
#: Steps of the logit in which thresholds are looked for, and the largest logit.
GRID, MOST = 1000, 100
#: The score from which on a row is called toxic.
CUT = 0.3
#: Held-back rows of each class that a language needs for a threshold of its own.
LEAST_CALIBRATED = 8

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4; null does not count."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The embedding cells of each distinct word (one row each), the word at each place, and each row's first place."""
    x = Texts(lower(x.buf), x.at, x.first)
    start, end, first = runs(x, _WORD)
    names = hash_spans(x.buf, start, end)
    order = np.argsort(names, kind="stable")
    new = radix.starts(names[order])
    word = np.empty(len(names), np.int64)
    word[order] = np.cumsum(new) - 1
    start, end = start[order[new]], end[order[new]]
    cells = [names[order[new]] % np.uint64(CELLS)]
    for n in LEADS:
        part = mix(hash_spans(x.buf, start, np.minimum(end, start + n)) + np.uint64(n)) % np.uint64(CELLS)
        # The cell after all others has no embedding: shorter words have no such part.
        cells.append(np.where(end - start > n, part, np.uint64(CELLS)))
    return np.stack(cells, axis=1).astype(np.int32), word, first


@dataclass
class Network:
    """Learned cells in order, their embeddings and a row of zeros, filters by width, and the logistic unit."""

    known: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: np.ndarray
    out: np.ndarray
    bias: float
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of the logit, by language; the last one for none

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """The row of each cell's embedding; that of zeros for all that was not learned."""
        at = np.searchsorted(self.known, cells)
        if not len(self.known):
            return at
        return np.where(self.known[np.minimum(at, len(self.known) - 1)] == cells, at, len(self.known))

    def windows(self, known: np.ndarray, left: np.ndarray, i: int, j: int) -> np.ndarray:
        """What the widest filter sees from places i to j - 1 on: embeddings of words, zeros after a row's end.

        ``known`` holds the embedding at every place from i on, as far as the last window reaches; ``left`` the words from each place to the row's end.
        """
        out = np.zeros((j - i, max(WIDTHS) * SIZE), np.float32)
        for k in range(max(WIDTHS)):
            part = known[k : k + j - i]
            out[: len(part), k * SIZE : (k + 1) * SIZE] = part if k == 0 else np.where((left[i:j][: len(part)] > k)[:, None], part, 0)
        return out

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Every filter at every place."""
        return np.concatenate([windows[:, : w * SIZE] @ f for w, f in zip(WIDTHS, self.filters, strict=True)], axis=1)

    def logits(self, cells: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The logit of each row; places are worked on in blocks, so that a long text takes no more memory than a short one."""
        top = np.full((len(first) - 1, len(self.out)), -np.inf, np.float32)
        known = self.embedding[self.rows(cells)].sum(axis=1)
        row = rows_of(first, len(word))
        left = first[1:][row] - np.arange(len(word))
        for i in range(0, len(word), PLACES):
            j = min(i + PLACES, len(word))
            at = self.responses(self.windows(known[word[i : j + max(WIDTHS)]], left, i, j))
            begin = np.flatnonzero(radix.starts(row[i:j]))
            part = row[i:j][begin]
            top[part] = np.maximum(top[part], np.maximum.reduceat(at, begin, axis=0))
        return np.maximum(top + self.offsets, 0).astype(np.float64) @ self.out + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Course:
    """A network on its way: its sums of squared steps decide how far the next ones go."""

    def __init__(self, known: np.ndarray, draw: np.random.Generator):
        n_filters = FILTERS * len(WIDTHS)
        self.draw = draw
        self.net = Network(
            known,
            np.concatenate([draw.normal(0, SPREAD, (len(known), SIZE)), np.zeros((1, SIZE))]).astype(np.float32),
            [draw.normal(0, 1 / np.sqrt(w * SIZE), (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(n_filters, np.float32),
            draw.normal(0, 0.3, n_filters),
            0.0,
        )
        self.power = {"e": np.full(len(known) + 1, 1e-3), "f": [np.full(f.shape, 1e-3) for f in self.net.filters], "o": np.full(n_filters, 1e-3), "w": np.full(n_filters, 1e-3), "b": 1e-3}

    def _tops(self, cells: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum in each row and its first place (-1: no word); places are worked on in blocks."""
        net = self.net
        top = np.full((len(first) - 1, len(net.out)), -np.inf, np.float32)
        place = np.full(top.shape, -1)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(cells))
        for i in range(0, len(cells), PLACES):
            j = min(i + PLACES, len(cells))
            at = net.responses(net.windows(net.embedding[cells[i : j + max(WIDTHS)]].sum(axis=1), left, i, j))
            for row in range(int(np.searchsorted(first, i, side="right")) - 1, int(np.searchsorted(first, j, side="left"))):
                a, b = max(first[row], i), min(first[row + 1], j)
                if a < b:
                    spot = at[a - i : b - i].argmax(axis=0)
                    found = at[a - i + spot, np.arange(len(spot))]
                    more = found > top[row]
                    top[row, more], place[row, more] = found[more], a + spot[more]
        return top, place

    def learn(self, rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int) -> None:
        """Go on with some rows, each the rows of embeddings of its words in order (words, cells of a word)."""
        net, power = self.net, self.power
        known, n_filters = net.known, len(net.out)
        strange = np.full((1, 1 + len(LEADS)), len(known))
        for _ in range(epochs):
            order = self.draw.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                batch = order[i : i + BATCH]
                # Two more rows, of a word that was never learned and of no word: such texts are not toxic.
                cells = np.concatenate([*(rows[j] for j in batch), strange])
                first = np.concatenate([[0], np.cumsum([*(len(rows[j]) for j in batch), 1, 0])])
                top, place = self._tops(cells, first)
                on = (place >= 0) & (top + net.offsets > 0)
                top = np.where(on, top + net.offsets, 0)
                goal, share = np.append(label[batch], [0, 0]), np.append(weight[batch], [1, 1])
                wrong = (_sigmoid(top @ net.out + net.bias) - goal) * share / len(goal)
                back = wrong[:, None] * net.out * on
                grad_out, grad_bias = wrong @ top + 1e-5 * net.out, wrong.sum()
                # Only the words at each filter's maximum take part.
                row, f = np.nonzero(on)
                spot, pull = place[row, f], back[row, f]
                touched, pulls = [], []
                for k, w in enumerate(WIDTHS):
                    mine = (f // FILTERS) == k
                    g, p, c = f[mine] % FILTERS, spot[mine], pull[mine]
                    down = c[:, None] * net.filters[k].T[g]
                    grad = np.zeros((FILTERS, w * SIZE))
                    for d in range(w):
                        inside = p + d < first[1:][row[mine]]
                        seen = cells[p[inside] + d]
                        np.add.at(grad[:, d * SIZE : (d + 1) * SIZE], g[inside], net.embedding[seen].sum(axis=1) * c[inside, None])
                        touched.append(seen)
                        pulls.append(down[inside, d * SIZE : (d + 1) * SIZE])
                    grad = grad.T
                    power["f"][k] += grad**2
                    net.filters[k] -= (STEP * grad / np.sqrt(power["f"][k])).astype(np.float32)
                power["o"] += (s := back.sum(axis=0)) ** 2
                net.offsets -= (STEP * s / np.sqrt(power["o"])).astype(np.float32)
                power["w"] += grad_out**2
                net.out -= STEP * grad_out / np.sqrt(power["w"])
                power["b"] += grad_bias**2
                net.bias -= STEP * grad_bias / np.sqrt(power["b"])
                if touched and sum(map(len, touched)):
                    cell = np.concatenate(touched)
                    grad = np.repeat(np.concatenate(pulls), cell.shape[1], axis=0)
                    cell = cell.reshape(-1)
                    order_ = np.argsort(cell, kind="stable")
                    begin = np.flatnonzero(radix.starts(cell[order_]))
                    which, total = cell[order_][begin], np.add.reduceat(grad[order_], begin, axis=0)
                    may = which < len(known)
                    which, total = which[may], total[may]
                    power["e"][which] += (total**2).mean(axis=1)
                    net.embedding[which] -= (STEP * total / np.sqrt(power["e"][which])[:, None]).astype(np.float32)

    def dense(self) -> np.ndarray:
        """All that is no embedding, in one array."""
        parts = [*self.net.filters, self.net.offsets, self.net.out, np.array([self.net.bias])]
        return np.concatenate([p.reshape(-1) for p in parts]).astype(np.float64)


def _weights(label: np.ndarray, share: float) -> np.ndarray:
    """Both classes weigh the same if ``share`` of all rows have label 1."""
    return np.where(label == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))


def train(rows: list[np.ndarray], label: np.ndarray, seed: int = 5) -> Network:
    """The network of some rows, each the cells of its words in order (words, cells of a word)."""
    which, seen = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    course = Course(which[(seen >= LEAST_ROWS) & (which < CELLS)], np.random.default_rng(seed))
    course.learn([course.net.rows(r) for r in rows], label, _weights(label, label.mean()), EPOCHS)
    return course.net


def _threshold(z: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The middle of the gap at which F1 is best; ``label`` is the number of toxic rows of each z, ``rows`` that of all (1 each)."""
    order = np.argsort(-z, kind="stable")
    rows = (np.ones(len(z), np.int64) if rows is None else rows)[order]
    z, label = z[order], label[order]
    hits = np.cumsum(label)
    f1 = 2 * hits / (np.cumsum(rows) + label.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no limit lies between equal values
    best = int(f1.argmax())
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1)


def _shifts(counts: pa.Table, languages: int, silent: float) -> np.ndarray:
    """Shifts of the logit by language from counts of held-back rows by language and step of the logit.

    A text without words, of logit ``silent``, counts as one more clean row.
    """
    lang, z, toxic, n = (np.asarray(counts.column(c)) for c in ("lang", "step", "toxic", "n"))
    goal, z = np.log(CUT / (1 - CUT)), z / GRID
    shifts = np.zeros(languages + 1)

    def shift(mine: np.ndarray, least: int) -> float | None:
        if min(toxic[mine].sum(), (n - toxic)[mine].sum()) < least:
            return None
        at, of = np.unique(np.append(z[mine], silent), return_inverse=True)
        return goal - _threshold(at, np.bincount(of, np.append(toxic[mine], 0)), np.bincount(of, np.append(n[mine], 1)))

    shifts[:] = shift(np.ones(len(z), bool), 1) or 0.0
    for k in range(languages):
        if (own := shift(lang == k, LEAST_CALIBRATED)) is not None:
            shifts[k] = own
    return shifts


@dataclass
class Model:
    """What scoring needs: a network and the languages, or a constant score."""

    net: Network | None
    speech: language.Model | None
    constant: float = 0.0

    def scores(self, x: Texts) -> np.ndarray:
        if self.net is None:
            return np.full(x.rows, self.constant)
        z = self.net.logits(*features(x)) + self.net.shifts[language.likeliest(self.speech, x)]
        return np.clip(np.round(_sigmoid(z), 6), 0, 1)


def _merged(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    which, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(which, kind="stable")
    begin = np.flatnonzero(radix.starts(which[order]))
    return which[order][begin], np.add.reduceat(n[order], begin) if len(begin) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have each feature, in pieces to be added up."""
    cells, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    send = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(cells, counts)], ["cell", "n"])
    for batch in batches:
        for x in slices(batch.column(0), SMALL_SLICE):
            of, word, first = features(x)
            pair = np.sort(rows_of(first, len(word)) * np.int64(max(len(of), 1)) + word)
            pair = pair[radix.starts(pair)]
            if not len(pair):
                continue
            row, held = pair // len(of), of[pair % len(of)]
            # The features of a row, each once.
            keys = ((row << 31)[:, None] | held)[held < CELLS]
            keys.sort()
            found = np.sort((keys[radix.starts(keys)] & CELLS).astype(np.int32))
            begin = np.flatnonzero(radix.starts(found))
            cells.append(found[begin])
            counts.append(np.diff(begin, append=len(found)))
            if sum(map(len, cells)) > HELD:
                which, n = _merged(cells, counts)
                cells, counts = [which], [n]
                if len(which) > HELD // 2:
                    yield send()
                    cells, counts = [which[:0]], [n[:0]]
    yield send()


def _read(docs: pa.Table, labels: pa.Table, net: Network) -> tuple[list[np.ndarray], np.ndarray]:
    """The labelled rows in an order that does not depend on where they came from, and their labels."""
    ids, toxic = np.asarray(labels.column("doc_id")), np.asarray(labels.column("toxic"))
    order = np.argsort(ids)
    ids, toxic = ids[order], toxic[order]
    docs = docs.select(["doc_id", "text"]).filter(pc.is_in(docs.column("doc_id"), pa.array(ids)))
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    rows = []
    for x in slices(docs.column("text"), SMALL_SLICE):
        cells, word, first = features(x)
        at = net.rows(cells).astype(np.int32)
        rows += [at[word[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    return rows, toxic[np.searchsorted(ids, np.asarray(docs.column("doc_id")))].astype(np.float64)


def _average(key: tuple, parts: pa.Table) -> pa.Table:
    """The moves of one group of embeddings (or of all the rest, in the group after them) over all parts that moved them, by weight."""
    parts = parts.sort_by("part")
    kind, unit = (np.float16, UNIT) if key[0].as_py() < GROUPS else (np.float64, 1.0)
    of, weight, data = ([bytes(v) for v in parts.column(c).to_pylist()] for c in ("which", "weight", "data"))
    which = np.concatenate([np.frombuffer(v, np.int32) for v in of])
    weight = np.concatenate([np.frombuffer(v) for v in weight])
    moves = np.concatenate([np.frombuffer(v, kind) for v in data]).reshape(len(which), -1)
    order = np.argsort(which, kind="stable")
    begin = np.flatnonzero(radix.starts(which[order]))
    whole = np.add.reduceat(weight[order], begin)
    mean = np.add.reduceat(moves[order].astype(np.float64) * (unit * weight[order, None]), begin, axis=0) / whole[:, None]
    return pa.table({"which": pa.array([which[order][begin].tobytes()]), "data": pa.array([mean.astype(np.float32).tobytes()])})


def _moved(net: Network, flat: np.ndarray) -> Network:
    """``net`` with all but its embeddings moved by one array."""
    sizes = [w * SIZE * FILTERS for w in WIDTHS] + [len(net.offsets), len(net.out), 1]
    *filters, offsets, out, bias = np.split(flat, np.cumsum(sizes)[:-1])
    filters = [old + f.reshape(w * SIZE, FILTERS) for old, f, w in zip(net.filters, filters, WIDTHS, strict=True)]
    return Network(net.known, net.embedding, filters, net.offsets + offsets, net.out + out, net.bias + float(bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Learn from ``labels`` (id, 0 or 1; others and nulls are left out) and the texts of ``docs``."""
    spark = docs.sparkSession
    runtime.ship(spark)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = texts.filter("doc_id is not null and text is not null")
    n = {r.toxic: r["count"] for r in texts.select("doc_id").join(marked, "doc_id").groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(None, None, float(1 in n))
    share = n[1] / (n[0] + n[1])
    speech = language.fit(texts)
    counted = texts.select("text").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most FEATURES numbers.
    known = counted.filter(f"n >= {LEAST_ROWS}").orderBy(F.desc("n"), "cell").limit(FEATURES).select("cell").toArrow()
    known = np.sort(np.asarray(known.column("cell")).astype(np.int32))

    back = F.pmod(F.xxhash64("doc_id", F.lit("held back")), F.lit(5)) == 4
    parts = runtime.groups_for(texts, "text", PART_BYTES)
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(parts)).cast("int")
    learners, goals = (df.withColumn("part", part) for df in (texts.select("doc_id", "text").filter(~back), marked.filter(~back)))

    def begin(_: tuple, docs: pa.Table, labels: pa.Table) -> pa.Table:
        course = Course(names.value, np.random.default_rng(5))
        rows, label = _read(docs, labels, course.net)
        course.learn(rows, label, _weights(label, share), EPOCHS)
        return pa.table({"data": pa.array([pickle.dumps(course)], pa.binary())})

    def go_on(key: tuple, docs: pa.Table, labels: pa.Table) -> pa.Table:
        course = pickle.loads(start.value)
        net = course.net
        course.draw = np.random.default_rng([5, key[0].as_py()])
        rows, label = _read(docs, labels, net)
        old, rest = net.embedding.copy(), course.dense()
        course.learn(rows, label, _weights(label, share), LATER_EPOCHS)
        met = sum((np.bincount(r.reshape(-1), minlength=len(net.embedding)) for r in rows), np.zeros(len(net.embedding), np.int64))
        move = (net.embedding - old)[:-1]
        found = np.flatnonzero(move.any(axis=1)).astype(np.int32)
        out = []
        for g in range(GROUPS):
            which = found[found % GROUPS == g]
            if len(which):
                out.append((g, which.tobytes(), met[which].astype(np.float64).tobytes(), (move[which] / UNIT).astype(np.float16).tobytes()))
        if len(rows):
            out.append((GROUPS, np.zeros(1, np.int32).tobytes(), np.array([float(len(rows))]).tobytes(), (course.dense() - rest).tobytes()))
        kinds = (("group", pa.int32()), ("which", pa.binary()), ("weight", pa.binary()), ("data", pa.binary()))
        columns = {c: pa.array([o[i] for o in out], kind) for i, (c, kind) in enumerate(kinds)}
        return pa.table({**columns, "part": pa.array([key[0].as_py()] * len(out), pa.int32())})

    names = spark.sparkContext.broadcast(known)
    together = lambda rule: learners.filter(rule).groupBy("part").cogroup(goals.filter(rule).groupBy("part"))
    first = together("part = 0").applyInArrow(begin, "data binary").collect()
    course = pickle.loads(bytes(first[0].data)) if first else Course(known, np.random.default_rng(5))
    net = course.net
    if parts > 1:
        start = spark.sparkContext.broadcast(pickle.dumps(course))
        learned = together("part > 0").applyInArrow(go_on, "group int, which binary, weight binary, data binary, part int")
        means = learned.groupBy("group").applyInArrow(_average, "which binary, data binary").collect()
        for row in means:
            move, which = np.frombuffer(bytes(row.data), np.float32), np.frombuffer(bytes(row.which), np.int32)
            if len(move) == len(which) * SIZE:
                net.embedding[which] += move.reshape(-1, SIZE)
            else:
                net = _moved(net, move)
    shared = spark.sparkContext.broadcast(Model(net, speech))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, speech = shared.value.net, shared.value.speech
        for batch in batches:
            for x in slices(batch.column(1), SMALL_SLICE // 2):
                step = np.floor(np.clip(net.logits(*features(x)), -MOST, MOST) * GRID).astype(np.int32)
                spoken = language.likeliest(speech, x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x.first, x.rows), pa.array(spoken), pa.array(step)], ["doc_id", "lang", "step"])

    held = texts.select("doc_id", "text").filter(back).mapInArrow(steps, "doc_id long, lang int, step int").join(marked, "doc_id")
    # At most languages times 2 x GRID x MOST rows.
    counts = held.groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("lang", "step").toArrow()
    net.shifts = _shifts(counts, len(speech.languages), net.bias)
    return Model(net, speech)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on), which must be new names (after ``prefix``)."""
    names = [prefix + c for c in ("score", "predicted")]
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {names} must be new; set prefix")
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch.column(at), SMALL_SLICE // 2):
                found = shared.value.scores(x)
                part = batch.slice(x.first, x.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= CUT).astype(np.int32))], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)
