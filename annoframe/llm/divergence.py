"""Audit of sources: how far the terms of each (lang, source) group lie from those of its language.

*Counting.* Tasks cut whole texts into terms and count them by group. Terms of up to 8 bytes become one 64-bit
word, of up to 16 two, and are put in order by radix passes; runs of equal words are then counted. Longer
terms lie in one bucket for each length, ordered by their bytes. A task adds up its own counts within a fixed number of
entries and sends one row for each group and term of what it holds. Spark sums them by (lang, source, term), so that
a frequent term is as many keys as it has sources, and then takes the documents of each (lang, term) together.

*Shares.* A kept term's share in a group is 1 + floor(10^9 (n + 2) / (N + 2 V)), so that a term that does not occur has
a share too. The distance of two groups sums over all kept terms of the language. It is not formed term by term:
with f the summand and 0 the share of an absent term,

    sum = V f(0,0) + sum over a's terms of (f(p,0) - f(0,0)) + the same for b
          + sum over terms of both of (f(p,q) - f(p,0) - f(0,q) + f(0,0)).

The sums over one group's terms need only how many of its terms have each count. Terms of both are paired inside
Arrow tasks, term by term in bounded blocks, and added up before any shuffle. All numbers are integers.

Nulls in text, lang and source count as ''. Equal rows are documents of their own, ids are not used, and an empty
table gives no rows. A language none of whose terms is in ``least_docs`` documents has distances 0 and no terms. Equal
values are ranked by the UTF-8 bytes of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.llm import radix, runtime
from annoframe.llm.spans import SMALL_SLICE, Blocks, lower, ranges, rows_of, runs, slices

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: A task sends its counts on when it holds this many after adding up.
HELD = 1 << 20
#: Pairs of groups formed at a time for the terms they share.
BLOCK = 1 << 20
#: Parts into which the groups of one language are dealt where they meet each other.
SALTS = 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_COUNTS = "lang string, source string, term string, n long, docs long"


def _text_of(words: np.ndarray) -> pa.Array:
    """The strings of terms held as rows of one or two words."""
    letters = np.ascontiguousarray(words, dtype="<u8").view(np.uint8).reshape(len(words), -1)
    used = letters != 0
    at = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(letters[used]))


class _Held:
    """Counts by (group, term) of terms that are rows of the same number of 64-bit words."""

    def __init__(self, words: int):
        self.words, self.parts, self.rows = words, [], 0

    def add(self, group: np.ndarray, words: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((group, words, n, docs))
        self.rows += len(group)

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts as one, each (group, term) once."""
        group, words, n, docs = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        at = radix.order(*words.T, group)
        group, words, n, docs = group[at], words[at], n[at], docs[at]
        first = np.flatnonzero(radix.starts(group, *words.T))
        out = group[first], words[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)
        self.parts, self.rows = [out], len(first)
        return out


def _runs(row: np.ndarray, group: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences ordered by term, group and row: where each (term, group) begins, its occurrences and its rows."""
    begins = new.copy()
    begins[1:] |= group[1:] != group[:-1]
    first = np.flatnonzero(begins)
    begins[1:] |= row[1:] != row[:-1]
    return first, np.diff(np.append(first, len(row))), np.add.reduceat(begins.astype(np.int64), first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[str, str], int] = {}
    short, two, long_, long_bytes = _Held(1), _Held(2), {}, 0

    def sent(group: np.ndarray, text: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        names = list(numbers)
        lang, source = (pa.array([k[i] for k in names], pa.string()).take(pa.array(group)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, text, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def flush(held: _Held) -> Iterator[pa.RecordBatch]:
        group, words, n, docs = held.summed()
        for i in range(0, len(group), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield sent(group[part], _text_of(words[part]), n[part], docs[part])
        held.parts, held.rows = [], 0

    def flush_long() -> Iterator[pa.RecordBatch]:
        keys, found = list(long_), np.array(list(long_.values()), np.int64)
        text = pa.array([k[1] for k in keys], pa.binary()).cast(pa.string())
        yield sent(np.array([k[0] for k in keys]), text, found[:, 0], found[:, 1])
        long_.clear()

    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        number = np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int64)
        for x in slices(batch.column(2), SMALL_SLICE):
            start, end, first = runs(x, _LETTER)
            if not len(start):
                continue
            # Occurrences by group, and by row within it: later orders are stable and keep that.
            row = rows_of(first, len(start))
            at = radix.order(number[x.first + row].astype(np.uint64))
            start, length, row = start[at], (end - start)[at], row[at]
            group = number[x.first + row]
            buf = lower(x.buf)
            block = Blocks(buf)
            for held, low, high in ((short, 0, 8), (two, 8, 16)):
                pick = np.flatnonzero((length > low) & (length <= high))
                if not len(pick):
                    continue
                words = np.stack([block(start[pick] + 8 * k, length[pick] - 8 * k) for k in range(held.words)], axis=1)
                at = radix.order(*words.T)
                pick, words = pick[at], words[at]
                begin, n, docs = _runs(row[pick], group[pick], radix.starts(*words.T))
                held.add(group[pick][begin], words[begin], n, docs)
                if held.rows > HELD:
                    held.summed()
                    if held.rows > HELD // 2:
                        yield from flush(held)
            pick = np.flatnonzero(length > 16)
            for size in np.unique(length[pick]).tolist():
                same = pick[length[pick] == size]
                rows = buf[ranges(start[same], np.full(len(same), size))].view(f"S{size}")
                at = np.argsort(rows, kind="stable")
                rows, same = rows[at], same[at]
                begin, n, docs = _runs(row[same], group[same], radix.starts(rows))
                for g, t, a, b in zip(group[same][begin].tolist(), rows[begin].tolist(), n.tolist(), docs.tolist(), strict=True):
                    old = long_.get((g, t))
                    long_bytes += 0 if old else size
                    long_[g, t] = (old[0] + a, old[1] + b) if old else (a, b)
            if long_bytes > HELD * 16 or len(long_) > HELD // 4:
                yield from flush_long()
                long_bytes = 0
    for held in (short, two):
        if held.rows:
            yield from flush(held)
    if long_:
        yield from flush_long()


def counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms that are in at least ``least_docs`` documents of their language."""
    runtime.ship(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return found.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n")


def _share(n: Column | str, whole: str, kept: str) -> Column:
    top = f"(cast({n} as decimal(20,0)) + 2) * {SCALE}"
    return F.expr(f"case when {kept} > 0 then 1 + ({top}) div (cast({whole} as decimal(20,0)) + 2 * {kept}) end")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the terms of each batch, what pairs of sources add by having a term both."""
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    total: dict[tuple[str, str, str], int] = {}

    def sent() -> pa.RecordBatch:
        a, b, c = zip(*total, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in (a, b, c)] + [pa.array(list(total.values()), pa.int64())], ["lang", "a", "b", "value"])

    for batch in batches:
        parts = batch.column(1)
        at = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
        flat = parts.flatten()
        lang = batch.column(0).dictionary_encode()
        source = flat.field("source").dictionary_encode()
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        code = source.indices.to_numpy().astype(np.int64)
        lang_of = np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(at))
        p, zero = (flat.field(c).to_numpy() for c in ("p", "zero"))
        # Each entry meets the later ones of its term.
        partners = np.repeat(at[1:], np.diff(at)) - np.arange(len(code)) - 1
        done = np.concatenate([[0], np.cumsum(partners)])
        i = 0
        while i < len(code):
            j = max(i + 1, int(np.searchsorted(done, done[i] + BLOCK, side="right")) - 1)
            left = np.repeat(np.arange(i, j), partners[i:j])
            right = ranges(np.arange(i + 1, j + 1), partners[i:j])
            value = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
            key = (lang_of[left] * len(sources) + code[left]) * len(sources) + code[right]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(radix.starts(key)) if len(key) else np.zeros(0, np.int64)
            for k, v in zip(key[first].tolist(), np.add.reduceat(value, first).tolist() if len(first) else [], strict=True):
                rest, b = divmod(k, len(sources))
                name = (langs[rest // len(sources)], sources[rest % len(sources)], sources[b])
                total[name] = total.get(name, 0) + v
            i = j
            if len(total) > HELD:
                yield sent()
                total.clear()
    if total:
        yield sent()


def audit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance to every other source of its language (``pair``),
    and its ``top`` terms above the language's share (``term``)."""
    kept = runtime.table(counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, least_docs=least_docs))
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_whole"))
    whole = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = groups.join(whole, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["whole", "kept", "lang_whole"])
    groups = runtime.table(groups.withColumn("zero", _share("0", "whole", "kept")))

    entries = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "whole", "kept"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    high = entries.join(by_term, ["lang", "term"]).withColumn("q", _share("lang_n", "lang_whole", "kept")).filter("p > q")
    high = high.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    high = high.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # Groups of one language meet each other: one side is dealt over salts, the other is repeated for each.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), salts.alias("salt"))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    base = groups.withColumn("salt", salt("source")).join(other, ["lang", "salt"]).filter("source <> b")
    base = base.select("lang", F.col("source").alias("a"), "b", F.coalesce(F.col("kept") * _f("zero", "zero_b"), F.lit(0)).alias("value"))
    alike = entries.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("terms"))
    alone = alike.withColumn("salt", salt("source", "n")).join(other, ["lang", "salt"]).filter("source <> b")
    alone = alone.select("lang", F.col("source").alias("a"), "b", (F.col("terms") * (_f("p", "zero_b") - _f("zero", "zero_b"))).alias("value"))
    sets = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("parts")).filter("size(parts) > 1").select("lang", "parts")
    both = sets.mapInArrow(_shared, "lang string, a string, b string, value long")
    turned = lambda d: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    pairs = base.union(alone).union(turned(alone)).union(both).union(turned(both))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(ranked)).union(high)
