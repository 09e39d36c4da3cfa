"""Stupid-backoff scores of documents against all other documents, by joins of n-gram counts.

A word's score is the relative frequency of the longest n-gram that ends with it and occurs outside the
document; for each step down to a shorter one it is multiplied by ``FACTOR``. Counts are those of the whole
corpus without the document itself (else every n-gram would have been seen). At the bottom stands the
word's own share, and a word that no other document has counts as one word more than there are.

1. *Pages.* Some documents' words become a page: a local dictionary and a code for each word. Pages are
   a table, so that what follows works on the same pages whatever is lost in between.
2. *Counts.* Each page sends its different words and word pairs with their counts, dealt to groups by
   hash; a group adds up its part of the count table. A frequent n-gram is one record for each page.
3. *Join.* A group sends each page the totals of those of its n-grams that other pages have too: a bit for each name
   that it was asked for, and the totals of the set ones. The page knows the names and their order.
4. *Longer n-grams.* Those follow order by order in the same way, but only where both shorter n-grams inside occur outside
   the document: no other one can, and most cannot.
5. *Scores.* Page and totals meet again by page; each document's own counts are taken off, and the scores of
   its words are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import radix, runtime
from annoframe.llm.columns import group_of, packed, unpacked
from annoframe.llm.spans import SMALL_SLICE, hash_spans, mix, rows_of, slices

ORDER = 3
FACTOR = 0.4
PAGE_BYTES = 12 << 20
#: Text bytes for each group of the count tables: some 3 million n-grams.
GROUP_BYTES = 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A page's own row has its documents, words and codes; rows without documents answer a group's names of one order.
_PAGES = "page long, doc_id array<long>, n_words array<long>, n int, group int, a binary, b binary"
_PAGE_SCHEMA = pa.schema(
    [("page", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n", pa.int32()), ("group", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
)
_ASKED = "group int, page long, n int, names binary, counts binary"
_ASKED_SCHEMA = pa.schema([("group", pa.int32()), ("page", pa.int64()), ("n", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    page = (context.partitionId() if context else 0) << 32
    for batch in batches:
        ids = batch.column(0)
        rows, size, words, held = 0, [], [], 0

        def flush(until: int) -> pa.RecordBatch:
            names, code, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")  # frequent words get small codes, which compress well
            rank = np.empty(len(names), np.int64)
            rank[by] = np.arange(len(names))
            row = [[page], [ids.slice(rows, until - rows).to_pylist()], [np.concatenate(size)], [None], [None], [packed(names[by])], [packed(rank[code])]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _PAGE_SCHEMA, strict=True)], schema=_PAGE_SCHEMA)

        # Words are named slice by slice; only their names are gathered for a page.
        for x in slices(batch.column(1), SMALL_SLICE):
            start, end, first = x.words()
            words.append(hash_spans(x.buf, start, end, fold_case=True))
            size.append(np.diff(first))
            held += len(x.buf)
            if held >= PAGE_BYTES or x.first + x.rows == batch.num_rows:
                yield flush(x.first + x.rows)
                page += 1
                rows, size, words, held = x.first + x.rows, [], [], 0


def _grams(words: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: the name of the n-gram that ends at each word, and whether there is one."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out, name = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        # One more word to the left; names of different orders differ.
        shifted = np.zeros(len(words), np.uint64)
        shifted[n - 1 :] = words[: len(words) - n + 1]
        name = mix(name * _STEP + shifted + np.uint64(n))
        out.append((name, place >= n - 1))
    return out


def _page(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = unpacked(row["a"])[unpacked(row["b"], np.int64)]
    return words, np.concatenate([[0], np.cumsum(np.array(row["n_words"], np.int64))])


def _asked(page: int, n: int, name: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """The different names of order ``n`` with their counts, one record for each group; names as differences."""
    names, counts = np.unique(name, return_counts=True)
    group = group_of(names, groups)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut, len(group))[1:], strict=True):
        steps = np.diff(names[a:b], prepend=np.uint64(0))
        cells = [[group[a]], [page], [n], [packed(steps)], [packed(counts[a:b].astype(np.int64))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _ASKED_SCHEMA, strict=True)], schema=_ASKED_SCHEMA)


def _requests(batches: Iterator[pa.RecordBatch], order: int, groups: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for n, (name, has) in enumerate(_grams(*_page(row), order), 1):
                yield from _asked(row["page"], n, name[has], groups)


def _totals(found: pa.Table) -> pa.Table:
    """For each record which of its names other pages have too, a bit each, and the totals of those."""
    cells = [np.cumsum(unpacked(c), dtype=np.uint64) for c in found.column("names").to_pylist()]
    names = np.concatenate(cells)
    counts = np.concatenate([unpacked(c, np.int64) for c in found.column("counts").to_pylist()])
    order = np.argsort(names, kind="stable")
    start = np.flatnonzero(radix.starts(names[order]))
    size = np.diff(np.append(start, len(names)))
    total, several = np.empty(len(names), np.int64), np.empty(len(names), bool)
    total[order] = np.repeat(np.add.reduceat(counts[order], start), size)
    several[order] = np.repeat(size > 1, size)
    cut = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
    some = [i for i in range(len(cells)) if several[cut[i] : cut[i + 1]].any()]
    none = [None] * len(some)
    page, n, group = (np.asarray(found.column(c))[some] for c in ("page", "n", "group"))
    hits = [several[cut[i] : cut[i + 1]] for i in some]
    bits = [np.packbits(h).tobytes() for h in hits]
    columns = [page, none, none, n, group, bits, [packed(total[cut[i] : cut[i + 1]][h]) for i, h in zip(some, hits, strict=True)]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAGE_SCHEMA, strict=True)], schema=_PAGE_SCHEMA)


class _Counts:
    """A page's words with the counts of its n-grams outside each word's document, order by order."""

    def __init__(self, rows: list[dict], groups: int):
        self.row = next(r for r in rows if r["doc_id"] is not None)
        self.told, self.groups = [r for r in rows if r["doc_id"] is None], groups
        self.words, self.first = _page(self.row)
        self.doc = rows_of(self.first, len(self.words))

    def answered(self, n: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the different ``names`` asked for that other pages have too, and their totals."""
        hit, totals = np.zeros(len(names), bool), []
        edges = np.searchsorted(group_of(names, self.groups), np.arange(self.groups + 1))
        for r in sorted((r for r in self.told if r["n"] == n), key=lambda r: r["group"]):
            a, b = edges[r["group"]], edges[r["group"] + 1]
            hit[a:b] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=b - a)
            totals.append(unpacked(r["b"], np.int64))
        return names[hit], np.concatenate(totals or [np.zeros(0, np.int64)])

    def outside(self, n: int, name: np.ndarray, has: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """How often the n-gram that ends at each word occurs in other documents; ``asked`` are those that groups were asked for."""
        kinds, code, count = np.unique(name[has], return_inverse=True, return_counts=True)
        names, totals = self.answered(n, kinds if asked is has else np.unique(name[asked]))
        count[np.searchsorted(kinds, names)] = totals
        _, pair, own = np.unique(code * (len(self.first) - 1) + self.doc[has], return_inverse=True, return_counts=True)
        left = np.zeros(len(name), np.int64)
        left[has] = count[code] - own[pair]
        return left

    def orders(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """The counts outside of each order's n-grams."""
        left = None
        for n, (name, has) in enumerate(grams, 1):
            left = self.outside(n, name, has, _asked_for(n, has, left))
            yield left


def _asked_for(n: int, has: np.ndarray, left: np.ndarray | None) -> np.ndarray:
    """Which n-grams groups are asked for: from order 3 on those whose two shorter ones occur outside their document."""
    return has if n < 3 or not len(has) else has & (left > 0) & np.r_[False, left[:-1] > 0]


def _longer(found: pa.Table, n: int, groups: int) -> pa.Table:
    """Requests for the n-grams of order ``n``."""
    counts = _Counts(found.to_pylist(), groups)
    grams = _grams(counts.words, counts.first, n)
    *_, left = counts.orders(grams[:-1])
    name, has = grams[-1]
    parts = list(_asked(counts.row["page"], n, name[_asked_for(n, has, left)], groups))
    return pa.Table.from_batches(parts, schema=_ASKED_SCHEMA)


def _asking(n: int, groups: int) -> Callable[[pa.Table], pa.Table]:
    return lambda found: _longer(found, n, groups)


def _scores(rows: list[dict], order: int, factor: float, all_words: int, groups: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("longest", pa.int64())])
    counts = _Counts(rows, groups)
    first, doc, size = counts.first, counts.doc, np.diff(counts.first)
    others = (all_words - size)[doc]
    score = np.log(1.0 / (others + 1)) + order * np.log(factor)
    context, longest = others, np.zeros(len(doc), np.int64)
    for n, left in enumerate(counts.orders(_grams(counts.words, first, order)), 1):
        seen = left > 0
        score[seen] = np.log(left[seen] / context[seen]) + (order - n) * np.log(factor)
        longest[seen] = n
        # The context of the next order is this n-gram without the next word: it ends one word before.
        context = np.r_[0, left[:-1]]
    total = np.concatenate([[0.0], np.cumsum(score)])
    full = np.concatenate([[0], np.cumsum(longest == order)])
    columns = [counts.row["doc_id"], size, total[first[1:]] - total[first[:-1]], full[first[1:]] - full[first[:-1]]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def score(docs: DataFrame, *, order: int = ORDER, factor: float = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, longest, mean_log_score), one row for each row of ``docs``.

    ``log_score`` is the sum of the words' natural logarithms (A-Z count as a-z), ``longest`` the number of words
    whose n-gram of full order was found elsewhere. A null or empty text has no words, sum 0 and a null mean.
    Each row is a document: copies have seen each other, also under the same or a null id. Only the two named
    columns are read. The first word of a text has no n-gram but itself, and so on; it backs off from ``order``.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = runtime.groups_for(rows, "text", GROUP_BYTES)
    pages = runtime.table(rows.mapInArrow(_pages, _PAGES))
    n = pages.agg(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    asked = pages.mapInArrow(lambda b: _requests(b, min(order, 2), groups), _ASKED)
    # Pages and what they were told so far: dealt out by page once for all that follows.
    known = pages.union(asked.groupBy("group").applyInArrow(_totals, _PAGES))
    more = None
    for k in range(3, order + 1):
        if more is not None:
            known, more = known.union(more), None
        asked = known.groupBy("page").applyInArrow(_asking(k, groups), _ASKED)
        more = asked.groupBy("group").applyInArrow(_totals, _PAGES)
    kind = "doc_id long, n_words long, log_score double, longest long"
    if more is None:
        scored = known.groupBy("page").applyInArrow(lambda t: _scores(t.to_pylist(), order, factor, n, groups), kind)
    else:
        scored = known.groupBy("page").cogroup(more.groupBy("page")).applyInArrow(
            lambda a, b: _scores(a.to_pylist() + b.to_pylist(), order, factor, n, groups), kind
        )
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
