"""Substring dedup by recompression: repeats of at least ``WINDOW`` words are found by shared symbols.

*Rounds.* A text is a row of symbols, at first its words, named by their hash. Each round replaces
maximal runs of one symbol, then pairs whose left symbol is on the round's left side and whose right
symbol is on its right side (the side is a bit of the name). A new symbol's name is a function of what
it replaces, so names are the same in all tasks and documents, and equal stretches of text get the
same symbols except near their ends. How near is kept with each symbol: the range of words that its
being there depends on.

*Shared symbols.* A window of 13 words holds in any document the same symbols that depend on nothing
outside it. Of those its anchor is the one of the highest level (of the smallest name if there are
several; a word is the last resort). Spark counts anchors over all documents: a window whose anchor
occurs in one document only cannot be a repeat. This leaves few windows besides the real repeats.

*Verification.* What is left is named by its 13 words, and each name's smallest document is found. A window
that also starts in a smaller document goes; a word goes if such a window covers it.

Each exchange sends one record for each name and batch, to a group by range of names. Texts that no
shared anchor occurs in take no part after the first exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import runtime
from annoframe.llm.columns import group_of, joined, planes
from annoframe.llm.spans import SMALL_SLICE, Texts, hash_spans, mix, rows_of, slices

WINDOW = 13
ROUNDS = 4
GROUP_BYTES = 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_MANY = np.iinfo(np.int64).min
_RECORDS = "group int, names binary, owners binary, doc_id long, own array<long>"


def words_of(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The name of each word, and each row's first word."""
    start, end, first = x.words()
    return hash_spans(x.buf, start, end), first


def windows_of(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of the window that starts at each word, and whether it is one (it ends within its row)."""
    n = len(words)
    if n < length:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    row_end = np.repeat(first[1:], np.diff(first))
    names = np.zeros(n, np.uint64)
    for k in range(length):
        names[: n - length + 1] = names[: n - length + 1] * _STEP + words[k : n - length + 1 + k]
    return mix(names), np.arange(n) + length <= row_end


def anchors(words: np.ndarray, first: np.ndarray, length: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of the window that starts at each word (of any use only where there is such a window)."""
    n = len(words)
    row = rows_of(first, n)
    name, begin, end = words, np.arange(n), np.arange(n) + 1  # of each symbol: words begin .. end - 1
    low, high = begin, end  # it depends on words low .. high - 1
    levels = [(words, low, high)]
    for level in range(rounds):
        # Runs. A symbol ends a run if the next one differs; often the next word shows that already.
        same = (name[1:] == name[:-1]) & (row[begin[1:]] == row[begin[:-1]])
        starts = np.flatnonzero(np.r_[True, ~same])
        stops = np.append(starts[1:], len(name)) - 1
        count = stops - starts + 1
        after, before = np.minimum(end, n - 1), np.maximum(begin - 1, 0)
        next_tells = (words[after] != words[begin]) | (end >= n)
        last_tells = (words[before] != words[end - 1]) | (begin == 0)
        up = np.where(next_tells, np.maximum(high, end + 1), np.maximum(high, np.r_[high[1:], n + 1]))
        down = np.where(last_tells, np.minimum(low, begin - 1), np.minimum(low, np.r_[-1, low[:-1]]))
        run = count > 1
        new = np.where(run, mix(name[starts] * _STEP + count.astype(np.uint64)), name[starts])
        lows, highs = np.minimum.reduceat(down, starts), np.maximum.reduceat(up, starts)
        begins, ends = begin[starts], end[stops]
        made = [(new[run], lows[run], highs[run])]
        # Pairs.
        side = (mix(new + np.uint64((level + 1) * int(_PAIR) % (1 << 64))) & np.uint64(1)).astype(bool)  # right side
        left = np.zeros(len(new), bool)
        left[:-1] = ~side[:-1] & side[1:] & (row[begins[1:]] == row[begins[:-1]])
        right = np.r_[False, left[:-1]]
        # A symbol that stays depends on the neighbour that it does not pair with.
        lone_low = np.where(side, np.minimum(lows, np.r_[-1, lows[:-1]]), lows)
        lone_high = np.where(side, highs, np.maximum(highs, np.r_[highs[1:], n + 1]))
        at = np.flatnonzero(left)
        pair = mix(new[at] * _PAIR + new[at + 1] * _STEP + np.uint64(level))
        made.append((pair, np.minimum(lows[at], lows[at + 1]), np.maximum(highs[at], highs[at + 1])))
        keep = ~right
        name, begin, end = new.copy(), begins, ends.copy()
        low, high = lone_low, lone_high
        name[at], end[at] = pair, ends[at + 1]
        low[at], high[at] = made[1][1], made[1][2]
        name, begin, end, low, high = name[keep], begin[keep], end[keep], low[keep], high[keep]
        levels.append(tuple(np.concatenate(c) for c in zip(*made, strict=True)))
    best = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for names, low, high in reversed(levels[1:]):
        fits = (high - low <= length) & (low >= 0)
        names, low, high = names[fits], low[fits], high[fits]
        least = np.full(n, none)
        for k in range(length):
            inside = (low - k >= high - length) & (low - k >= 0)
            names, low, high = names[inside], low[inside], high[inside]
            np.minimum.at(least, low - k, names)
        found = open_ & (least != none)
        best[found] = least[found]
        open_ &= ~found
    if open_.any():
        least = np.full(n, none)
        for k in range(min(length, n)):
            np.minimum(least[: n - k], words[k:], out=least[: n - k])
        best[open_] = least[open_]
    return best


def _per_batch(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, owner) pairs, by name and then owner."""
    order = np.lexsort((owner, names))
    names, owner = names[order], owner[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    return names[new], owner[new]


def _records(names: np.ndarray, owners: np.ndarray, docs: np.ndarray, own: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Records of (name, owner), sorted by name, for the groups; and what batches know already of (doc, name)."""
    schema = pa.schema([("group", pa.int32()), ("names", pa.binary()), ("owners", pa.binary()), ("doc_id", pa.int64()), ("own", pa.list_(pa.int64()))])
    group = group_of(names, groups)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut, len(group))[1:], strict=True):
        row = [[group[a]], [planes(names[a:b])], [planes(owners[a:b])], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)
    if len(docs):
        order = np.argsort(docs, kind="stable")
        docs, own = docs[order], own[order]
        start = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(docs)), pa.int32()), pa.array(own.view(np.int64)))
        none = pa.nulls(len(start), pa.binary())
        where = pa.array((docs[start] % groups).astype(np.int32))
        yield pa.RecordBatch.from_arrays([where, none, none, pa.array(docs[start], pa.int64()), lists], schema=schema)


def _anchor_records(batches: Iterator[pa.RecordBatch], length: int, rounds: int, groups: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, owner = batch.column(0).to_numpy(), [], []
        for x in slices(batch.column(1), SMALL_SLICE):
            words, first = words_of(x)
            real = windows_of(words, first, length)[1]
            found = anchors(words, first, length, rounds)[real]
            row = x.first + rows_of(first, len(words))[real]
            new = np.ones(len(found), bool)  # neighbouring windows mostly have the same anchor
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            names.append(found[new])
            owner.append(ids[row[new]])
        name, own = _per_batch(np.concatenate(names), np.concatenate(owner))
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(name)))
        twice = np.repeat(count > 1, count)
        yield from _records(name[start], np.where(count > 1, _MANY, own[start]), own[twice], name[twice], groups)


def _inside(names: np.ndarray, row: np.ndarray, lists: pa.Array, rows: int) -> np.ndarray:
    """Whether each name is in the list of its row."""
    lists = lists.fill_null([])
    size = np.diff(np.asarray(lists.offsets))
    held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    key = lambda name, of: mix(name + of.astype(np.uint64) * _PAIR)
    return np.isin(key(names, row), key(held, np.repeat(np.arange(rows), size)))


def _window_records(batches: Iterator[pa.RecordBatch], length: int, rounds: int, groups: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, owner = batch.column(0).to_numpy(), [], []
        for x in slices(batch.column(2), SMALL_SLICE):
            words, first = words_of(x)
            window, real = windows_of(words, first, length)
            row = rows_of(first, len(words))[real]
            found = anchors(words, first, length, rounds)[real]
            near = _inside(found, row, batch.column(1).slice(x.first, x.rows), x.rows)
            names.append(window[real][near])
            owner.append(ids[x.first + row[near]])
        name, own = _per_batch(np.concatenate(names), np.concatenate(owner))
        new = np.r_[True, name[1:] != name[:-1]] if len(name) else np.zeros(0, bool)
        yield from _records(name[new], own[new], own[~new], name[~new], groups)


def _answers(found: pa.Table, later: bool) -> pa.Table:
    """(doc_id, own): the names of each document that other documents hold too; ``later``: smaller ones."""
    known = found.column("doc_id").is_valid()
    rest = found.filter(pa.compute.invert(known))
    names, owners = joined(rest.column("names").to_pylist()), joined(rest.column("owners").to_pylist(), np.int64)
    order = np.lexsort((owners, names))
    names, owners = names[order], owners[order]
    new = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(names)))
    if later:
        # One record of the smallest document of each batch; records of the smallest of all stay.
        tell = owners > np.repeat(owners[start], count)
    else:
        # A name is shared if it has two owners, or a batch that said so.
        shared = (owners[start] == _MANY) | (owners[start + count - 1] != owners[start])
        tell = np.repeat(shared, count) & (owners != _MANY)
    known_lists = found.filter(known).column("own").combine_chunks()
    size = np.diff(np.asarray(known_lists.offsets)) if len(known_lists) else np.zeros(0, np.int64)
    docs = np.concatenate([np.repeat(found.filter(known).column("doc_id").to_numpy(), size), owners[tell]])
    own = np.concatenate([known_lists.flatten().to_numpy(), names[tell].view(np.int64)])
    return pa.table([pa.array(docs, pa.int64()), pa.array(own, pa.int64())], ["doc_id", "own"])


def _told(records: DataFrame, later: bool) -> DataFrame:
    answers = records.groupBy("group").applyInArrow(lambda t: _answers(t, later), "doc_id long, own long")
    return answers.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("own").alias("_own"))


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, keep: list[str], window: int, rounds: int) -> DataFrame:
    """(_doc, _text, *keep, _own): ``_own`` has the names of those of a document's windows that start in a smaller one too.

    Both joins take the same rows with the same columns, so that Spark deals the texts out once for both.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"), *keep)
    known = rows.filter("_doc is not null")
    groups = runtime.groups_for(known, "_text", GROUP_BYTES)
    texts = known.select("_doc", "_text")
    shared = _told(texts.mapInArrow(lambda b: _anchor_records(b, window, rounds, groups), _RECORDS), False)
    near = known.join(shared, "_doc").select("_doc", "_own", "_text", *keep)
    found = _told(near.mapInArrow(lambda b: _window_records(b, window, rounds, groups), _RECORDS), True)
    lone = rows.filter("_doc is null").withColumn("_own", F.lit(None).cast("array<bigint>"))
    return known.join(found, "_doc", "left").select(*lone.columns).union(lone)


def _kept(x: Texts, lists: pa.Array, length: int) -> Iterator[tuple[bytes, int, int]]:
    """Each row's kept words joined by one space, its number of words, and that of removed words."""
    words, first = words_of(x)
    window, real = windows_of(words, first, length)
    row = rows_of(first, len(words))
    gone = real.copy()
    gone[real] = _inside(window[real], row[real], lists, x.rows)
    # A word goes if a window that starts at it or at most length - 1 words before goes.
    mark = np.zeros(len(words) + 1, np.int64)
    where = np.flatnonzero(gone)
    np.add.at(mark, where, 1)
    np.add.at(mark, np.minimum(where + length, len(words)), -1)
    stays = np.cumsum(mark[:-1]) == 0
    data = x.buf.tobytes()
    for i in range(x.rows):
        a, b = first[i], first[i + 1]
        text = data[x.at[i] : x.at[i + 1]].split()
        kept = int(stays[a:b].sum())
        yield b" ".join(text if kept == b - a else compress(text, stays[a:b].tolist())), int(b - a), int(b - a) - kept


def digests(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    A null or empty text has no words. Texts of fewer than ``window`` words lose nothing. Rows that
    repeat an id belong to one document: they never take words from each other. A row without id
    loses nothing, and nothing is lost to it. Other columns are not read.
    """
    whole = _with_repeats(docs, id_col, text_col, [], window, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch.column(1), SMALL_SLICE):
                kept = list(_kept(x, batch.column(2).slice(x.first, x.rows), window))
                columns = [batch.column(0).slice(x.first, x.rows), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated stretches taken out of the texts.

    A text that loses words becomes its kept words joined by one space, maybe none; every other text,
    null included, and all other columns stay as they are. Cases as in ``digests``.
    """
    names = docs.columns
    keep = [c for c in names if c != text_col]
    whole = _with_repeats(docs, id_col, text_col, keep, window, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch.column(1), SMALL_SLICE):
                part = batch.slice(x.first, x.rows)
                kept = list(_kept(x, part.column(part.num_columns - 1), window))
                old = part.column(1)
                text = pa.array([k[0].decode("utf-8", "replace") if k[2] else old[i].as_py() for i, k in enumerate(kept)], old.type)
                others = dict(zip(keep, part.columns[2:-1], strict=True))
                yield pa.RecordBatch.from_arrays([text if c == text_col else others[c] for c in names], names)

    return whole.mapInArrow(run, docs.schema)
