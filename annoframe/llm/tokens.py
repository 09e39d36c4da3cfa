"""Token ids of whole texts at the cost of their distinct chunks.

Public BPE tokenizers split a text before they merge, and merges never cross such a split. Texts are
therefore cut where every supported pattern splits as well (``cuts``); each distinct chunk is
encoded once by the library, and a text's ids are gathered from those of its chunks. The result is
that of encoding the whole text: a text that holds one of the tokenizer's own special strings, which
could span chunks, is given to the library whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from annoframe.llm.spans import Texts, hash_spans, ranges

#: A worker forgets its chunks when it has met this many; they are then encoded anew.
CHUNKS_KEPT = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# ASCII punctuation other than the apostrophe, which can begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
# First bytes of characters that are surely no white space: ASCII ones, and U+00C0 to U+00FF.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[0xC3] = True


def cuts(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start of each chunk, and each row's first chunk.

    A chunk begins with a row; at a space or a line feed before a solid character, and after such a
    line feed; and between an ASCII letter and a mark.
    """
    buf, n = x.buf, len(x.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(x.rows + 1, np.int64)
    begins = np.zeros(n + 1, bool)
    solid, letter, mark = _SOLID[buf], _LETTER[buf], _MARK[buf]
    ahead = np.zeros(n, bool)
    ahead[:-1] = solid[1:]
    ahead[x.at[1:-1][x.at[1:-1] > 0] - 1] = False  # the next character is another row's
    feed = (buf == 10) & ahead
    begins[:-1] = ((buf == 32) | (buf == 10)) & ahead
    begins[1:] |= feed
    begins[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    begins[x.at] = True
    start = np.flatnonzero(begins[:-1])
    return start, np.searchsorted(start, x.at)


class Coder:
    """Encodes slices of texts; ``encode`` gives the ids of some strings, ``special`` strings it treats apart."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: tuple[str, ...] = ()):
        self.encode, self.special = encode, tuple(s.encode() for s in special)
        self.forget()

    def forget(self) -> None:
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def learn(self, names: np.ndarray, chunks: list[bytes]) -> None:
        found = self.encode([c.decode("utf-8", "replace") for c in chunks])
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = len(self.start) + np.arange(len(found))
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(flat)
        at = np.searchsorted(self.names, names)
        self.names, self.place = np.insert(self.names, at, names), np.insert(self.place, at, place)

    def __call__(self, x: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and where each row's begin (one more entry than rows)."""
        start, first = cuts(x)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(x.rows + 1, np.int64)
        end = np.append(start[1:], len(x.buf))
        names, pick, inverse = np.unique(hash_spans(x.buf, start, end), return_index=True, return_inverse=True)
        if len(self.names) > CHUNKS_KEPT:
            self.forget()
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        if not known.all():
            data = x.buf.tobytes()
            self.learn(names[~known], [data[start[i] : end[i]] for i in pick[~known]])
            at = np.searchsorted(self.names, names)
        place = self.place[at][inverse]
        length = self.length[place]
        ids = self.ids[ranges(self.start[place], length)]
        first = np.concatenate([[0], np.cumsum(length)])[first]
        return self._apart(x, ids, first) if self.special else (ids, first)

    def _apart(self, x: Texts, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = x.buf.tobytes()
        if not any(s in data for s in self.special):
            return ids, first
        rows = []
        for i in range(x.rows):
            text = data[x.at[i] : x.at[i + 1]]
            whole = any(s in text for s in self.special)
            rows.append(np.array(self.encode([text.decode()])[0], np.uint32) if whole else ids[first[i] : first[i + 1]])
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(maxsize=4)
def library_coder(path: str) -> Coder:
    """A coder of the tokenizers library for a vocabulary file; one for each worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return Coder(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], special)


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with ``end_id`` after its ids."""
    return np.insert(ids, first[1:], end_id), first + np.arange(len(first))


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
