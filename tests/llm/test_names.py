"""Names of spans: strings that a polynomial modulo a power of two can't tell apart, and long texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from annoframe.llm import bpe, ngram_join, packing, recompress, runtime, simple8b, spans
from tests.llm import brute


def thue_morse(first, second, size=2048):
    signs = [0]
    while len(signs) < size:
        signs += [1 - x for x in signs]
    return "".join(first if x == 0 else second for x in signs)


A, B = thue_morse("a", "b"), thue_morse("b", "a")
TOGETHER = [(1, A), (2, B), (3, f"{A} {A} {B}"), (4, f"x {B} " + " ".join(["y", A, B] * 10)), (5, " ".join(["y", B, A] * 10))]


def test_names_differ_and_do_not_depend_on_place():
    draw = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 16, 63, 64, 65, 200):
        texts = [bytes(draw.integers(65, 70, size).astype(np.uint8)) for _ in range(50)]
        buf = np.frombuffer(b"?".join(texts) + b"??", np.uint8)
        start = np.arange(50) * (size + 1)
        names = spans.hash_spans(buf, start, start + size)
        assert len(set(names.tolist())) == len(set(texts))
        assert (names == [spans.hash_spans(np.frombuffer(t, np.uint8), np.array([0]), np.array([size]))[0] for t in texts]).all()
        assert (spans.hash_spans(buf, start, start + size, fold_case=True) == spans.hash_spans(np.frombuffer(bytes(buf).lower(), np.uint8), start, start + size)).all()


@pytest.mark.parametrize("parts", [1, 3])
def test_strings_that_only_look_alike_stay_apart(spark, parts):
    docs = brute.table(spark, TOGETHER).repartition(parts)
    got = brute.rows(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_classes(TOGETHER)
    got = brute.rows(recompress.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute.kept_words(TOGETHER))
    byte, word, ranks = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    path = runtime.folder(spark)
    simple8b.write_ids(docs, path, byte, end_id=2)
    tokenizer = Tokenizer.from_file(byte)
    want = [(i, crc([*tokenizer.encode(t, add_special_tokens=False).ids, 2])) for i, t in TOGETHER]
    assert brute.rows(simple8b.read_ids(spark, path, digest=True), "doc_id", "ids_crc32") == want
    tokenizer = Tokenizer.from_file(word)
    want = [(i, crc([*tokenizer.encode(t, add_special_tokens=False).ids, 1])) for i, t in TOGETHER]
    out = packing.best_fit(docs, word, end_id=1, capacity=1 << 20)
    assert brute.rows(out, "doc_id", "ids_crc32") == want
    v = bpe.vocabulary(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(docs.drop("ids"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text
