import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from annoframe.llm import backoff, bpe, language, ngram_join, packing, recompress, runtime, simple8b
from annoframe.llm.spans import slices
from tests.llm import brute

BYTE, WORD, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def random_texts(seed, n=60):
    """Texts over few words, so that near copies, chains of links and repeated stretches are common."""
    draw = random.Random(seed)
    stock = [[f"{draw.choice('abcdefgh')}{draw.randint(0, 3)}" for _ in range(draw.randint(3, 80))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(draw.choice(stock))
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = f"x{draw.randint(0, 50)}"
        if draw.random() < 0.5:
            w = w[: draw.randint(1, len(w))] + draw.choice(stock)[: draw.randint(0, 30)]
        out.append((i * 3, " ".join(w)))
    return out


@pytest.mark.parametrize("pairs", [brute.odd_texts(), random_texts(1), random_texts(2)], ids=["odd", "random 1", "random 2"])
def test_jaccard_classes_are_those_of_all_pairs(spark, pairs):
    got = brute.rows(ngram_join.classes(brute.table(spark, pairs)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_classes(pairs)


def test_jaccard_rounds_end_with_short_lists_of_leaders(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    base = [f"w{i}" for i in range(100)]
    pairs = [(i, " ".join([*base[:i], f"u{i}", *base[i + 1 :]])) for i in range(40)]
    got = brute.rows(ngram_join.classes(brute.table(spark, pairs)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_classes(pairs)


def test_jaccard_of_rows_without_id_and_of_an_empty_table(spark):
    docs = brute.table(spark, [(None, "a b c d e f"), (2, "a b c d e f")])
    assert brute.rows(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id") == [(2, 2, 2), (None, 2, None)]
    assert ngram_join.classes(docs.limit(0)).collect() == []
    one = ngram_join.one_of_each(brute.table(spark, brute.odd_texts()))
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {1, 4, 5, 6, 7, 9, 10, 13, 14, 15, 16} - {2}


def test_one_of_each_decides_row_by_row(spark):
    near = [f"w{i}" for i in range(60)]
    copy, other = " ".join(near), " ".join(["z", *near[1:]])
    pairs = [(1, copy), (2, other), (2, "a unique text of id two"), (3, copy), (3, copy), (4, "own"), (4, "own"), (5, ""), (5, ""), (None, copy), (None, "no id at all"), (6, None)]
    docs = brute.table(spark, pairs)
    got = brute.rows(ngram_join.one_of_each(docs), "doc_id", "text")
    want = [(1, copy), (2, "a unique text of id two"), (4, "own"), (5, ""), (6, None), (None, "no id at all")]
    assert got == want and ngram_join.one_of_each(docs).schema == docs.schema


@pytest.mark.parametrize("pairs", [brute.odd_texts(), random_texts(3), random_texts(4, 120)], ids=["odd", "random 3", "random 4"])
def test_repeats_are_those_of_all_windows(spark, pairs):
    got = brute.rows(recompress.digests(brute.table(spark, pairs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute.kept_words(pairs))
    assert got == want


def test_dedup_changes_only_texts_that_lose_words(spark):
    pairs = brute.odd_texts()
    docs = brute.table(spark, pairs)
    out = recompress.dedup(docs)
    assert out.schema == docs.schema
    want = sorted(((i, k if r else t) for (i, t), (_, _, r, k) in zip(pairs, brute.kept_words(pairs), strict=True)), key=lambda x: (x[0], x[1] or ""))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda x: (x[0], x[1] or "")) == want
    assert recompress.dedup(docs.limit(0)).collect() == []
    alone = brute.table(spark, [(None, "a " * 20), (1, "a " * 20)])
    assert brute.rows(recompress.digests(alone), "doc_id", "n_removed") == [(1, 0), (None, 0)]


def test_anchor_of_a_window_depends_on_the_window_only():
    draw = np.random.default_rng(5)
    for alphabet in (1, 2, 3, 50):
        size = draw.integers(0, 60, 200)
        first = np.concatenate([[0], np.cumsum(size)])
        names = recompress.mix(draw.integers(0, alphabet, first[-1]).astype(np.uint64) + np.uint64(9))
        found = recompress.anchors(names, first, 13, 4)
        window, real = recompress.windows_of(names, first, 13)
        seen = {}
        for w, a in zip(window[real].tolist(), found[real].tolist(), strict=True):
            assert seen.setdefault(w, a) == a


def test_simple8b_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        for top in (2, 50_000, 1 << 62):
            values = draw.integers(0, top, n).astype(np.uint64)
            if n > 10:
                values[::7] = 0
                values[3] = np.uint64(2**64 - 1)
            words, escapes, block_at, escape_at = simple8b.encode(values)
            assert (simple8b.decode(words, escapes, block_at, escape_at, n) == values).all()
    assert len(simple8b.encode(np.ones(1024, np.uint64))[0]) < 20


def test_id_files_hold_the_library_s_ids_in_order(spark):
    pairs = [(i, t) for i, t in brute.odd_texts()]
    random.Random(3).shuffle(pairs)
    path = runtime.folder(spark)
    simple8b.write_ids(brute.table(spark, pairs).repartition(3), path, BYTE, end_id=2)
    tokenizer, start, want = Tokenizer.from_file(BYTE), 0, []
    for i, t in sorted(pairs, key=lambda p: p[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert brute.rows(simple8b.read_ids(spark, path, digest=True), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in simple8b.read_ids(spark, path).orderBy("doc_id", "start").collect()] == [w[3] for w in want]
    empty = runtime.folder(spark)
    simple8b.write_ids(brute.table(spark, pairs).limit(0), empty, BYTE, end_id=2)
    assert simple8b.read_ids(spark, empty).collect() == []


def test_packing_is_whole_and_gapless(spark):
    pairs = brute.odd_texts()
    docs = brute.table(spark, pairs)
    tokenizer, want = Tokenizer.from_file(WORD), []
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, p // 256, p, len(ids[p : p + 256]), zlib.crc32(np.array(ids[p : p + 256], "<u4").tobytes())) for p in range(0, len(ids), 256)]
    out = packing.best_fit(docs, WORD, end_id=1, capacity=256, open_bins=2, pieces_per_task=7)
    assert brute.rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want)
    sequences = {}
    for r in out.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.best_fit(docs.limit(0), WORD, end_id=1).collect() == []


def test_bins_take_the_least_room_and_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (8, 7, 6, 2)] == [(0, 0), (1, 0), (2, 0), (1, 7)]  # 0, the fullest, closed at the third


def test_bpe_is_tiktoken_s(spark):
    pairs = brute.odd_texts()
    docs = brute.table(spark, pairs).drop("ids")
    v = bpe.vocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    want = {(i, t): library.encode_ordinary(t or "") for i, t in pairs}
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in out.collect():
        assert r.ids == want[r.doc_id, r.text]
        assert bytes(r.decoded) == (r.text or "").encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for (i, t), ids in want.items() for _ in range(pairs.count((i, t))))
    assert brute.rows(bpe.digests(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == digests
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("node", "ids"), RANKS, public_tokenizers.PATTERN)


def test_perfect_hash_has_no_gaps_and_no_strangers():
    names = recompress.mix(np.arange(5000, dtype=np.uint64))
    table = bpe.PerfectHash(names, np.arange(5000))
    assert (table.find(names) == np.arange(5000)).all()
    assert sorted(table.values.tolist()) == list(range(5000))
    assert (table.find(recompress.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


def test_language_shares(spark):
    english, french = "the of and that with this thing " * 5, "éau le des que nous très été "
    rows = [(i, f"{english} {i}" if i % 2 else f"{french * 5} {i}", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ?! “ ”", "fr"), (103, english * 3 + french * 15, None), (104, "The", None), (104, "The", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") and out[i].score > 0.9 for i in range(40))
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert set(out[103].languages) == {"en", "fr"} and abs(sum(out[103].languages.values()) - 1) < 1e-6
    assert out[104].lang_pred == "en"
    none = language.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("score", docs.doc_id), model)
    assert language.identify(docs.limit(0), model).collect() == []


def test_mixtures_are_those_of_plain_expectation_maximisation():
    # A plain form over dictionaries: the same cells, one word and one language at a time.
    texts = ["der hund läuft", "the dog and der hund", "le chien court vite", "the the the", "12", ""]
    x = next(slices(pa.array([*texts, "x y"])))
    draw = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], draw.integers(0, 50, (3, language.BUCKETS)).astype(float))
    best, score, shares = language.predict(model, x)
    cells, _, begins, first = language._cells(x)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        words, start = [], None
        for c, new in zip(cells[a:b].tolist(), begins[a:b].tolist(), strict=True):
            if new or start is None:
                words.append([0.0, 0.0, 0.0])
                start = True
            for k in range(3):
                words[-1][k] += float(model.log[c, k])
        if not words:
            assert best[i] == -1 and score[i] == 0
            continue
        chosen = [max(range(3), key=lambda k: sum(w[k] for w in words))]
        share = plain_mixture(words, [0, 1, 2], [1 / 3] * 3)[0]
        reached = sum(w[chosen[0]] - max(w) for w in words)
        found = {chosen[0]: 1.0}
        while len(chosen) < 3:
            more = max((k for k in range(3) if k not in chosen), key=lambda k: share[k])
            trial = sorted([*chosen, more])
            begin = [max(share[k], 1e-6) for k in trial]
            got, gained = plain_mixture(words, trial, [v / sum(begin) for v in begin])
            if gained - reached <= language.PENALTY * math.log(max(len(words), 2)) + language.SLACK * len(words):
                break
            chosen, reached, found = trial, gained, dict(zip(trial, got, strict=True))
        assert best[i] == (max(found, key=found.get) if len(found) > 1 else chosen[0])
        assert shares[i] == pytest.approx([found.get(k, 0) for k in range(3)], abs=1e-6)


def plain_mixture(words, languages, share):
    for _ in range(language.STEPS):
        joint = [[max(math.exp(w[k] - max(w)), 1e-30) * s for k, s in zip(languages, share, strict=True)] for w in words]
        whole = [sum(j) for j in joint]
        share = [sum(j[k] / t for j, t in zip(joint, whole, strict=True)) / len(words) for k in range(len(languages))]
    return share, sum(math.log(t) for t in whole)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()))
    out = language.identify(docs.filter(language.held_out()), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize("pairs", [brute.odd_texts(), random_texts(6)], ids=["odd", "random"])
def test_backoff_scores(spark, pairs, monkeypatch):
    monkeypatch.setattr(backoff, "GROUP_BYTES", 1000)
    got = [(r.n_words, round(r.log_score, 6)) for r in backoff.score(brute.table(spark, pairs).repartition(3)).collect()]
    assert sorted(got) == sorted((n, round(s, 6)) for n, s in brute.backoff_scores(pairs))
    assert backoff.score(brute.table(spark, pairs).limit(0)).collect() == []


def test_backoff_answers_are_bits_and_totals():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    asked = [np.r_[shared, rng.integers(0, 1 << 63, 4000).astype(np.uint64)] for _ in range(2)]
    parts = [b for page, names in enumerate(asked) for b in backoff._asked(page, 2, names, 1)]
    told = backoff._totals(pa.Table.from_batches(parts)).to_pylist()
    assert [(r["page"], r["n"], len(r["a"])) for r in told] == [(0, 2, 1000), (1, 2, 1000)]
    # A bit for each name and small totals; the 4,000 shared names alone would take 32,000 bytes.
    assert all(len(r["a"]) + len(r["b"]) < 2000 for r in told)
    for r, names in zip(told, asked, strict=True):
        hit = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=8000).astype(bool)
        assert (np.unique(names)[hit] == np.sort(shared)).all()
        assert (backoff.unpacked(r["b"], np.int64) == 2).all()
