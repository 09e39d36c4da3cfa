"""Toxicity, importance resampling and source divergence against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from annoframe.llm import divergence, radix, resample, toxicity
from annoframe.llm.spans import slices
from tests.llm import brute

LONG = " ".join(f"w{i % 700} x{i}" for i in range(60_000))


def odd_rows():
    draw = random.Random(9)
    stock = ["Maß", "haus", "ein", "dog", "DOG", "x" * 9, "y" * 16, "z" * 17, "q" * 40, "a1b2", "été", "日本語", "l" * 100]
    rows = []
    for i in range(160):
        text = draw.choice([" ", "-", "\n"]).join(draw.choice(stock) for _ in range(draw.randint(0, 60)))
        rows.append((i, text, draw.choice(["de", "de", "en", "", None]), draw.choice(["s1", "s2", "s3", None, ""])))
    rows += [(500, None, "en", "s9"), (501, "", "xx", "s1"), (502, "12 34", "xx", "s2"), (503, LONG, "en", "s1"), (None, "dog " * 30, "en", "s2")]
    rows += [(504, "dog haus " * 15, "de", "s1")] * 3 + [(504, "dog haus", "de", "s1"), (505, "dog  dog", "en", "s1")]
    return rows


def frame(spark, rows):
    """Columns beside those needed have names that the operators use inside."""
    full = [(*r, 1, 2, "c") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, weight long, cell string").repartition(4)


def features_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def plain_resampling(rows, target, percent=25, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *features_of(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features_of(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, w, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, len(w) >= 20 and i is not None])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize("block_rows", [7, 1 << 17])
def test_resampling_is_the_plain_one(spark, monkeypatch, block_rows):
    monkeypatch.setattr(resample.ranked, "__defaults__", (block_rows,))
    rows, target = odd_rows(), ["dog haus dog", None, "", "été 日本語 ein"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = brute.rows(resample.resample(frame(spark, rows), goal), "doc_id", "n_features", "weight", "score", "rank")
    assert got == plain_resampling([r[:2] for r in rows], target)


def test_resampling_of_empty_tables(spark):
    docs = frame(spark, odd_rows())
    goal = spark.createDataFrame([("dog",)], "text string")
    assert resample.resample(docs.limit(0), goal).collect() == []
    none = resample.resample(docs, goal.limit(0))
    assert brute.rows(none, "doc_id", "n_features", "weight", "score", "rank") == plain_resampling([r[:2] for r in odd_rows()], [])


def test_crc_of_runs_is_zlib_s():
    words = ["a", "bb" * 3, "c" * 63, "d" * 64, "e" * 65, "f" * 300, "é", "0"]
    x = next(slices(pa.array([" ".join(words), "a", ""])))
    for n in (1, 2, 3):
        cells, row, counts = resample.feature_buckets(x, n, 1 << 30)
        want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % (1 << 30) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        assert sorted(cells[row == 0].tolist()) == sorted(want)
        assert cells[row == 1].tolist() == [zlib.crc32(b"a") % (1 << 30)]
        assert counts.tolist() == [8, 1, 0]


def test_radix_sort_of_wide_keys(spark):
    draw = np.random.default_rng(1)
    a = draw.choice([-(2**63), -1, 0, 5, 2**63 - 1, 1 << 40], 300)
    b = draw.integers(-100_000, 100_000, 300)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(3)
    got = resample.ranked(df, [("a", True), ("b", False)], 32).orderBy("position").collect()
    assert [r.position for r in got] == list(range(300))
    assert [(r.a, r.b) for r in got] == sorted(zip(a.tolist(), b.tolist(), strict=True), key=lambda r: (-r[0], r[1]))
    order = radix.order(a.view(np.uint64), b.view(np.uint64))
    assert (order == np.lexsort((b.view(np.uint64), a.view(np.uint64)))).all()


def plain_audit(rows, least=10, top=10):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))) for _, t, l, s in rows]
    seen = Counter((l, t) for l, _, ts in docs for t in set(ts))
    kept = defaultdict(set)
    for (l, t), n in seen.items():
        if n >= least:
            kept[l].add(t)
    count, groups = defaultdict(Counter), {(l, s) for l, s, _ in docs}
    for l, s, ts in docs:
        count[l, s].update(t for t in ts if t in kept[l])
        count[l].update(t for t in ts if t in kept[l])
    share = lambda l, c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept[l]))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for l, s in groups:
        pairs = [(sum(f(share(l, count[l, s], t), share(l, count[l, o], t)) for t in kept[l]), o) for k, o in groups if k == l and o != s]
        above = [(f(p, q), t) for t in kept[l] if count[l, s][t] and (p := share(l, count[l, s], t)) > (q := share(l, count[l], t))]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", above, top)):
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((l, s, part, item, v, rank + 1))
    return sorted(out)


@pytest.mark.parametrize("held,block", [(50, 7), (1 << 20, 1 << 20)])
def test_audit_is_the_plain_one(spark, monkeypatch, held, block):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = odd_rows()
    for least in (10, 3):
        got = divergence.audit(frame(spark, rows), least_docs=least)
        assert brute.rows(got, "lang", "source", "part", "item", "value", "rank") == plain_audit(rows, least)


def test_audit_without_terms_and_without_rows(spark):
    docs = frame(spark, [(1, None, "en", "a"), (2, "x", "en", "b"), (3, "x", None, None)])
    got = brute.rows(divergence.audit(docs), "lang", "source", "part", "item", "value", "rank")
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def insults(spark):
    draw = random.Random(5)
    speech = {"en": ["the", "house", "and", "green", "walks", "over", "there"], "de": ["das", "haus", "und", "grün", "läuft", "über", "dort"]}
    bad = {"en": ["idiot", "moronic"], "de": ["dummkopf", "trottel"]}
    rows = []
    for i in range(600):
        lang = draw.choice(["en", "de"])
        words = [draw.choice(speech[lang]) for _ in range(draw.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(bad[lang]))
        rows.append((i, " ".join(words), lang, toxic))
    rows += [(700, None, "en", None), (701, "", None, None), (702, "12 !?", "en", None), (703, LONG, "en", 0), (704, LONG + " idiot " + LONG, "en", None)]
    rows += [(705, "you idiot, walks the moronic house", None, None)] * 2 + [(None, "you idiot, walks the moronic house", "en", 1)]
    docs = spark.createDataFrame([(*r[:3], 5) for r in rows], "doc_id long, text string, lang string, hash long").repartition(3)
    labels = spark.createDataFrame([(i, t, 0) for i, _, _, t in rows], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_toxicity_of_held_out_rows(spark, insults):
    rows, docs, labels = insults
    free = ~toxicity.held_out()
    model = toxicity.fit(docs.filter(free), labels.filter(free))
    out = toxicity.score(docs.withColumn("held", toxicity.held_out()), model).collect()
    assert {r.doc_id for r in out if r.held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    by = defaultdict(set)
    truth = {i: t for i, _, _, t in rows}
    for r in out:
        by[r.doc_id].add((r.score, r.predicted))
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held and truth[r.doc_id] is not None:
            assert r.predicted == truth[r.doc_id]
    assert by[700] == by[701] and len(by[705]) == 1 and by[705] == by[None]
    assert {p for i in (700, 701, 702) for _, p in by[i]} == {0}
    assert min(by[704])[1] == 1 and max(by[703])[1] == 0  # one word in a very long text decides
    again = toxicity.fit(docs.filter(free).repartition(7), labels.filter(free))
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == {r.doc_id: r.score for r in out}
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", docs.doc_id), model)
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("part_bytes", [1 << 25, 1 << 16])
def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch, part_bytes):
    """A word that only labelled rows beyond any 3,000 of their class hold, those with the largest hashes, marks a text."""
    monkeypatch.setattr(toxicity, "PART_BYTES", part_bytes, raising=False)
    ids = spark.range(7200).selectExpr("id as doc_id", "id % 2 as toxic", "rank() over (partition by id % 2 order by xxhash64(id, 'toxicity')) as place")
    word = "case when toxic = 0 then 'green' when place <= 3000 then 'idiot' else 'dummkopf' end"
    rows = ids.selectExpr("doc_id", f"concat_ws(' ', 'the house', 'x' || doc_id % 9, {word}, 'y' || doc_id % 7) as text", "'en' as lang", "toxic")
    model = toxicity.fit(rows.repartition(3), rows.repartition(2).select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "walks the dummkopf there"), (2, "the idiot house"), (3, "the green house"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(asked, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_toxicity_without_two_classes(insults):
    _, docs, labels = insults
    for only, want in (("toxic = 0", 0.0), ("toxic = 1", 1.0), ("toxic = 5", 0.0)):
        model = toxicity.fit(docs, labels.filter(only))
        assert {r.score for r in toxicity.score(docs, model).select("score").distinct().collect()} == {want}


def test_scores_do_not_depend_on_blocks_of_places(insults, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [draw.integers(0, 50, (draw.integers(0, 40), 6)).astype(np.int32) for _ in range(60)]
    label = draw.integers(0, 2, 60).astype(float)
    net = toxicity.train(rows, label)
    cells, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    whole = net.logits(cells, np.arange(len(cells)), first)
    monkeypatch.setattr(toxicity, "PLACES", 5)
    assert np.allclose(net.logits(cells, np.arange(len(cells)), first), whole, atol=1e-4)
    # Against filters taken one place at a time.
    for i, r in enumerate(rows):
        e = net.embedding[net.rows(r)].sum(axis=1) if len(r) else np.zeros((0, toxicity.SIZE))
        e = np.concatenate([e, np.zeros((2, toxicity.SIZE))])
        none = np.full(toxicity.FILTERS, -np.inf)
        tops = [np.max([e[p : p + w].reshape(-1) @ f for p in range(len(r))], axis=0) if len(r) else none for w, f in zip(toxicity.WIDTHS, net.filters, strict=True)]
        z = np.maximum(np.concatenate(tops) + net.offsets, 0) @ net.out + net.bias
        assert z == pytest.approx(whole[i], abs=1e-3)


def test_thresholds_lie_between_the_classes():
    z = np.array([-3.0, -2.0, 1.0, 2.0])
    assert toxicity._threshold(z, np.array([0, 0, 1, 1])) == -0.5
    assert toxicity._threshold(np.array([1.0, 1.0, 2.0]), np.array([0, 1, 1])) in (1.5, 0.0)
