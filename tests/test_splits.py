"""Splits, clusters, derivative groups and leakage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoframe.operators import leakage, similarity, splits
from annoframe.plans import base

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def test_random_split(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("label"))
    out = splits.stratified(df, "id", label="label").cache()
    counts = {r["split"]: r["n"] for r in splits.distribution(out, "split").collect()}
    assert sum(counts.values()) == 100 and 65 < counts["train"] < 75 and min(counts.values()) > 0
    splits.assert_disjoint(out, "id")
    again = splits.stratified(df.repartition(7), "id", label="label")
    assert out.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_few_rows_are_infeasible(spark):
    row = splits.feasible_random(spark.range(5)).first()
    assert not row.feasible and "Too few" in row.reason


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(90).withColumn("g", (F.col("id") % 30).cast("string"))
    out = splits.by_group(df, "g")
    assert out.groupBy("g").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    groups = {r["split"]: r["n"] for r in splits.distribution(out.select("g", "split").distinct(), "split").collect()}
    assert groups == {"train": 21, "val": 4, "test": 5}
    assert not splits.feasible_groups(df.withColumn("g", F.col("id") % 5), "g").first().feasible


def test_group_fill_overshoots_by_one_group(spark):
    rows = [(i, f"g{i % 10}") for i in range(100)]
    out = splits.by_group_fill(spark.createDataFrame(rows, "id int, g string"), "g")
    counts = {r["split"]: r["n"] for r in splits.distribution(out, "split").collect()}
    assert counts == {"test": 20, "val": 20, "train": 60}


def test_one_group_holding_most_rows(spark):
    rows = [(i, "hot" if i < 70 else f"g{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g string")
    assert splits.by_group(df, "g").count() == 100
    assert not splits.feasible_groups(df, "g").first().feasible


def test_overlap_is_an_error(spark):
    rows = [(i, "train") for i in range(7)] + [(i, "val") for i in (5, 6, 7)] + [(8, "test"), (9, "test")]
    df = spark.createDataFrame(rows, "id int, split string")
    with pytest.raises(ValueError, match="overlap"):
        splits.assert_disjoint(df, "id")


def test_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.Ratios(0.5, 0.1, 0.1)


def identity_of(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [r.identity for r in similarity.with_identity(df, "a", "b").collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_identity(spark):
    assert identity_of(spark, [("ACDEFG", "ACDEFG")]) == [1.0]
    assert identity_of(spark, [("ACDEFG", "ACDXFG")]) == [pytest.approx(5 / 6)]
    assert identity_of(spark, [("AAA", "GGG")]) == [0.0]
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ACDEF") for _ in range(rng.randint(3, 100)))
    pairs = [(text(), text()) for _ in range(40)]
    want = [lcs(a, b) / max(len(a), len(b)) for a, b in pairs]
    assert identity_of(spark, pairs) == pytest.approx(want)


def test_affine_scores():
    got = similarity.affine_scores(["ACDEFG", "ACDEFG", "AAAA", "A"], ["ACDXFG", "ACDEFG", "AA", "G"])
    assert got.tolist() == [4.0, 6.0, 0.5, -1.0]


def sequential(seqs, score, threshold):
    """The plain greedy loop over distinct sequences in the given order."""
    leaders, of = [], {}
    for s in seqs:
        hit = next((x for x in leaders if score(x, s) >= threshold), None)
        if hit is None:
            leaders.append(s)
            hit = s
        of[s] = leaders.index(hit)
    return of


@pytest.mark.parametrize("order,chunk", [("input", 256), ("input", 2), ("length_desc", 3)])
def test_clusters_equal_the_sequential_loop(spark, order, chunk):
    rng = random.Random(11)
    base = ["".join(rng.choice("ACDEFG") for _ in range(rng.randint(5, 9))) for _ in range(12)]
    seqs = []
    for b in base:
        seqs.append(b)
        for _ in range(3):
            i = rng.randrange(len(b))
            seqs.append(b[:i] + rng.choice("ACDEFG") + b[i + 1 :])
    rows = list(enumerate(seqs))
    got = similarity.leader_clusters(
        spark.createDataFrame(rows, "id int, s string"), "s", "id", 0.7, order=order, chunk=chunk
    )
    unique = list(dict.fromkeys(seqs))
    if order == "length_desc":
        unique.sort(key=len, reverse=True)
    want = sequential(unique, lambda a, b: lcs(a, b) / max(len(a), len(b)), 0.7)
    assert {r.seq: r.cluster_id for r in got.collect()} == want


def test_clusters_by_text_keys_and_large_numbers(spark):
    seqs = ["ACDEFGH", "ACDEFGK", "WWYYMMH", "ACDEFGH", "WWYYMMN"]
    for keys, kind in ((["K_10", "K_9", "K_1", "K_0", "K_7"], "string"), ([2**60 + i for i in (5, 4, 3, 2, 1)], "bigint")):
        df = spark.createDataFrame(list(zip(keys, seqs, strict=True)), f"k {kind}, s string")
        got = similarity.leader_clusters(df, "s", "k", 0.7)
        order = [s for _, s in sorted((min(k for k, t in zip(keys, seqs, strict=True) if t == s), s) for s in set(seqs))]
        want = sequential(order, lambda a, b: lcs(a, b) / max(len(a), len(b)), 0.7)
        assert {r.seq: r.cluster_id for r in got.collect()} == want


def test_rounds_of_a_hot_key_are_few(spark):
    # All share a key; half are near copies of one sequence, which the first round takes away.
    rng = random.Random(2)
    near = ["ACDEFGHIKLMNPQRSTVWY" * 2 for _ in range(150)]
    near = [s[:i] + "A" + s[i + 1 :] for i, s in enumerate(near[:40])]
    other = ["".join(rng.sample("ACDEFGHIKLMNPQRSTVWY", 20)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(near + other)), "id int, s string")
    log = []
    got = similarity.leader_clusters(df, "s", "id", 0.9, chunk=4, log=log)
    want = sequential(list(dict.fromkeys(near + other)), lambda a, b: lcs(a, b) / max(len(a), len(b)), 0.9)
    assert {r.seq: r.cluster_id for r in got.collect()} == want
    assert len(log) <= 8 and max(entry["steps"] for entry in log) <= 6


@pytest.mark.parametrize("chunk", [2, 256])
def test_set_clusters_equal_the_sequential_loop(spark, chunk):
    rng = random.Random(8)
    base = [rng.sample(range(40), rng.randint(1, 12)) for _ in range(8)]
    sets = [[str(x) for x in b if rng.random() < 0.9] for b in base * 6] + [None, [], ["7", "7"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, w array<string>")
    full = [frozenset(s or ()) for s in sets]
    jaccard = lambda a, b: len(a & b) / len(a | b) >= 0.5 and bool(a)
    leaders, want = [], {}
    for i, s in enumerate(full):
        hit = next((n for n, x in enumerate(leaders) if s and x and jaccard(x, s)), None)
        if hit is None:
            leaders.append(s)
            hit = len(leaders) - 1
        want[i] = hit
    assert {r.id: r.cluster_id for r in similarity.set_clusters(df, "id", "w", 0.5, chunk).collect()} == want


@pytest.mark.parametrize("common,threshold", [(1, 0.5), (3, 0.7), (8, 0.2)])
def test_index_of_sets_misses_nothing(common, threshold):
    rng = np.random.default_rng(common)
    # Items of a set in the order of hashes, as that of all sets.
    names = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    base = [rng.choice(300, rng.integers(1, 90), replace=False) for _ in range(20)]
    sets = [np.unique(names[np.r_[b[rng.random(len(b)) < 0.8], rng.integers(0, 300, 3)]]) for b in base * 6]
    at, items = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    left, right = similarity._SetIndex(at, items, threshold, common).met(at, items, before=np.arange(len(sets)))
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= threshold - 1e-12]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
    leaders = []
    for i in range(len(sets)):
        if not any((i, j) in set(want) for j in leaders):
            leaders.append(i)
    assert similarity._first_leaders(at, items, threshold, common, 16).tolist() == leaders


def test_edges_miss_nothing(spark):
    rng = random.Random(5)
    seqs = list({"".join(rng.choice("ACDE") for _ in range(rng.randint(3, 8))) for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    got = {frozenset((r.seq_a, r.seq_b)) for r in similarity.edges(df, "s", "id", 0.7).collect()}
    want = {
        frozenset((a, b))
        for i, a in enumerate(seqs)
        for b in seqs[i + 1 :]
        if lcs(a, b) / max(len(a), len(b)) >= 0.7
    }
    assert got == want


def test_derivative_groups(spark):
    rows = [(0, "ACDEFG", []), (1, "ACDEFG", ["m@0"]), (2, "ACDEFG", ["m@1"]), (3, "KLMN", [])]
    df = spark.createDataFrame(rows, "id int, s string, sig array<string>")
    got = {r.id: r.derivative_group for r in similarity.derivative_groups(df, "id", "s", "sig").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: None}


@pytest.mark.parametrize("k,waiting,scanned", [(1, 1 << 16, 32), (1, 5, 2), (2, 5, 0), (0, 20, 1)])
def test_derivative_groups_move_rows_once(spark, monkeypatch, k, waiting, scanned):
    rng = random.Random(k + waiting)
    rows = [(i, rng.choice(["AAAA", "AAAA", "CC", "DEF"]), [f"m@{j}" for j in range(6) if rng.random() < 0.5]) for i in range(300)]
    rows += [(1000, None, []), (1001, "AAAA", None), (1002, "GG", ["m@0"]), (1003, None, [])]
    df = spark.createDataFrame(rows, "id int, s string, sig array<string>").repartition(3)
    monkeypatch.setattr(similarity, "WAITING", waiting)
    monkeypatch.setattr(similarity, "SCANNED", scanned)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    out = similarity.derivative_groups(df, "id", "s", "sig", k)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got = {r.id: (r.derivative_group, r.group_rows) for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lead, leaders = {}, {}
    for i, s, sig in rows:
        if s is not None and sig is not None:
            near = [j for j, other in leaders.setdefault(s, []) if len(set(sig) ^ other) <= k]
            lead[i] = near[0] if near else i
            if not near:
                leaders[s].append((i, set(sig)))
    sizes = {j: list(lead.values()).count(j) for j in lead.values()}
    want = {i: (lead[i], sizes[lead[i]]) if i in lead and sizes[lead[i]] > 1 else (None, None) for i, _, _ in rows}
    assert got == want


def shuffles_of_lines(spark, name, monkeypatch):
    """How many times the query ``name`` reads the lines of orders."""
    from annoframe.plans import samples

    read, load = [], samples.load
    monkeypatch.setattr(samples, "load", lambda spark, sf, table: (read.append(table), load(spark, sf, table))[1])
    out = base.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    return read.count("lineitem"), plan.count("l_linenumber"), out


def test_derivative_feasibility_has_no_checkpoint_of_annotations(spark, monkeypatch):
    read, _, out = shuffles_of_lines(spark, "derivative_feasibility", monkeypatch)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert read == 1 and "edit_metadata" not in plan and "ExistingRDD" not in plan and "Scan" not in plan
    assert out.first().n_rows == 1500


def test_split_by_derivative_settles_groups_once(spark, monkeypatch):
    read, lines, out = shuffles_of_lines(spark, "split_by_derivative", monkeypatch)
    # The plan goes back to the settled groups, not to the lines.
    assert read == 1 and lines == 0 and out.count() == 1500


def test_edit_pairs(spark):
    rows = [("ACDE", 1.0), ("ACDE", 3.0), ("ACDF", 5.0), ("ACD", 0.0), ("WWWW", 9.0)]
    df = spark.createDataFrame(rows, "s string, y double")
    got = {(r.source, r.target): (r.distance, r.delta) for r in similarity.edit_pairs(df, "s", "y").collect()}
    assert got == {("ACD", "ACDE"): (1, 2.0), ("ACD", "ACDF"): (1, 5.0), ("ACDE", "ACDF"): (1, 3.0)}
    same = similarity.edit_pairs(df, "s", "y", same_length=True)
    assert same.count() == 1


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_pairs_miss_nothing(spark, k):
    rng = random.Random(k)
    texts = {"".join(rng.choice("AC") for _ in range(rng.randint(0, 9))) for _ in range(90)}
    for t in list(texts)[:30]:
        long = t * 3 + "GGTT"
        at = rng.randrange(len(long))
        texts |= {long, long[:at] + rng.choice(["", "X", "XY"]) + long[at + rng.randint(0, 2) :]}
    df = spark.createDataFrame([(t, 1.0) for t in texts] + [(None, 2.0)], "s string, y double")
    got = {(r.source, r.target): r.distance for r in similarity.edit_pairs(df, "s", "y", max_distance=k).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b): d for a in texts for b in texts if a < b and (d := distance(a, b)) <= k}
    assert got == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(i, [f"t{rng.randrange(12)}" for _ in range(rng.randint(0, 6))]) for i in range(n)]
    q, c = make(25), make(20)
    ddl = "id int, w array<string>"
    got = similarity.nearest_jaccard(spark.createDataFrame(q, ddl), spark.createDataFrame(c, ddl), "id", "w")
    got = {r.id: (r.max_similarity, r.mean_top_similarity) for r in got.collect()}
    corpus = [set(w) for _, w in c if w]
    for i, w in q:
        if not w:
            assert got[i] == (None, None)
            continue
        js = sorted((len(set(w) & d) / len(set(w) | d) for d in corpus), reverse=True)
        assert got[i] == pytest.approx((js[0], sum(js[:5]) / 5))


def test_approximate_nearest_recalls_similar_sets(spark):
    rng = random.Random(3)
    corpus = [(i, [f"t{rng.randrange(400)}" for _ in range(30)]) for i in range(80)]
    queries = []
    for i, (_, w) in enumerate(corpus):
        keep = rng.uniform(0.4, 1.0)
        queries.append((i, [t if rng.random() < keep else f"n{rng.randrange(400)}" for t in w]))
    queries += [(900, []), (901, ["n1"])]
    ddl = "id int, w array<string>"
    q, c = spark.createDataFrame(queries, ddl), spark.createDataFrame(corpus, ddl)
    exact = {r.id: r.max_similarity for r in similarity.nearest_jaccard(q, c, "id", "w").collect()}
    near = {r.id: r.max_similarity for r in similarity.nearest_approximate(q, c, "id", "w").collect()}
    assert set(near) == set(exact) and near[900] is None and near[901] == exact[901] == 0
    assert all(near[i] <= exact[i] + 1e-12 for i in exact if i != 900)
    like = [i for i, j in exact.items() if j is not None and j >= 0.2]
    assert len(like) > 40 and sum(near[i] == pytest.approx(exact[i]) for i in like) >= 0.9 * len(like)


def test_bands_are_those_of_the_formula(spark):
    import hashlib

    rng = random.Random(5)
    sets = [(i, [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 12))] + [None] * (i % 7 == 3)) for i in range(60)]
    df = spark.createDataFrame([*sets, (99, None)], "id int, w array<string>")
    out = similarity._signed_sets(df, "id", "w", 8)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 0
    got = {r.id: r for r in out.collect()}
    part = lambda t, i: int(hashlib.md5(t.encode()).hexdigest()[i : i + 7], 16)
    for i, w in [*sets, (99, None)]:
        words = {t for t in w or [] if t is not None}
        least = [min(((part(t, 0) + j * part(t, 8)) % 2147483647 for t in words), default=None) for j in range(16)]
        assert got[i]._some == bool(w) and got[i]._value == ([least[2 * b] * 2147483647 + least[2 * b + 1] for b in range(8)] if words else None)
        assert not words or set(got[i]._set) == set(w)
    bits = np.zeros(similarity.BAND_BITS, bool)
    for place in similarity._band_places(np.array(got[0]._band), np.array(got[0]._value)):
        bits[place] = True
    few = similarity._signed_sets(df, "id", "w", 8, np.packbits(bits, bitorder="little")).collect()
    shared = {r.id: [b for b, v in zip(r._band or [], r._value or [], strict=True) if got[0]._value[b] == v] for r in got.values()}
    assert {r.id: r._band for r in few} == {i: b or None for i, b in shared.items()}


@pytest.mark.parametrize("k,pilot,heavy", [(5, 3, 2), (2, 1, 1), (3, 7, 10_000)])
def test_nearest_beyond_the_pilot(spark, k, pilot, heavy):
    rng = random.Random(k)
    make = lambda n: [(i, [f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(0, 9))]) for i in range(n)]
    q, c = make(40), make(60)
    q += [(100, ["no", "such", "item"]), (101, None)]
    c += c[:10]
    ddl = "id int, w array<string>"
    got = similarity.nearest_jaccard(spark.createDataFrame(q, ddl), spark.createDataFrame(c, ddl), "id", "w", k, pilot, heavy)
    got = {r.id: (r.max_similarity, r.mean_top_similarity) for r in got.collect()}
    corpus = [set(w) for _, w in c if w]
    for i, w in q:
        if not w:
            assert got[i] == (None, None)
            continue
        js = sorted((len(set(w) & d) / len(set(w) | d) for d in corpus), reverse=True)
        assert got[i] == pytest.approx((js[0], sum(js[:k]) / k))
    none = similarity.nearest_jaccard(spark.createDataFrame(q, ddl), spark.createDataFrame([], ddl), "id", "w")
    assert {(r.max_similarity, r.mean_top_similarity) for r in none.collect()} == {(None, None)}


def test_mean_identity_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TRAIN_BLOCK", 7)
    monkeypatch.setattr(similarity, "TEST_BLOCK", 5)
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("ACDE") for _ in range(rng.choice([0, 1, 5, 9, 64, 70, 140])))
    rows = [(i, text(), rng.choice(["train", "test", "val"])) for i in range(60)]
    rows += [(100 + i, *rows[i][1:]) for i in range(15)] + [(200, None, "test")]
    df = spark.createDataFrame(rows, "id int, s string, split string")
    train, test = ([s for _, s, p in rows if p == side and s is not None] for side in ("train", "test"))
    identity = lambda a, b: lcs(a, b) / max(len(a), len(b)) if a or b else 1.0
    want = sum(identity(a, b) for a in train for b in test) / (len(train) * len(test))
    got = leakage.mean_identity(df, "id", "s").first()
    assert got.mean_test_train_similarity == pytest.approx(want) and got.standard_error == 0
    near = leakage.mean_identity(df.filter("length(s) > 0"), "id", "s", exact_steps=10, draws_wanted=4000).first()
    filled = [(a, b) for a in train for b in test if a and b]
    assert abs(near.mean_test_train_similarity - sum(identity(a, b) for a, b in filled) / len(filled)) < 5 * near.standard_error
    assert leakage.mean_identity(df.filter("split = 'val'"), "id", "s").first() == (0.0, 0.0)


def without_large_defaults(monkeypatch, function):
    small = tuple(1 if isinstance(d, int) and d > 10**9 else d for d in function.__defaults__)
    monkeypatch.setattr(function, "__defaults__", small)


def test_mean_identity_has_no_size_from_which_it_draws(spark, monkeypatch):
    without_large_defaults(monkeypatch, leakage.mean_identity)
    rows = [(1, "ACDEFG", "train"), (2, "AAAAAA", "train"), (3, "ACDEFF", "test"), (4, "WWWWWW", "test")]
    df = spark.createDataFrame(rows, "id int, s string, split string")
    assert tuple(leakage.mean_identity(df, "id", "s").first()) == (pytest.approx((5 / 6 + 1 / 6) / 4), 0.0)


def test_report_has_the_mean_of_all_pairs(spark, monkeypatch):
    without_large_defaults(monkeypatch, leakage.mean_identity)
    rows = [(1, "ACDEFG", "train"), (2, "AAAAAA", "train"), (3, "ACDEFF", "test"), (4, "WWWWWW", "test")]
    df = spark.createDataFrame(rows, "id int, s string, split string")
    df = df.withColumns({"e": F.array(F.struct(F.lit("other").alias("edit_family"))), "y": F.col("id").cast("double"), "k": F.col("s"), "p": F.lit("a")})
    row = leakage.report(df, "id", "s", "e", "y", "k", "p").first()
    assert (row.mean_test_train_similarity, row.standard_error) == (pytest.approx((5 / 6 + 1 / 6) / 4), 0.0)
    assert (row.max_sequence_identity, row.overall_risk) == (pytest.approx(5 / 6), "moderate")


def test_exact_ks(spark):
    import itertools

    for m, n in ((3, 4), (5, 5), (1, 6)):
        gaps = []
        for chosen in itertools.combinations(range(m + n), m):
            i, worst = 0, 0
            for k in range(m + n):
                i += k in chosen
                worst = max(worst, abs(i * n - (k + 1 - i) * m))
            gaps.append(worst)
        for h in set(gaps):
            assert 1 - leakage._paths_inside(m, n, h) == pytest.approx(sum(g >= h for g in gaps) / len(gaps))
    # Published values of the two-sample distribution.
    assert 1 - leakage._paths_inside(10, 10, 60) == pytest.approx(0.05244755244755244)
    assert 1 - leakage._paths_inside(5, 5, 25) == pytest.approx(2 / 252)
    rows = [(float(v), "train") for v in (1, 2, 3, 4, 5)] + [(float(v), "test") for v in (6, 7, 8, 9, 10)]
    row = leakage.ks(spark.createDataFrame(rows, "y double, split string"), "y").first()
    assert (row.ks_statistic, row.ks_pvalue) == pytest.approx((1.0, 2 / 252))
    empty = leakage.ks(spark.createDataFrame(rows[:5], "y double, split string"), "y").first()
    assert (empty.ks_statistic, empty.ks_pvalue) == (0.0, 1.0)


def test_risk(spark):
    rows = [(0.6, 5.0, "low"), (0.9, 10.0, "high"), (0.7, 60.0, "high"), (0.75, 20.0, "moderate")]
    df = spark.createDataFrame(rows, "a double, b double, want string")
    out = df.withColumn("got", leakage.risk(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in out.collect())


def test_similarity_is_over_all_pairs(spark):
    rows = [(1, "ACDEFG", "train"), (2, "AAAAAA", "train"), (3, "ACDEFF", "test"), (4, "WWWWWW", "test"), (5, None, "test")]
    df = spark.createDataFrame(rows, "id int, s string, split string")
    row = leakage.sequence_similarity(df, "s").first()
    assert row.max_sequence_identity == pytest.approx(5 / 6)
    assert row.pct_test_high_similarity == 50.0
    low = leakage.sequence_similarity(df.filter("id <> 3"), "s").first()
    assert (low.max_sequence_identity, low.pct_test_high_similarity) == (0.0, 0.0)
    half = leakage.sequence_similarity(spark.createDataFrame([("ACDEFG", "train"), ("ACWWWW", "test")], "s string, split string"), "s").first()
    assert half.max_sequence_identity == pytest.approx(2 / 6)
    assert leakage.sampled_mean_identity(df.filter("s is not null"), "id", "s", 2000).first()[0] == pytest.approx((5 / 6 + 1 / 6) / 4, abs=0.05)


def test_long_texts_are_compared(spark):
    import random

    draw = random.Random(4)
    texts = ["".join(draw.choice("ACDEFG") for _ in range(n)) for n in (62, 124, 125, 130, 186, 187, 300)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    pairs = [(a, b) for a in texts for b in texts if a != b]
    df = similarity.with_identity(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    for r in df.collect():
        assert r.identity == pytest.approx(lcs(r.a, r.b) / max(len(r.a), len(r.b)))
    near = spark.createDataFrame([(1, "ACDEFGHIKL" * 13), (2, "ACDEFGHIKL" * 12 + "ACDEFGHIKK")], "id int, s string")
    assert similarity.edges(near, "s", "id", 0.9).count() == 1


@pytest.mark.parametrize("how", ["stratum", "label", "within", "group"])
def test_no_split_loses_rows_with_null_keys(spark, how):
    rows = [(i, None if i % 3 == 0 else f"s{i % 2}", None if i % 5 == 0 else float(i), f"g{i % 7}" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s string, y double, g string")
    out = {
        "stratum": lambda: splits.stratified(df, "id", strata="s"),
        "label": lambda: splits.stratified(df, "id", label="y"),
        "within": lambda: splits.by_group(df, "g", within=["s"]),
        "group": lambda: splits.by_group_fill(df, "g"),
    }[how]()
    assert sorted(r.id for r in out.collect()) == list(range(60))
    assert {r.split for r in out.collect()} <= {"train", "val", "test"}
    if how == "stratum":
        sides = [r.split for r in out.filter("s is null").collect()]
        assert sides.count("test") == 3 and sides.count("val") == 3


@pytest.mark.parametrize("method", ["lcs", "affine"])
def test_blocks_of_sequences_find_what_keys_find(spark, monkeypatch, method):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACDE") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    texts += ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(3, 9))) for _ in range(60)] + ["A" * 70 + "C", "A" * 69 + "D", "W", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id long, s string")

    def found():
        clusters = similarity.leader_clusters(df, "s", "id", 0.6, order="length_desc", method=method).collect()
        pairs = similarity.edges(df, "s", "id", 0.6, method).collect()
        return {tuple(r) for r in clusters}, {(r.seq_a, r.seq_b, round(r.identity, 9)) for r in pairs}, len(pairs)

    want = found()
    monkeypatch.setattr(similarity, "JOIN_PAIRS", 0)
    monkeypatch.setattr(similarity, "EDGE_BLOCKS", (64, 16))
    monkeypatch.setattr(similarity, "LEADER_CHUNKS", (8, 32))
    monkeypatch.setattr(similarity, "FOLLOWERS", 50)
    assert found() == want

    def refused(*_):
        raise AssertionError("pairs joined by keys that bind little")

    for name in ("greedy_leaders", "_long_enough"):
        monkeypatch.setattr(similarity, name, refused)
    assert found()[2] == want[2]


def brute_identity(a, b):
    return lcs(a, b) / max(len(a), len(b)) if a or b else 1.0


def test_block_sums_of_all_word_widths_and_weights(monkeypatch):
    monkeypatch.setattr(similarity, "LANES", 256)
    draw = random.Random(4)
    text = lambda longest: "".join(draw.choice("ACDE") for _ in range(draw.randint(0, longest)))
    for longest in (7, 8, 15, 31, 63, 140):
        train, test = [text(longest) for _ in range(60)], [text(longest) for _ in range(300)]
        test.append("A" * longest)
        w, v = np.array([draw.randint(1, 400) for _ in train], float), np.array([draw.randint(1, 9) for _ in test], float)
        want = sum(a * b * brute_identity(s, t) for s, a in zip(train, w, strict=True) for t, b in zip(test, v, strict=True))
        assert similarity._block_sum(train, w, test, v) == pytest.approx(want, rel=1e-12)


def test_highest_identity_forms_no_pairs_of_keys(spark, monkeypatch):
    """All test sequences that train lacks meet all of train in blocks."""
    monkeypatch.setattr(similarity, "MET", 7)
    monkeypatch.setattr(similarity, "LOOKED_UP", 3)
    monkeypatch.setattr(similarity, "between", None)
    draw = random.Random(5)
    rows = [("".join(draw.choice("ACDEFG") for _ in range(draw.randint(1, 9))), draw.choice(["train", "test"])) for _ in range(60)]
    train, test = ([s for s, side in rows if side == name] for name in ("train", "test"))
    best = [max(brute_identity(s, t) for t in train) for s in test]
    got = leakage.sequence_similarity(spark.createDataFrame(rows, "s string, split string"), "s").first()
    assert got.max_sequence_identity == pytest.approx(max(best))
    assert got.pct_test_high_similarity == pytest.approx(100 * sum(b > 0.7 for b in best) / len(best))
    apart = [("AAA", "train"), ("CCCD", "test")]
    assert leakage.sequence_similarity(spark.createDataFrame(apart, "s string, split string"), "s").first() == (0.0, 0.0)


def test_sets_of_frequent_items_form_clusters_in_blocks(spark, monkeypatch):
    """Where most sets share their items, no pairs of keys are formed; leaders are those of the loop over the sets."""
    monkeypatch.setattr(similarity, "JOIN_PAIRS", 0)
    monkeypatch.setattr(similarity, "greedy_leaders", None)
    monkeypatch.setattr(similarity, "SET_CHUNKS", (4, 16))
    monkeypatch.setattr(similarity, "SET_BATCH", 5)
    draw = random.Random(8)
    rows = [(i, [f"t{min(draw.randrange(14), draw.randrange(14))}" for _ in range(draw.randint(0, 12))]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    leaders, want = [], {}
    for i, w in rows:
        mine = set(w or [])
        near = [k for k, s in enumerate(leaders) if mine and s and len(mine & s) >= 0.5 * len(mine | s) - 1e-9]
        want[i] = near[0] if near else len(leaders)
        if not near:
            leaders.append(mine)
    for items in (2048, 3):
        monkeypatch.setattr(similarity, "COMMON_ITEMS", items)
        got = similarity.set_clusters(df, "id", "w", 0.5)
        assert {r.id: r.cluster_id for r in got.collect()} == want
