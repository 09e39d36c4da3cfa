"""Metrics, bootstraps, paired tests, ranking and attribution."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from annoframe.operators import attribution, metrics, models, ranking, ranks, replicates, runs, stats

PRED = "run int, id bigint, y_true double, y_pred double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(
        {
            "run": rng.integers(0, 2, 160),
            "id": np.arange(160),
            "y_true": rng.integers(0, 15, 160).astype(float),
            "y_pred": rng.integers(0, 12, 160).astype(float),
        }
    )
    return pdf, spark.createDataFrame(pdf, PRED).cache()


def brute(g):
    y, p = g.y_true.to_numpy(), g.y_pred.to_numpy()
    i, j = np.triu_indices(len(g), 1)
    dy, dp = y[i] - y[j], p[i] - p[j]
    valid = dy != 0
    right = valid & ((dy > 0) == (dp > 0))
    con, dis = (dy * dp > 0).sum(), (dy * dp < 0).sum()
    tau = (con - dis) / np.sqrt((dy != 0).sum() * float((dp != 0).sum()))
    return valid.sum(), right.sum(), tau, g.y_true.rank().corr(g.y_pred.rank())


@pytest.mark.parametrize("rows", [100_000, 4])
def test_pair_metrics_equal_brute_force(table, rows):
    pdf, df = table
    acc = {r.run: r for r in metrics.pairwise_accuracy(df, ["run"], "id", bucket_rows=rows).collect()}
    tau = {r.run: r.kendall_tau for r in metrics.kendall(df, ["run"], bucket_rows=rows).collect()}
    rho = {r.run: r.spearman for r in metrics.spearman(df, ["run"], bucket_rows=rows).collect()}
    for run, g in pdf.groupby("run"):
        valid, right, t, s = brute(g)
        assert (acc[run].valid_pairs, acc[run].correct_pairs) == (valid, right)
        assert tau[run] == pytest.approx(t) and rho[run] == pytest.approx(s)


def test_quantiles_are_exact(table):
    pdf, df = table
    for rows in (100_000, 4):
        got = ranks.quantiles(df, "y_true", {"a": 0.25, "b": 0.9}, ["run"], rows).collect()
        for r in got:
            want = pdf[pdf.run == r.run].y_true.quantile([0.25, 0.9])
            assert [r.a, r.b] == pytest.approx(want.tolist())


def test_perfect_and_degenerate_runs(spark):
    rows = [(1, i, float(i), float(i)) for i in range(1, 4)] + [(2, 9, 1.0, 2.0)]
    rows += [(3, 1, 5.0, 5.0), (3, 2, 5.0, 6.0), (3, 3, float("nan"), 1.0)]
    got = {r.run: r for r in metrics.all_metrics(spark.createDataFrame(rows, PRED), ["run"]).collect()}
    one = got[1]
    assert (one.r2, one.rmse, one.mae, one.spearman, one.kendall_tau) == (1.0, 0.0, 0.0, 1.0, 1.0)
    assert got[2].n_samples == 1 and got[2].rmse is None
    assert got[3].n_samples == 2 and got[3].r2 == 0.0 and got[3].variance_ratio == 0.0


def test_sign_flip_and_holm(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 1, 1)], "k string, d double")
    assert stats.sign_flip(df, ["k"], "d").first().p_value_unadjusted == 0.0625
    tests = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double")
    got = {r.i: r.p_value_holm for r in stats.holm(tests, "p").collect()}
    assert got == pytest.approx({1: 0.03, 2: 0.06, 3: 0.06})


def test_holm_sorts_inside_buckets_only(spark):
    rng = np.random.default_rng(1)
    p = [float(x) for x in np.r_[np.round(rng.random(1500) ** 4, 6), [0.25] * 300, np.nan]]
    tests = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(-1, None)], "i int, p double")
    want, run = {-1: None}, 0.0
    for r, i in enumerate(sorted(range(len(p)), key=lambda i: (np.isnan(p[i]), p[i]))):
        run = max(run, min(1.0, (len(p) - r) * p[i])) if p[i] == p[i] else 1.0
        want[i] = run
    for found in (stats.holm(tests, "p"), stats.holm(tests, "p", bucket_rows=200)):
        assert {r.i: r.p_value_holm for r in found.collect()} == pytest.approx(want)
        windows = re.findall(r"windowspecdefinition\((.*?) (?:ASC|DESC)", found._jdf.queryExecution().analyzed().toString())
        assert windows and all("_bucket" in w for w in windows)


def test_t_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0)], "k string, v double")
    got = {r.k: r for r in stats.t_interval(df, ["k"], "v").collect()}
    assert got["a"].ci95_low == pytest.approx(2 - 4.302652729911 / np.sqrt(3))
    assert got["b"].ci95_low is None


def test_bootstrap_draws_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, 1.0, 2.0) for g in "aabbc"], "g string, y_true double, y_pred double")
    picks = stats.draw_groups(df.withColumn("k", F.lit(0)), ["k"], "g", 50, 7)
    per = picks.groupBy("replicate").agg(F.sum("multiplicity").alias("n")).collect()
    assert len(per) == 50 and all(r.n == 3 for r in per)


def test_bootstrap_with_spearman_reads_rows_once(spark):
    rng = random.Random(4)
    rows = [(f"m{i % 2}", rng.choice("abcdef"), float(rng.randrange(9)), rng.choice([1.5, 2.0, rng.random()])) for i in range(300)]
    rows += [("m0", "a", None, 1.0), ("m1", "b", 2.0, float("nan")), ("one", "a", 1.0, 3.0), ("flat", "a", 1.0, 3.0), ("flat", "b", 1.0, 4.0)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame(rows, "model string, g string, y_true double, y_pred double")
    got = stats.group_bootstrap(plain.mapInArrow(counted, plain.schema), ["model"], "g", replicates=50).collect()
    assert read.value == len(rows)
    point = metrics.regression(plain.filter("y_true is not null"), ["model"]).join(metrics.spearman(plain, ["model"]), "model", "left").collect()
    want = {(r.model, m): r[m] for r in point for m in ("r2", "rmse", "mae", "spearman")}
    found = {(r.model, r.metric): r.estimate for r in got}
    assert found.keys() == want.keys()
    assert all(found[k] == (None if want[k] is None else pytest.approx(want[k], abs=1e-9)) for k in want)


def test_bootstrap_difference_of_equal_models_is_zero(table):
    _, df = table
    both = df.withColumns({"y_pred_x": F.col("y_pred"), "y_pred_y": F.col("y_pred"), "g": F.col("id") % 9})
    got = stats.group_bootstrap_diff(both, ["run"], "g", replicates=20).collect()
    assert len(got) == 8
    assert all(r.observed_difference == r.ci95_low == r.ci95_high == 0.0 for r in got)


def test_weighted_spearman_equals_repeated_rows(table):
    _, df = table
    w = df.withColumn("w", F.col("id") % 3 + 1)
    repeated = w.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    a = {r.run: r.spearman for r in metrics.spearman(w, ["run"], weight="w").collect()}
    b = {r.run: r.spearman for r in metrics.spearman(repeated, ["run"]).collect()}
    assert a == pytest.approx(b)


def test_sign_test(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, -1.0, 0.0)], "d double")
    row = stats.sign_test(df, [], "d").first()
    assert row.exact_sign_test_p == pytest.approx(2 * (1 + 4) / 16)
    assert row.proportion_improved == 0.6 and row.proportion_tied == 0.2


def test_family_without_valid_pairs(spark):
    rows = [("m", "f", 1, 1.0, 1.0), ("m", "f", 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, family_id string, id int, y_true double, y_pred double")
    row = ranking.family_accuracy(df, ["model", "family_id"], "id").first()
    assert row.valid_pair_count == 0 and row.pairwise_accuracy is None


def test_attribution_blocks(spark):
    names = {
        "mol_weight": "A",
        "anchor_pos_mean": "B1",
        "anchor_res_A": "B2",
        "anchor_hydrophobic_frac": "B3",
        "edit_family_backbone": "C",
    }
    df = spark.createDataFrame([(0, k, -1.0 * i) for i, k in enumerate(names, 1)], "seed int, feature string, contribution double")
    shares = attribution.with_blocks(attribution.feature_share(df, ["seed"]))
    assert {r.feature: r.block for r in shares.collect()} == names
    got = {r.block: r.attribution_proportion for r in attribution.block_share(shares, ["seed"]).collect()}
    assert got["B"] == pytest.approx(got["B1"] + got["B2"] + got["B3"])
    assert got["A"] + got["B"] + got["C"] == pytest.approx(1.0)


def test_missing_runs(spark):
    grid = runs.expected_grid(spark, {"model": ["a", "b"], "seed": [0, 1]})
    rows = spark.createDataFrame([("a", 0, "completed"), ("a", 1, "failed")], "model string, seed int, status string")
    preds = spark.createDataFrame([("a", 0)], "model string, seed int")
    trials = spark.createDataFrame([("a", 0), ("a", 0)], "model string, seed int")
    done = runs.completed(rows, preds, trials, ["model", "seed"], 2)
    assert runs.missing(grid, done, ["model", "seed"]).count() == 3


def test_model_cell_learns_and_records_failure(spark):
    df = spark.range(200).select(
        "id",
        (F.col("id") % 13).cast("double").alias("x"),
        (F.col("id") % 7).cast("double").alias("z"),
        F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train").alias("split"),
    ).withColumn("label", 2 * F.col("x") - F.col("z"))
    cell = models.run_cell(df, "id", "label", ["x", "z"], "ridge", "m", 0, "s", {"alpha": 0.001})
    assert metrics.regression(cell.predictions, ["model_id"]).first().r2 > 0.999
    bad = models.run_cell(df, "id", "label", ["nope"], "ridge", "m", 0, "s")
    assert bad.status == "failed" and "nope" in bad.error


def test_sign_flip_of_many_values(spark):
    # Twos only: the share is a binomial tail. Mixed values: all sign vectors, one by one.
    import itertools
    import math

    rng = random.Random(3)
    mixed = [round(rng.gauss(0.4, 1), 2) for _ in range(14)]
    groups = {"ones": [2.0] * 19 + [-2.0] * 11, "odd": [1.0] * 25 + [-1.0] * 12, "mixed": mixed, "zero": [1.0, -1.0], "one": [3.0]}
    groups["long"] = [rng.gauss(0, 1) for _ in range(40)]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, d double")
    got = {r.g: r.p_value_unadjusted for r in stats.sign_flip(df, ["g"], "d").collect()}
    tail = lambda n, far: sum(math.comb(n, k) for k in range(n + 1) if abs(n - 2 * k) >= far) / 2**n
    assert got["ones"] == pytest.approx(tail(30, 8)) and got["odd"] == pytest.approx(tail(37, 13))
    flips = [abs(sum(s * v for s, v in zip(signs, mixed, strict=True))) >= abs(sum(mixed)) - 1e-9 for signs in itertools.product((1, -1), repeat=14)]
    assert got["mixed"] == pytest.approx(sum(flips) / len(flips))
    assert got["zero"] == 1.0 and got["one"] == 1.0 and 0 < got["long"] <= 1


def test_sign_flip_beyond_its_limit_is_an_error(spark):
    df = spark.createDataFrame([(float(i),) for i in range(45)], "d double")
    with pytest.raises(Exception, match="more than 44"):
        stats.sign_flip(df, [], "d").collect()


def test_buckets_follow_the_row_count(spark):
    value = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * F.col("id"))
    df = spark.range(100_000).select(F.lit("a").alias("g"), value.cast("double").alias("v"))
    rows = ranks.with_bucket(df, ["g"], "v", bucket_rows=50)
    size = rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert sum(r.n for r in size) == 100_000
    assert all(r.n <= 100 or r.lo == r.hi for r in size)
    assert all(a.hi < b.lo for a, b in zip(size, size[1:], strict=False))


def test_spearman_of_replicates_is_that_of_each_resample(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 8)
    monkeypatch.setattr(replicates, "BUCKET_ROWS", 16)
    rng = random.Random(1)
    draw = lambda: rng.choice([rng.random(), float(rng.randint(0, 3))])
    data = [(m, f"g{rng.randint(0, 9)}", draw(), draw(), draw()) for m in ("a", "b") for _ in range(120)] + [("a", "g0", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "m string, g string, y_true double, y_pred double, other double")
    picks = stats.settle(stats.draw_groups(df.select("m", "g").distinct(), ["m"], "g", 21, 5))
    got = {(r.m, r.replicate): r.spearman for r in replicates.spearman(df, ["m"], "g", "y_true", "y_pred", picks).collect()}
    slim = df.filter("y_true is not null").groupBy("m", "g", "y_true", "y_pred").agg(F.count("*").alias("c"))
    rows = picks.join(slim, ["m", "g"]).withColumn("w", F.col("multiplicity") * F.col("c"))
    want = {(r.m, r.replicate): r.spearman for r in metrics.spearman(rows, ["m", "replicate"], "y_true", "y_pred", weight="w").collect()}
    assert got == pytest.approx(want) and len(got) == 42


def test_binomial_tail_is_exact(spark):
    import math

    cases = [(1, 0), (5, 1), (10, 4), (300, 120), (1000, 480), (2001, 1000)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", stats.binomial_tail(F.col("n"), F.col("k")))
    for r in df.collect():
        want = min(1.0, 2 * sum(math.comb(r.n, i) for i in range(r.k + 1)) / 2**r.n)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_spearman_and_kendall_have_the_null_group(spark):
    rows = [(g, i, float(i), float((i * 7) % 11)) for g in (None, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id int, y_true double, y_pred double")
    rho = {r.g: r.spearman for r in metrics.spearman(df, ["g"]).collect()}
    tau = {r.g: r.kendall_tau for r in metrics.kendall(df, ["g"], bucket_rows=8).collect()}
    assert set(rho) == set(tau) == {None, "a"}
    assert rho[None] == pytest.approx(rho["a"]) and tau[None] == pytest.approx(tau["a"])


def test_spearman_of_replicates_with_few_groups_carries_no_replicates(spark, monkeypatch):
    rows = [(m, g, float(i * 7 % 13), float((i * i + 3 * g) % 11)) for m in ("a", "b") for g in range(5) for i in range(9)]
    df = spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0), ("c", 0, 1.0, 2.0), ("a", None, 3.0, 4.0)], "m string, g int, y_true double, y_pred double")
    picks = spark.createDataFrame(
        [(m, r, g, 1 + (r * (g + 1)) % 3) for m in ("a", "b", "c") for r in range(1, 300) for g in range(5) if (r + g) % 4] + [("a", 5, None, 2)],
        "m string, replicate int, g int, multiplicity int",
    )
    few = {(r.m, r.replicate): r.spearman for r in replicates.spearman(df, ["m"], "g", "y_true", "y_pred", picks).collect()}
    monkeypatch.setattr(replicates, "FEW", 0)
    many = {(r.m, r.replicate): r.spearman for r in replicates.spearman(df, ["m"], "g", "y_true", "y_pred", picks).collect()}
    assert few.keys() == many.keys() and any(v is None for v in few.values())
    assert all((v is None) == (few[k] is None) and (v is None or abs(v - few[k]) < 1e-9) for k, v in many.items())

    def refused(*_):
        raise AssertionError("vectors of replicates for few groups")

    monkeypatch.setattr(replicates, "FEW", 64)
    monkeypatch.setattr(replicates, "_multiplicities", refused)
    assert replicates.spearman(df, ["m"], "g", "y_true", "y_pred", picks).count() == len(few)


def test_a_key_with_all_rows_is_not_one_task(spark):
    """Edges of few keys go to the rows; the rows are not dealt out by key."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("v"))
    df = df.repartition(8)
    placed = ranks.with_bucket(df, ["g"], "v", bucket_rows=100)
    parts = placed.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert parts == 8
    # The same buckets if the edges are joined by key.
    try:
        ranks.SENT_EDGES, held = 0, ranks.SENT_EDGES
        other = ranks.with_bucket(df, ["g"], "v", bucket_rows=100)
        assert placed.groupBy("g").agg(F.sum("_bucket")).exceptAll(other.groupBy("g").agg(F.sum("_bucket"))).isEmpty()
    finally:
        ranks.SENT_EDGES = held
