"""Linear fits from sums of squares against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoframe.operators import linear, models
from annoframe.plans import model_runs

RNG = np.random.default_rng(4)
N, COLUMNS = 240, ["a", "b", "c", "flat"]
X = np.column_stack([RNG.normal(5, 2, N), RNG.normal(0, 1, N), RNG.integers(0, 3, N), np.full(N, 7.0)])
Y = 3 * X[:, 0] - X[:, 1] + RNG.normal(0, 0.5, N)
FAMILY = ["f%d" % (i % 5) if i % 6 else None for i in range(N)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, FAMILY[i], *map(float, X[i]), float(Y[i]), i % 7) for i in range(N)]
    return spark.createDataFrame(data, "id int, family string, a double, b double, c double, flat double, label double, yr int").repartition(5)


def scaled(x, of):
    sd = of.std(axis=0)
    return (x - of.mean(axis=0)) / np.where(sd > 1e-9, sd, 1)


def plain_ridge(x, y, test, alpha):
    z = scaled(x, x)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + scaled(test, x) @ w


def test_matrices_add_up_under_salts_and_null_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(linear, "HELD_BYTES", 600)
    found = {r.family: linear.Gram.of(bytes(r.gram)) for r in linear.grams(rows, COLUMNS, "label", ["family"]).collect()}
    assert set(found) == set(FAMILY)
    for fam, gram in found.items():
        at = [i for i in range(N) if FAMILY[i] == fam]
        z = np.column_stack([np.ones(len(at)), X[at], Y[at]])
        assert np.allclose(gram.matrix, z.T @ z)
        assert np.allclose(linear.Gram.of(gram.cell()).matrix, gram.matrix)
    whole = linear.total(linear.grams(rows, COLUMNS, "label", ["family"]))
    assert whole.n == N and linear.total(linear.grams(rows.limit(0), COLUMNS, "label", ["family"])) is None


def test_odd_values_count_as_zero_and_rows_without_label_are_left_out(spark):
    data = [(1.0, 2.0), (float("nan"), 3.0), (float("inf"), 4.0), (None, 5.0), (9.0, None), (9.0, float("nan"))]
    df = spark.createDataFrame(data, "x double, label double")
    gram = linear.Gram.of(bytes(linear.grams(df, ["x"], "label").first().gram))
    z = np.array([[1, 1, 2], [1, 0, 3], [1, 0, 4], [1, 0, 5.0]])
    assert np.allclose(gram.matrix, z.T @ z)


def test_ridge_and_its_error(rows):
    gram = linear.Gram.of(bytes(linear.grams(rows, COLUMNS, "label").first().gram))
    for alpha in (1e-4, 1.0, 1e4):
        fit = linear.ridge(gram, alpha)
        got = fit[0] + X @ fit[1:]
        assert np.allclose(got, plain_ridge(X, Y, X, alpha))
        assert gram.rmse(fit) == pytest.approx(np.sqrt(np.mean((Y - got) ** 2)))


@pytest.mark.parametrize("alpha,l1_ratio", [(0.1, 0.5), (1.0, 0.9), (2.0, 0.01), (50.0, 0.99)])
def test_elastic_net_is_optimal(rows, alpha, l1_ratio):
    gram = linear.Gram.of(bytes(linear.grams(rows, COLUMNS, "label").first().gram))
    fit = linear.elastic_net(gram, alpha, l1_ratio)
    z = scaled(X, X)
    w = fit[1:] * np.where(X.std(axis=0) > 1e-9, X.std(axis=0), 1)
    slope = z.T @ (Y - Y.mean() - z @ w) / N - alpha * (1 - l1_ratio) * w
    for g, v in zip(slope, w, strict=True):
        assert g == pytest.approx(alpha * l1_ratio * np.sign(v), abs=1e-8) if v else abs(g) <= alpha * l1_ratio + 1e-8


def test_every_family_in_one_pass(rows):
    roles = rows.filter("id % 3 <> 1").select("id", "family", F.when(F.col("id") % 3 == 0, "support").otherwise("query").alias("role"))
    sets = {"two": ["a", "b"], "all": COLUMNS}
    out = models.leave_family_runs(rows, roles, "id", "label", "family", sets, kind="ridge", params={"alpha": 2.0}).collect()
    asked = [i for i in range(N) if i % 3 == 2]
    assert sorted((r.model, r.sample_id) for r in out) == sorted((m, i) for m in sets for i in asked)
    for name, k in (("two", [0, 1]), ("all", [0, 1, 2, 3])):
        for fam in set(FAMILY):
            test = [i for i in asked if FAMILY[i] == fam]
            train = [i for i in range(N) if i not in test]
            want = dict(zip(test, plain_ridge(X[train][:, k], Y[train], X[test][:, k], 2.0), strict=True))
            got = {r.sample_id: r.y_pred for r in out if r.model == name and r.family_id == fam}
            assert got == pytest.approx(want)
    some = models.leave_family_runs(rows, roles, "id", "label", "family", sets, ["f1"], "ridge", {"alpha": 2.0})
    assert {r.family_id for r in some.select("family_id").distinct().collect()} == {"f1"}


def test_every_cutoff_in_one_pass(rows):
    cutoffs = [0, 2, 5]
    df = rows.withColumns(
        {
            "train_for": F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c > F.col("yr")),
            "test_for": F.filter(F.array(*map(F.lit, cutoffs)), lambda c: (c <= F.col("yr")) & (F.col("id") % 2 == 0)),
        }
    )
    out = models.time_forward_runs(df, "id", "label", cutoffs, {"m": ["a", "c"]}, "ridge", {"alpha": 1.0}, carry=["family"]).collect()
    assert {r.cutoff for r in out} == {2, 5}  # nothing lies before 0
    for cut in (2, 5):
        train = [i for i in range(N) if i % 7 < cut]
        test = [i for i in range(N) if i % 7 >= cut and i % 2 == 0]
        want = dict(zip(test, plain_ridge(X[train][:, [0, 2]], Y[train], X[test][:, [0, 2]], 1.0), strict=True))
        assert {r.sample_id: r.y_pred for r in out if r.cutoff == cut} == pytest.approx(want)


def test_cutoffs_are_scored_by_matrices(rows):
    """Scores come from one product a batch, not from an expression with a term for each column; odd values count as 0."""
    cutoffs = [2, 5]
    bad = F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).when(F.col("id") % 13 == 0, F.lit(float("inf"))).when(F.col("id") % 17 == 0, None)
    df = rows.withColumns(
        {
            "a": bad.otherwise(F.col("a")),
            "train_for": F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c > F.col("yr")),
            "test_for": F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c <= F.col("yr")),
        }
    )
    sets = {"m": ["a", "c"], "all": COLUMNS}
    out = models.time_forward_runs(df, "id", "label", cutoffs, sets, "ridge", {"alpha": 1.0})
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    x = X.copy()
    x[[i for i in range(N) if i % 11 == 0 or i % 13 == 0 or i % 17 == 0], COLUMNS.index("a")] = 0
    got = {(r.cutoff, r.model, r.sample_id): r.y_pred for r in out.collect()}
    want = {}
    for cut in cutoffs:
        train, test = [i for i in range(N) if i % 7 < cut], [i for i in range(N) if i % 7 >= cut]
        for name, part in sets.items():
            at = [COLUMNS.index(c) for c in part]
            for i, v in zip(test, plain_ridge(x[train][:, at], Y[train], x[test][:, at], 1.0), strict=True):
                want[cut, name, i] = v
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    nothing = models.time_forward_runs(df, "id", "label", [-1], sets, "ridge", {"alpha": 1.0})
    assert nothing.count() == 0


def test_search_never_reads_rows_again_and_never_sees_test_rows(rows):
    df = rows.withColumn("split", F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train"))
    cell = models.run_cell(df, "id", "label", COLUMNS, "elasticnet", "m", 3, "s", n_trials=12)
    assert cell.status == "completed" and cell.run["n_trials"] == 12
    spoiled = df.withColumn("label", F.when(F.col("split") == "test", F.lit(1e9)).otherwise(F.col("label")))
    again = models.run_cell(spoiled, "id", "label", COLUMNS, "elasticnet", "m", 3, "s", n_trials=12)
    assert again.run["best_params"] == cell.run["best_params"]
    assert np.allclose(again.model.parameters, cell.model.parameters)
    val = [i for i in range(N) if i % 5 == 1]
    error = np.sqrt(np.mean((Y[val] - cell.model.parameters[0] - X[val] @ cell.model.coefficients) ** 2))
    assert error == pytest.approx(cell.run["best_validation_rmse"])
    top = {r.feature: r.importance for r in models.importance(cell.model, COLUMNS).collect()}
    assert top == pytest.approx(dict(zip(COLUMNS, np.abs(cell.model.coefficients), strict=True)))


def test_trees_leave_a_null_family_out_of_nothing(rows):
    roles = rows.filter("family = 'f1'").select("id", "family", F.when(F.col("id") % 2 == 0, "support").otherwise("query").alias("role"))
    params = {"n_estimators": 1, "max_depth": 1}
    out = models.leave_family_runs(rows, roles, "id", "label", "family", {"m": ["a"]}, ["f1"], "random_forest", params)
    assert out.count() == sum(f == "f1" and i % 2 for i, f in enumerate(FAMILY))


def test_rows_of_cells_hold_no_column_that_no_cell_reads(spark):
    rows = model_runs.training_rows(spark, "/root/testdata/sf0.001")
    assert set(rows.columns) == {"id", "label", "split", *model_runs.COLUMNS}
