"""Fitting and scoring regressors over a run grid: linear ones from sums of squares (``linear``), trees by MLlib."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions.sequences import zero_nonfinite
from annoframe.operators import linear, metrics, stats
from annoframe.operators.features import MedianImputer, Standardiser

# Search ranges per estimator; a third entry "log" draws on a log scale.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "ridge": {"alpha": (1e-4, 1e4, "log")},
    "elasticnet": {"alpha": (1e-5, 100.0, "log"), "l1_ratio": (0.01, 0.99)},
    "random_forest": {
        "n_estimators": (50, 500),
        "max_depth": (3, 20),
        "min_samples_leaf": (1, 10),
    },
    "boosted": {
        "n_estimators": (200, 2000),
        "max_depth": (2, 10),
        "learning_rate": (0.005, 0.2, "log"),
        "subsample": (0.5, 1.0),
        "colsample": (0.5, 1.0),
        "min_child_weight": (1, 20),
    },
}
IMPORTANCE_TOP = 30


@dataclass
class FeaturePlan:
    """Train-fitted preparation of feature columns: imputation, scaling, assembly."""

    columns: Sequence[str]
    impute: bool = False
    scale: bool = False
    steps: list = field(default_factory=list)

    def fit(self, train: DataFrame) -> FeaturePlan:
        self.steps = []
        current = train
        if self.impute:
            step = MedianImputer(self.columns).fit(current)
            self.steps.append(step)
            current = step.transform(current)
        else:
            current = self._zero(current)
        if self.scale:
            self.steps.append(Standardiser(self.columns).fit(current))
        return self

    def _zero(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: zero_nonfinite(F.col(c)) for c in self.columns})

    def prepare(self, df: DataFrame) -> DataFrame:
        out = df if self.impute else self._zero(df)
        for step in self.steps:
            out = step.transform(out)
        return out

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.columns), outputCol="features").transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assemble(self.prepare(df))


def estimator(kind: str, params: dict, label: str, seed: int):
    """An unfitted MLlib regressor (ML3, ML4)."""
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    if kind == "random_forest":
        return RandomForestRegressor(
            numTrees=int(params.get("n_estimators", 100)),
            maxDepth=min(int(params.get("max_depth", 5)), 30),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            seed=seed,
            **common,
        )
    if kind == "boosted":
        return GBTRegressor(
            maxIter=int(params.get("n_estimators", 100)),
            maxDepth=int(params.get("max_depth", 5)),
            stepSize=params.get("learning_rate", 0.1),
            subsamplingRate=params.get("subsample", 0.8),
            featureSubsetStrategy=str(params.get("colsample", 0.8)),
            minInstancesPerNode=int(params.get("min_child_weight", 1)),
            seed=seed,
            **common,
        )
    raise ValueError(f"unknown estimator {kind!r}; one of {sorted(set(SEARCH_SPACES) - set(linear.FITS))}")


def draw_params(space: dict[str, tuple], trial: int, seed: int) -> dict:
    """Seeded random draw from a search space; integer bounds give integers."""
    import random

    rng = random.Random(f"{seed}:{trial}")
    out = {}
    for name, spec in space.items():
        low, high = spec[0], spec[1]
        if len(spec) > 2:
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif isinstance(low, int) and isinstance(high, int):
            out[name] = rng.randint(low, high)
        else:
            out[name] = rng.uniform(low, high)
    return out


def fit(kind: str, params: dict, train: DataFrame, label: str, seed: int) -> Model:
    return estimator(kind, params, label, seed).fit(train)


def _rmse(model: Model, df: DataFrame, label: str) -> float:
    err = F.col("prediction") - F.col(label)
    return float(model.transform(df).agg(F.sqrt(F.avg(err * err))).first()[0])


def search(
    kind: str,
    train: DataFrame,
    val: DataFrame,
    label: str,
    n_trials: int = 10,
    seed: int = 0,
    space: dict[str, tuple] | None = None,
) -> tuple[Model, dict, list[dict]]:
    """Random search scored by RMSE on the validation rows, then a refit on train (ML5).

    Inputs are assembled frames; test rows are never passed in. Returns the model, its
    parameters and the list of trials.
    """
    space = space or SEARCH_SPACES[kind]
    trials = []
    for t in range(n_trials):
        params = draw_params(space, t, seed)
        model = fit(kind, params, train, label, seed)
        trials.append({"number": t, "value": _rmse(model, val, label), **params})
    best = min(trials, key=lambda x: (x["value"], x["number"]))
    params = {k: v for k, v in best.items() if k not in ("number", "value")}
    return fit(kind, params, train, label, seed), params, trials


def predictions(
    model: Model, df: DataFrame, key: str, label: str, split: str, model_id: str, seed: int, split_type: str
) -> DataFrame:
    """Prediction rows in the published layout."""
    return model.transform(df).select(
        F.col(key).alias("sample_id"),
        F.col(label).cast("double").alias("y_true"),
        F.col("prediction").alias("y_pred"),
        F.lit(split).alias("split"),
        F.lit(model_id).alias("model_id"),
        F.lit(seed).alias("seed"),
        F.lit(split_type).alias("split_type"),
    )


@dataclass
class Cell:
    """Outcome of one (model, split, seed) cell; ``error`` is set when it failed."""

    status: str
    run: dict
    predictions: DataFrame | None = None
    model: Model | None = None
    plan: FeaturePlan | None = None
    error: str | None = None


def run_cell(
    df: DataFrame,
    key: str,
    label: str,
    columns: Sequence[str],
    kind: str,
    model_id: str,
    seed: int,
    split_type: str,
    params: dict | None = None,
    n_trials: int = 0,
    space: dict[str, tuple] | None = None,
    impute: bool = False,
    split: str = "split",
) -> Cell:
    """Prepare, fit or search, and predict the test rows of one cell (ML6).

    A failure is recorded with its text and not raised.
    """
    started = time.perf_counter()
    run = {"model_id": model_id, "seed": seed, "split_type": split_type, "hpo": n_trials > 0}
    try:
        if kind in linear.FITS:
            model, plan, trials, params = _linear(df, label, columns, kind, seed, params, n_trials, space, impute, split)
            run.update(status="completed", n_features=len(columns), best_params=params, runtime_seconds=time.perf_counter() - started)
            if trials:
                run.update(best_validation_rmse=min(t["value"] for t in trials), n_trials=len(trials))
            test = plan.prepare(df.filter(F.col(split) == "test"))
            rows = predictions(model, test, key, label, "test", model_id, seed, split_type)
            return Cell("completed", run, rows, model, plan)
        parts = {s: df.filter(F.col(split) == s) for s in ("train", "val", "test")}
        plan = FeaturePlan(columns, impute).fit(parts["train"])
        ready = {s: plan.transform(part) for s, part in parts.items()}
        train = ready["train"].cache()
        try:
            if n_trials:
                model, params, trials = search(kind, train, ready["val"], label, n_trials, seed, space)
                run["best_validation_rmse"] = min(t["value"] for t in trials)
                run["n_trials"] = len(trials)
            else:
                model = fit(kind, params or {}, train, label, seed)
        finally:
            train.unpersist()
        run.update(
            status="completed",
            n_features=len(columns),
            best_params=params or {},
            runtime_seconds=time.perf_counter() - started,
        )
        rows = predictions(model, ready["test"], key, label, "test", model_id, seed, split_type)
        return Cell("completed", run, rows, model, plan)
    except Exception as exc:  # noqa: BLE001 - the cell records any failure
        run.update(status="failed", error=str(exc))
        return Cell("failed", run, error=str(exc))


def _linear(
    df: DataFrame,
    label: str,
    columns: Sequence[str],
    kind: str,
    seed: int,
    params: dict | None,
    n_trials: int,
    space: dict[str, tuple] | None,
    impute: bool,
    split: str,
) -> tuple[linear.Fitted, FeaturePlan, list[dict], dict]:
    """A linear cell: one pass over train and validation rows, whatever the number of trials."""
    plan = FeaturePlan(columns, impute)
    if impute:
        plan.fit(df.filter(F.col(split) == "train"))
    rows = plan.prepare(df.filter(F.col(split).isin("train", "val")))
    parts = {r[split]: linear.Gram.of(bytes(r["gram"])) for r in linear.grams(rows, columns, label, [split]).collect()}
    if n_trials:
        drawn = [draw_params(space or SEARCH_SPACES[kind], t, seed) for t in range(n_trials)]
        found, params, trials = linear.search(kind, parts["train"], parts["val"], drawn)
    else:
        found, params, trials = linear.fit(kind, params or {}, parts["train"]), dict(params or {}), []
    return linear.Fitted(columns, found), plan, trials, params


def run_seeds(df: DataFrame, seeds: Sequence[int], **cell) -> tuple[DataFrame | None, list[Cell]]:
    """The same cell for several seeds (ML8): predictions of all seeds and the cells."""
    cells = [run_cell(df, seed=s, **cell) for s in seeds]
    frames = [c.predictions for c in cells if c.predictions is not None]
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out, cells


def seed_summary(rows: DataFrame) -> DataFrame:
    """Mean, sd and interval of each metric over seeds (ML8)."""
    per = metrics.key_metrics(rows, ["model_id", "split_type", "seed"])
    return stats.summary(per, ["model_id", "split_type"], list(metrics.KEY_METRICS))


def importance(model: Model | linear.Fitted, columns: Sequence[str], top: int = IMPORTANCE_TOP) -> DataFrame:
    """Feature importances (absolute coefficients of linear models), the largest first (ML9)."""
    values = (
        model.featureImportances.toArray()
        if hasattr(model, "featureImportances")
        else [abs(v) for v in model.coefficients]
    )
    rows = [(c, float(v)) for c, v in zip(columns, values, strict=True)]
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def time_forward_runs(
    df: DataFrame,
    key: str,
    label: str,
    cutoffs: Sequence[int],
    feature_sets: dict[str, Sequence[str]],
    kind: str = "boosted",
    params: dict | None = None,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Train before and score after each cutoff, per feature set (ML10); linear kinds in one pass, trees one by one.

    ``df`` carries the ``train_for`` and ``test_for`` columns of ``splits.time_forward``.
    """
    if kind in linear.FITS:
        return linear.time_forward_runs(df, key, label, cutoffs, feature_sets, kind, params, carry)
    out = None
    for cutoff in cutoffs:
        train = df.filter(F.array_contains("train_for", cutoff))
        test = df.filter(F.array_contains("test_for", cutoff))
        for name, columns in feature_sets.items():
            plan = FeaturePlan(columns).fit(train)
            model = fit(kind, params or {}, plan.transform(train), label, seed)
            rows = model.transform(plan.transform(test)).select(
                F.lit(cutoff).alias("cutoff"),
                F.lit(name).alias("model"),
                F.col(key).alias("sample_id"),
                F.col(label).cast("double").alias("y_true"),
                F.col("prediction").alias("y_pred"),
                *carry,
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def leave_family_runs(
    df: DataFrame,
    roles: DataFrame,
    key: str,
    label: str,
    family: str,
    feature_sets: dict[str, Sequence[str]],
    families: Sequence | None = None,
    kind: str = "boosted",
    params: dict | None = None,
    seed: int = 42,
) -> DataFrame:
    """Train on all other families plus the support rows, score the query rows, per feature set (ML11).

    ``roles`` comes from ``splits.support_query``. Linear kinds do all families in one pass. Trees are fitted one after the
    other: pass the ``families`` to run.
    """
    if kind in linear.FITS:
        if families is not None:
            roles = roles.filter(F.col(family).isin(list(families)))
        return linear.leave_family_runs(df, roles, key, label, family, feature_sets, kind, params)
    marked = df.join(roles.select(key, "role"), key, "left")
    out = None
    for fam in families:
        inside = F.col(family).eqNullSafe(F.lit(fam))
        train = marked.filter(~inside | F.coalesce(F.col("role") == "support", F.lit(False)))
        test = marked.filter(inside & (F.col("role") == "query"))
        for name, columns in feature_sets.items():
            plan = FeaturePlan(columns).fit(train)
            model = fit(kind, params or {}, plan.transform(train), label, seed)
            rows = model.transform(plan.transform(test)).select(
                F.col(family).alias("family_id"),
                F.lit(name).alias("model"),
                F.col(key).alias("sample_id"),
                F.col(label).cast("double").alias("y_true"),
                F.col("prediction").alias("y_pred"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out
