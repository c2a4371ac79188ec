"""Model registry on top of MLlib: training, prediction, evaluation, stacking.

A trained model adds ``prediction`` and ``scores`` (one number per class, summing to one; empty for
regression) to any table with a ``features`` vector.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from . import metrics
from .kernel import COMPONENTS, KERNELS, fit_fourier, fit_margins, fit_support_regression
from .split import kfold

SEED = 42
CLASSIFICATION = {
    "logistic_regression": "Logistic Regression", "decision_tree": "Decision Tree", "random_forest": "Random Forest", "xgboost": "Boosted Trees (deep)",
    "lightgbm": "Boosted Trees (fast)", "catboost": "Boosted Trees (slow learning)", "svm": "Support Vector Machine", "mlp": "MLP Neural Network",
}
REGRESSION = {
    "linear_regression": "Linear Regression", "decision_tree": "Decision Tree", "random_forest": "Random Forest", "xgboost": "Boosted Trees (deep)",
    "lightgbm": "Boosted Trees (fast)", "catboost": "Boosted Trees (slow learning)", "svm": "Support Vector Regression",
}
CLUSTERING = {"kmeans": "K-Means", "dbscan": "DBSCAN", "hierarchical": "Hierarchical Clustering", "gmm": "Gaussian Mixture Model"}
ALIASES = {"svr": "svm", "svc": "svm"}
# (rounds, depth, step) of the three boosting presets
BOOSTING = {"xgboost": (100, 6, 0.3), "lightgbm": (100, 5, 0.1), "catboost": (100, 6, 0.05)}
TREES = ("decision_tree", "random_forest", *BOOSTING)
TREE_DEPTH, FOREST_DEPTH = 10, 8


def available_models(task: str | None = None) -> dict[str, str]:
    known = {"classification": CLASSIFICATION, "regression": REGRESSION, "clustering": CLUSTERING}
    if task in known:
        return dict(known[task])
    return {**CLASSIFICATION, **REGRESSION, **CLUSTERING}


# estimators ----------------------------------------------------------------------------------------
def _tree_params(params: dict[str, Any], depth: int) -> dict[str, Any]:
    deepest = int(params.get("max_depth") or depth)
    if deepest > 30:
        raise ValueError("trees deeper than 30 levels are not supported")
    out = {"maxDepth": deepest, "seed": int(params.get("random_state", SEED))}
    leaf = max(int(params.get("min_samples_leaf", 1)), -(-int(params.get("min_samples_split", 2)) // 2))
    out["minInstancesPerNode"] = leaf
    if "max_bins" in params:
        out["maxBins"] = int(params["max_bins"])
    return out


def _boosting(name: str, params: dict[str, Any]) -> dict[str, Any]:
    rounds, depth, step = BOOSTING[name]
    if "num_leaves" in params and "max_depth" not in params:
        depth = max(2, int(params["num_leaves"]).bit_length() - 1)
    out = _tree_params(params, depth)
    out["maxIter"] = int(params.get("n_estimators", params.get("iterations", rounds)))
    out["stepSize"] = float(params.get("learning_rate", step))
    out["subsamplingRate"] = float(params.get("subsample", 1.0))
    if "colsample_bytree" in params:
        out["featureSubsetStrategy"] = str(float(params["colsample_bytree"]))
    return out


def make_estimator(name: str, task: str, params: dict[str, Any], n_rows: int, n_features: int, n_classes: int):
    """The MLlib estimator for a registry name; parameters keep their familiar names."""
    name = ALIASES.get(name, name)
    classify = task == "classification"
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (float(params.get("C", 1.0)) * n_rows), elasticNetParam=0.0, standardization=False, maxIter=int(params.get("max_iter", 1000)))
    if name == "linear_regression":
        return LinearRegression(regParam=0.0)
    if name == "decision_tree":
        return (DecisionTreeClassifier if classify else DecisionTreeRegressor)(**_tree_params(params, TREE_DEPTH))
    if name == "random_forest":
        kind = RandomForestClassifier if classify else RandomForestRegressor
        return kind(numTrees=int(params.get("n_estimators", 100)), **_tree_params(params, FOREST_DEPTH))
    if name in BOOSTING:
        if not classify:
            return GBTRegressor(**_boosting(name, params))
        base = GBTClassifier(**_boosting(name, params))
        return base if n_classes <= 2 else OneVsRest(classifier=base, parallelism=4)
    if name == "svm" and classify:
        base = LinearSVC(regParam=1.0 / (float(params.get("C", 1.0)) * n_rows), maxIter=int(params.get("max_iter", 100)))
        return base if n_classes <= 2 else OneVsRest(classifier=base, parallelism=4)
    if name == "mlp" and classify:
        hidden = list(params.get("hidden_layer_sizes", (100, 50)))
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=int(params.get("max_iter", 200)), seed=int(params.get("random_state", SEED)))
    if name == "gmm":
        return GaussianMixture(k=int(params.get("n_components", 3)), seed=SEED)
    raise ValueError(f"no estimator for {name} / {task}")


# trained models ------------------------------------------------------------------------------------
@dataclass
class TrainedModel:
    name: str
    task: str
    model: Any
    features: list[str]
    n_classes: int = 0
    calibration: list[tuple[float, float]] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    train_time: float = 0.0
    n_samples: int = 0

    @property
    def display_name(self) -> str:
        return available_models(self.task).get(ALIASES.get(self.name, self.name), self.name)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        added = [c for c in ("rawPrediction", "probability") if c in out.columns]
        if self.task != "classification":
            return out.drop(*added).withColumn("scores", F.array().cast("array<double>"))
        if "probability" in out.columns:
            scores = vector_to_array("probability")
        else:
            # margins: a logistic curve per class, then scaled to sum to one
            raw = vector_to_array("rawPrediction")
            curves = self.calibration or [(-2.0, 0.0)] * self.n_classes
            each = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * raw[i] + F.lit(b))) for i, (a, b) in enumerate(curves)]
            if len(each) == 2:
                each = [F.lit(1.0) - each[1], each[1]]
            total = sum(each[1:], each[0])
            scores = F.array(*[F.coalesce(F.try_divide(e, total), F.lit(1.0 / len(each))) for e in each])
        return out.withColumn("scores", scores).drop(*added)


def _calibrate(model, df: DataFrame, n_classes: int) -> list[tuple[float, float]]:
    """One logistic curve per class from margin to probability, as (slope, offset) of exp(slope * m + offset)."""
    scored = model.transform(df).select("label", vector_to_array("rawPrediction").alias("raw")).persist()
    try:
        curves = []
        for c in range(n_classes):
            one = scored.select((F.col("label") == float(c)).cast("double").alias("label"), array_to_vector(F.array(F.col("raw")[c])).alias("features"))
            fit = LogisticRegression(maxIter=50).fit(one)
            curves.append((-float(fit.coefficients[0]), -float(fit.intercept)))
        return curves
    finally:
        scored.unpersist()


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df).select(*[col(c) for c in keep], "features")


def class_count(df: DataFrame) -> int:
    """MLlib numbers classes 0..max."""
    return int(df.agg(F.max("label")).first()[0] or 0) + 1


def train(name: str, df: DataFrame, features: Sequence[str], task: str = "classification", params: dict[str, Any] | None = None, n_rows: int | None = None, n_classes: int | None = None) -> TrainedModel:
    """Fit one model on (features vector, label). Cache or write the input first when fitting several."""
    if ALIASES.get(name, name) not in available_models(task):
        raise ValueError(f"model {name!r} is not suitable for task {task!r}")
    params = dict(params or {})
    start = time.time()
    n_rows = df.count() if n_rows is None else n_rows
    if task == "classification" and n_classes is None:
        n_classes = max(2, class_count(df))
    n_classes = n_classes or 0
    if name == "kmeans":
        k, restarts = int(params.get("n_clusters", 3)), int(params.get("n_init", 10))
        fits = [KMeans(k=k, seed=SEED + i).fit(df) for i in range(restarts)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
    elif name == "hierarchical":
        from .cluster import fit_ward  # noqa: PLC0415
        model = fit_ward(df, len(features), int(params.get("n_clusters", 3)))
    elif name == "dbscan":
        from .cluster import fit_dbscan  # noqa: PLC0415
        model = fit_dbscan(df, len(features), float(params.get("eps", 0.5)), int(params.get("min_samples", 5)))
    elif ALIASES.get(name, name) == "svm":
        model = _support_machine(df, task, params, n_rows, len(features), n_classes)
    else:
        model = _fitted(make_estimator(name, task, params, n_rows, len(features), n_classes), name, df, task, params, n_rows, len(features), n_classes)
    trained = TrainedModel(ALIASES.get(name, name), task, model, list(features), n_classes, params=params, n_samples=n_rows)
    if task == "classification" and ALIASES.get(name, name) == "svm":
        trained.calibration = _calibrate(model, df, n_classes)
    trained.train_time = round(time.time() - start, 3)
    return trained


def _fitted(estimator, name: str, df: DataFrame, task: str, params: dict[str, Any], n_rows: int, n_features: int, n_classes: int):
    """Trees are fitted over cells of rows in the same bins where these are far fewer than the rows."""
    model = None
    if name in TREES:
        from . import cells  # noqa: PLC0415
        model = cells.fit(estimator, name, df, n_features, task, params, n_rows, n_classes, (FOREST_DEPTH, TREE_DEPTH))
    return estimator.fit(df) if model is None else model


def _support_machine(df: DataFrame, task: str, params: dict[str, Any], n_rows: int, n_features: int, n_classes: int):
    """Gaussian kernel unless ``kernel`` says linear."""
    kernel = params.get("kernel", "rbf")
    if task != "classification":
        return fit_support_regression(df, n_features, params)
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {tuple(KERNELS)}")
    if kernel == "linear":
        return make_estimator("svm", task, params, n_rows, n_features, n_classes).fit(df)
    fourier = fit_fourier(df, n_features, params.get("gamma", "scale"), int(params.get("n_components", COMPONENTS)), int(params.get("random_state", SEED)))
    return fit_margins(df, n_features, n_classes, float(params.get("C", 1.0)), fourier, int(params.get("max_iter", 100)))


def train_many(names: Sequence[str] | None, df: DataFrame, features: Sequence[str], task: str = "classification", params: dict[str, dict[str, Any]] | None = None, parallelism: int = 4) -> dict[str, TrainedModel | str]:
    """Each model or the text of its error: one failure leaves the others alone."""
    names = list(names or available_models(task))
    params = params or {}
    n_rows = df.count()
    n_classes = max(2, class_count(df)) if task == "classification" else None

    def one(name: str) -> TrainedModel | str:
        try:
            return train(name, df, features, task, params.get(name), n_rows, n_classes)
        except Exception as e:
            return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(names, pool.map(one, names)))


# evaluation ----------------------------------------------------------------------------------------
def evaluate(trained: Any, df: DataFrame) -> dict[str, float | None]:
    """Metrics of a model on (features, label) rows; the predictions are computed once."""
    scored = trained.predict(df)
    if trained.task == "clustering":
        from .cluster import silhouette  # noqa: PLC0415
        return {"silhouette": silhouette(scored)}
    if trained.task == "regression":
        return metrics.regression_scores(scored).first().asDict()
    slim = scored.select("label", "prediction", "scores").persist()
    try:
        out = metrics.weighted_prf(slim).first().asDict()
        classes = [r[0] for r in slim.select("label").distinct().orderBy("label").collect()]
        if len(classes) == 2 and trained.n_classes == 2:
            auc = metrics.auc_binary(slim.select("label", F.col("scores")[1].alias("score")))
        else:
            parts = slim.select("label", *[F.col("scores")[int(c)].alias(f"s{int(c)}") for c in classes])
            auc = metrics.auc_one_vs_rest(parts, {c: f"s{int(c)}" for c in classes})
        out["roc_auc"] = auc.first()["roc_auc"]
        return out
    finally:
        slim.unpersist()


PRIMARY = {"classification": "f1", "regression": "r2", "clustering": "silhouette"}


def evaluate_many(trained: dict[str, Any], df: DataFrame, task: str) -> dict[str, dict[str, Any]]:
    """Metrics, training time and rank per model; a failure becomes an error entry."""
    results: dict[str, dict[str, Any]] = {}
    for name, model in trained.items():
        if isinstance(model, str):
            results[name] = {"error": model}
            continue
        try:
            results[name] = {**evaluate(model, df), "train_time": model.train_time, "display_name": model.display_name}
        except Exception as e:
            results[name] = {"error": f"evaluation failed: {e}", "display_name": model.display_name}
    return rank_results(results, PRIMARY[task])


def rank_results(results: dict[str, dict[str, Any]], metric: str) -> dict[str, dict[str, Any]]:
    good = [n for n, r in results.items() if "error" not in r]
    missing = float("-inf")
    ordered = sorted(good, key=lambda n: (-(results[n].get(metric) if results[n].get(metric) is not None else missing), n))
    for i, n in enumerate(ordered):
        results[n]["rank"] = i + 1
    return results


def results_table(spark, results: dict[str, dict[str, Any]]) -> DataFrame:
    """(model, metric, value) rows."""
    rows = []
    for name, r in results.items():
        if "error" in r:
            rows.append((name, "error", None))
        rows += [(name, k, float(v)) for k, v in r.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "model string, metric string, value double")


# stacking ------------------------------------------------------------------------------------------
@dataclass
class StackedModel:
    task: str
    bases: list[TrainedModel]
    meta: TrainedModel
    n_classes: int = 0
    name: str = "stacking"
    display_name: str = "Stacking Ensemble"
    train_time: float = 0.0
    n_samples: int = 0

    @property
    def features(self) -> list[str]:
        return self.bases[0].features

    def predict(self, df: DataFrame) -> DataFrame:
        wide = _base_columns(self.bases, df)
        meta_in = wide.withColumnRenamed("features", "__x").withColumn("features", array_to_vector(_meta_array(self.bases)))
        out = self.meta.predict(meta_in).drop("features", *[f"__b{i}" for i in range(len(self.bases))])
        return out.withColumnRenamed("__x", "features")


def _base_columns(bases: Sequence[TrainedModel], df: DataFrame) -> DataFrame:
    """One array per base model: class scores, or the predicted value."""
    for i, b in enumerate(bases):
        scored = b.predict(df)
        made = F.col("scores") if b.task == "classification" else F.array("prediction")
        df = scored.withColumn(f"__b{i}", made).drop("prediction", "scores")
    return df


def _meta_array(bases: Sequence[TrainedModel]):
    # the last class score follows from the others
    return F.concat(*[
        F.slice(F.col(f"__b{i}"), 1, b.n_classes - 1) if b.task == "classification" else F.col(f"__b{i}") for i, b in enumerate(bases)
    ])


def stack_models(top: Sequence[TrainedModel], df: DataFrame, key: str, folds: int = 3, parallelism: int = 4) -> StackedModel | None:
    """Out-of-fold scores of the base models feed a logistic or ridge model; the bases stay fitted on all rows."""
    if len(top) < 2:
        return None
    start, task, n_classes = time.time(), top[0].task, top[0].n_classes
    folded = kfold(df, key, folds, "label" if task == "classification" else None).persist()
    try:
        sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}

        def fit(job: tuple[int, TrainedModel]) -> TrainedModel:
            f, b = job
            rows = sum(sizes.values()) - sizes.get(f, 0)
            return train(b.name, folded.filter(F.col("fold") != f), b.features, task, b.params, rows, n_classes or None)

        # folds x bases are independent jobs on one cached table
        with ThreadPoolExecutor(parallelism) as pool:
            fitted = list(pool.map(fit, [(f, b) for f in range(folds) for b in top]))
        parts = None
        for f in range(folds):
            fold_bases = fitted[f * len(top):(f + 1) * len(top)]
            one = _base_columns(fold_bases, folded.filter(F.col("fold") == f).select("label", "features"))
            one = one.select("label", array_to_vector(_meta_array(fold_bases)).alias("features"))
            parts = one if parts is None else parts.unionByName(one)
        meta_in = parts.persist()
        try:
            names = [f"meta{i}" for i in range(len(meta_in.first()["features"]))]
            n = meta_in.count()
            if task == "classification":
                meta = train("logistic_regression", meta_in, names, task, n_rows=n, n_classes=n_classes)
            else:
                spread = meta_in.agg(F.stddev_pop("label")).first()[0] or 1.0
                fit = LinearRegression(regParam=spread / n, elasticNetParam=0.0, standardization=False).fit(meta_in)
                meta = TrainedModel("ridge", task, fit, names)
        finally:
            meta_in.unpersist()
    finally:
        folded.unpersist()
    return StackedModel(task, list(top), meta, n_classes, train_time=round(time.time() - start, 2), n_samples=n)


def importances(trained: TrainedModel) -> list[tuple[str, float]]:
    """Tree importances or mean absolute coefficients over the classes, largest first."""
    import numpy as np

    def of(model) -> Any:
        if hasattr(model, "featureImportances"):
            return np.asarray(model.featureImportances.toArray())
        if hasattr(model, "coefficientMatrix"):
            return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
        if hasattr(model, "coefficients"):
            return np.abs(model.coefficients.toArray())
        if hasattr(model, "models"):
            each = [of(m) for m in model.models]
            return None if any(e is None for e in each) else np.mean(each, axis=0)
        return None

    values = of(trained.model)
    if values is None:
        return []
    return sorted(((f, round(float(v), 6)) for f, v in zip(trained.features, values)), key=lambda p: (-p[1], p[0]))
