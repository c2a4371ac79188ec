"""Feature selection: correlation, mutual information, embedded models, recursive elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import col, numeric_columns
from ..functions.quantiles import exact_quantiles


MI_BINS = 10


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, correlation), strongest first."""
    columns = list(columns or numeric_columns(df, [target]))
    entries = [F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("x"), col(target).cast("double").alias("y")) for c in columns]
    long = df.select(F.inline(F.array(*entries)))
    strength = long.groupBy("feature").agg(F.abs(F.nanvl(F.corr("x", "y"), F.lit(None).cast("double"))).alias("correlation"))
    return strength.orderBy(F.desc_nulls_last("correlation"), "feature")


def select_by_correlation(df: DataFrame, target: str, threshold: float = 0.05, columns: Sequence[str] | None = None) -> DataFrame:
    return target_correlations(df, target, columns).filter(F.col("correlation") >= threshold)


def mutual_information(df: DataFrame, target: str, task: str = "classification", bins: int = MI_BINS, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, score) in nats, from counts over equal-frequency bins of the complete rows.

    A plug-in estimate: deterministic, mergeable and monotone-invariant, unlike a nearest-neighbour
    estimate, so its scores are not comparable with one. A regression target is binned as well.
    """
    columns = list(columns or numeric_columns(df, [target]))
    rows = df.na.drop(subset=[*columns, target])
    cuts = [i / bins for i in range(1, bins)]
    binned = [*columns] if task == "classification" else [*columns, target]
    edges = exact_quantiles(rows, {c: cuts for c in binned})

    def bin_of(c: str):
        x = col(c).cast("double")
        return sum((F.when(x > F.lit(e), 1).otherwise(0) for e in sorted(set(edges[c]))), F.lit(0))

    y = (bin_of(target) if task != "classification" else col(target)).cast("string")
    entries = [F.struct(F.lit(c).alias("feature"), bin_of(c).alias("b")) for c in columns]
    long = rows.select(y.alias("y"), F.inline(F.array(*entries)))
    joint = long.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    # at most features * bins * classes rows from here on
    totals = joint.withColumns({
        "nx": F.sum("n").over(W.partitionBy("feature", "b")),
        "ny": F.sum("n").over(W.partitionBy("feature", "y")),
        "nt": F.sum("n").over(W.partitionBy("feature")),
    })
    p = F.col("n") / F.col("nt")
    term = p * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return totals.groupBy("feature").agg(F.sum(term).alias("score")).orderBy(F.desc("score"), "feature")


def assemble(df: DataFrame, features: Sequence[str], target: str, name: str = "features") -> DataFrame:
    rows = df.na.drop(subset=[*features, target]).withColumn("__label", col(target).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(rows).select(name, F.col("__label").alias("label"))


def _coefficients(df: DataFrame, features: Sequence[str], model) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def lasso(df: DataFrame, target: str, alpha: float = 0.01, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimises ||y - Xw||^2 / (2 n) + alpha ||w||_1 (also for class labels)."""
    features = list(columns or numeric_columns(df, [target]))
    data = assemble(df, features, target)
    model = LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-9).fit(data)
    return _coefficients(df, features, model)


def ridge(df: DataFrame, target: str, alpha: float = 1.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimises ||y - Xw||^2 + alpha ||w||^2. The solver works on a label divided by its deviation, hence the factor."""
    features = list(columns or numeric_columns(df, [target]))
    data = assemble(df, features, target)
    row = data.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    reg = alpha * (row["s"] or 1.0) / row["n"]
    model = LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal").fit(data)
    return _coefficients(df, features, model)


def forest(task: str, trees: int, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return kind(numTrees=trees, seed=seed, maxDepth=5, cacheNodeIds=True)


def tree_importance(df: DataFrame, target: str, task: str = "classification", trees: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    features = list(columns or numeric_columns(df, [target]))
    model = forest(task, trees).fit(assemble(df, features, target))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def recursive_elimination(df: DataFrame, target: str, n_features: int = 10, task: str = "classification", trees: int = 50, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, ranking): 1 for the kept features, 2 for the last one dropped, and so on.

    The narrow input is cached once; each round only assembles fewer columns of it.
    """
    features = list(columns or numeric_columns(df, [target]))
    base = df.na.drop(subset=[*features, target]).select(*[col(c).cast("double").alias(c) for c in [*features, target]]).persist()
    try:
        left, dropped = list(features), []
        while len(left) > max(1, n_features):
            scores = forest(task, trees).fit(assemble(base, left, target)).featureImportances.toArray()
            worst = min(range(len(left)), key=lambda i: (scores[i], i))
            dropped.append(left.pop(worst))
    finally:
        base.unpersist()
    rows = [(f, 1) for f in left] + [(f, i + 2) for i, f in enumerate(reversed(dropped))]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int")


def select_features(df: DataFrame, target: str, method: str, task: str = "classification", n: int | None = None, exclude: Sequence[str] = ()) -> list[str] | None:
    """Names of the chosen features, or None for an unknown method."""
    columns = numeric_columns(df, [target, *exclude])
    if not columns:
        return []
    if method == "correlation":
        return [r["feature"] for r in select_by_correlation(df, target, columns=columns).collect()]
    if method == "mutual_info":
        scores = mutual_information(df, target, task, columns=columns)
        return [r["feature"] for r in scores.limit(min(n or 20, len(columns))).collect()]
    if method == "rfe":
        ranks = recursive_elimination(df, target, n or 10, task, columns=columns)
        return [r["feature"] for r in ranks.filter("ranking = 1").collect()]
    if method in ("lasso", "ridge"):
        weights = (lasso if method == "lasso" else ridge)(df, target, columns=columns)
        return [r["feature"] for r in weights.filter(F.abs("coefficient") >= 0.01).collect()]
    if method == "tree":
        return [r["feature"] for r in tree_importance(df, target, task, columns=columns).filter("importance >= 0.01").collect()]
    return None
