"""Explaining a fitted model: Shapley values, partial dependence, what-if scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import col
from ..functions.staging import materialise, new_path
from .models import TrainedModel

TOP_GLOBAL, TOP_LOCAL, GRID = 10, 15, 50
ENUMERATED = 6  # features of which all coalitions are scored
PAIRS = 8  # pairs of orders drawn at a time
TOLERANCE = 0.02  # standard error that is small enough, as a share of what the contributions explain


# linear models -------------------------------------------------------------------------------------
def linear_contributions(df: DataFrame, key: str, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """(key, feature, contribution) = weight * (value - mean), exact for a linear score."""
    entries = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (col(f).cast("double") - F.lit(float(means[f])))).alias("contribution"))
        for f, w in weights.items()
    ]
    return df.select(col(key), F.inline(F.array(*entries)))


def mean_abs(contributions: DataFrame) -> DataFrame:
    """(feature, mean |contribution|), largest first."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def top_contributions(contributions: DataFrame, key: str, n: int = TOP_LOCAL) -> DataFrame:
    """The strongest features of every row with their direction."""
    rank = F.row_number().over(W.partitionBy(col(key)).orderBy(F.desc(F.abs("contribution")), "feature"))
    direction = F.when(F.col("contribution") > 0, "positive").otherwise("negative")
    return contributions.withColumn("direction", direction).withColumn("rank", rank).filter(F.col("rank") <= n)


# tree models ---------------------------------------------------------------------------------------
def tree_nodes(trained: TrainedModel, spark) -> list[dict[str, np.ndarray]]:
    """Node arrays of every tree, read from the model's own saved form."""
    model = trained.model
    path = new_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        data = data.select("treeID", "nodeData.*")
        weights = list(model.treeWeights)
    else:
        data = data.withColumn("treeID", F.lit(0))
        weights = [1.0]
    single = "GBT" not in type(model).__name__
    scale = 1.0 / len(weights) if single else 1.0
    rows = data.orderBy("treeID", "id").toPandas()  # model size, independent of the data
    trees = []
    for tid, t in rows.groupby("treeID"):
        stats = [np.asarray(s, float) for s in t["impurityStats"]]
        classify = trained.task == "classification" and single
        if classify:
            values = np.array([s / s.sum() if s.sum() else s for s in stats])
            cover = np.array([s.sum() for s in stats])
        else:
            values = t["prediction"].to_numpy()[:, None].astype(float)
            cover = np.array([s[0] for s in stats])
        split = t["split"]
        trees.append({
            "left": t["leftChild"].to_numpy(), "right": t["rightChild"].to_numpy(), "cover": cover, "values": values * weights[tid] * scale,
            "feature": np.array([s["featureIndex"] for s in split]), "categories": np.array([s["numCategories"] for s in split]),
            "split": [np.asarray(s["leftCategoriesOrThreshold"], float) for s in split],
        })
    return trees


def _paths(tree: dict[str, Any]) -> list[tuple[np.ndarray, list[tuple[int, float, list[tuple[Any, bool]]]]]]:
    """Each leaf as its value and, per feature on the way, the share of rows that pass and the tests to pass."""
    leaves, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if tree["left"][node] < 0:
            leaves.append((tree["values"][node], [(f, z, tests) for f, (z, tests) in path.items()]))
            continue
        f = int(tree["feature"][node])
        rule = (tree["split"][node], tree["categories"][node] >= 0)
        for child, go_left in ((tree["left"][node], True), (tree["right"][node], False)):
            z, tests = path.get(f, (1.0, []))
            share = tree["cover"][child] / max(tree["cover"][node], 1e-300)
            todo.append((child, {**path, f: (z * share, [*tests, (rule, go_left)])}))
    return leaves


def _passes(x: np.ndarray, tests: list[tuple[Any, bool]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for (split, categorical), go_left in tests:
        left = np.isin(x, split) if categorical else x <= split[0]
        ok &= left if go_left else ~left
    return ok


def _shapley_weights(m: int) -> np.ndarray:
    """|S|! (m - |S| - 1)! / m! for subsets of the other m - 1 features, by size."""
    out = np.empty(m)
    out[0] = 1.0 / m
    for s in range(1, m):
        out[s] = out[s - 1] * s / (m - s)
    return out


def _gains(hits: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """What each feature on a path earns, rows x features. ``hits``: whether the rows pass, ``shares``: of rows that pass."""
    m = len(shares)
    weight, out = _shapley_weights(m), np.empty((len(hits), m))
    for i, z in enumerate(shares):
        # coefficients by coalition size of prod over the others of (share + pass * t)
        poly = np.zeros((len(hits), m))
        poly[:, 0] = 1.0
        for j, zj in enumerate(shares):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * zj + poly[:, :-1] * hits[:, j][:, None]
                poly[:, 0] *= zj
        out[:, i] = (hits[:, i] - z) * (poly @ weight)
    return out


def _leaf_contributions(data: np.ndarray, leaves, n_out: int) -> np.ndarray:
    """Rows x features x outputs. A leaf is a product game over the features on its path: a feature in the
    coalition contributes whether the row passes, one outside contributes the share of rows that pass.

    Rows that pass the same features earn the same: where there are fewer such patterns than rows, each is worked out once.
    """
    phi = np.zeros((len(data), data.shape[1], n_out))
    for value, path in leaves:
        m = len(path)
        if not m or not np.any(value):
            continue
        shares = [z for _, z, _ in path]
        if 1 << m <= len(data):
            pattern = sum(_passes(data[:, f], tests).astype(np.int64) << i for i, (f, _, tests) in enumerate(path))
            gain = _gains((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float), shares)[pattern]
        else:
            gain = _gains(np.stack([_passes(data[:, f], tests) for f, _, tests in path], axis=1).astype(float), shares)
        for i, (f, _, _) in enumerate(path):
            phi[:, f, :] += gain[:, i, None] * value[None, :]
    return phi


def tree_contributions(trained: TrainedModel, df: DataFrame, key: str) -> DataFrame:
    """(key, feature, contribution, base_value): path-dependent Shapley values of the explained output.

    Forests and single trees explain the probability of the predicted class or the predicted value;
    boosting explains its raw score. base_value plus the contributions of a row equals that output.
    """
    trees = tree_nodes(trained, df.sparkSession)
    leaves = [_paths(t) for t in trees]
    n_out = trees[0]["values"].shape[1]
    base = np.zeros(n_out)
    for t, ls in zip(trees, leaves):
        root = t["cover"][0]
        for node in np.flatnonzero(t["left"] < 0):
            base += t["values"][node] * t["cover"][node] / root
    names = trained.features
    explained = trained.task == "classification" and n_out > 1

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = np.array(pdf["x"].tolist(), dtype=float)
            if not len(data):
                continue
            phi = np.zeros((len(data), data.shape[1], n_out))
            for ls in leaves:
                phi += _leaf_contributions(data, ls, n_out)
            pick = pdf["pred"].to_numpy().astype(int) if explained else np.zeros(len(data), int)
            chosen = phi[np.arange(len(data)), :, pick]
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(data),
                "contribution": chosen.ravel(), "base_value": np.repeat(base[pick], len(names)),
            })

    scored = trained.predict(df).select(col(key), vector_to_array("features").alias("x"), F.col("prediction").alias("pred"))
    kind = dict(scored.dtypes)[key]
    return scored.mapInPandas(explain, f"`{key}` {kind}, feature string, contribution double, base_value double")


# any model -----------------------------------------------------------------------------------------
def _output(trained: Any, scored: DataFrame) -> DataFrame:
    """One number to explain: the predicted value, or the score of the class the row is predicted to be."""
    if trained.task != "classification":
        return scored.withColumn("__out", F.col("prediction"))
    return scored.withColumn("__out", F.col("scores")[F.col("__cls")])


def _switched(trained: Any, df: DataFrame, key: str, background: Sequence[float], steps: list) -> DataFrame:
    """Every row once per step (a struct with a ``mask``), features outside the mask set to the background, scored as ``__out``."""
    d = len(trained.features)
    own = trained.predict(df).select(col(key), vector_to_array("features").alias("__v"), F.col("prediction").cast("int").alias("__cls"))
    base = F.array(*[F.lit(float(b)) for b in background])
    wide = own.withColumn("__s", F.explode(F.array(*steps)))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.get(F.col("__s.mask"), i), F.get(F.col("__v"), i)).otherwise(F.get(base, i)))
    return _output(trained, trained.predict(wide.withColumn("features", array_to_vector(mixed))))


def _mask(d: int, members: Sequence[int]):
    return F.array(*[F.lit(i in members) for i in range(d)]).alias("mask")


def _softmax_weights(trained: Any) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights [classes, features] and intercepts of a logistic model of several classes, whose scores follow from them."""
    model = getattr(trained, "model", None)
    if trained.task != "classification" or not hasattr(model, "coefficientMatrix") or model.numClasses < 3:
        return None
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def _softmax_sums(trained: Any, df: DataFrame, key: str, background: Sequence[float], coalitions: list, softmax: tuple) -> DataFrame:
    """(key, sums) of every row: its coalitions are scored as matrices, as many rows at a time as a batch has."""
    (weights, intercepts), base = softmax, np.array(background, dtype=float)

    def add(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(base))
            own, sums = batch.column("cls").to_numpy(), np.zeros((len(x), len(base) + 1))
            for members, shares in coalitions:
                mixed = np.tile(base, (len(x), 1))
                mixed[:, members] = x[:, members]
                margins = mixed @ weights.T + intercepts
                scores = np.exp(margins - margins.max(axis=1, keepdims=True))
                sums += np.outer(scores[np.arange(len(x)), own] / scores.sum(axis=1), shares)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (len(base) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["k", "sums"])

    rows = trained.predict(df).select(col(key).alias("k"), vector_to_array("features").alias("x"), F.col("prediction").cast("int").alias("cls"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(add, f"k {kind}, sums array<double>").select(F.col("k").alias(key), "sums")


def _enumerated(trained: Any, df: DataFrame, key: str, background: Sequence[float]) -> DataFrame:
    """(key, sums) from all coalitions, a row per key: what each feature contributes, and last the output of the background.

    A coalition's output is added to all sums of its key at once, so that only these few numbers are shuffled, not a row per
    coalition and feature.
    """
    d = len(trained.features)
    weight = _shapley_weights(d)
    coalitions = []
    for code in range(1 << d):
        members = [i for i in range(d) if code >> i & 1]
        # a coalition earns for its members and costs the others
        shares = [float(weight[len(members) - 1]) if i in members else -float(weight[len(members)]) for i in range(d)]
        coalitions.append((members, [*shares, 0.0 if members else 1.0]))
    softmax = _softmax_weights(trained)
    if softmax is not None:
        rows = _softmax_sums(trained, df, key, background, coalitions, softmax)
        return rows.groupBy(col(key)).agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(d + 1)]).alias("__sums"))
    steps = [F.struct(_mask(d, members), F.array(*[F.lit(s) for s in shares]).alias("share")) for members, shares in coalitions]
    scored = _switched(trained, df, key, background, steps)
    return scored.groupBy(col(key)).agg(F.array(*[F.sum(F.get(F.col("__s.share"), F.lit(i)) * F.col("__out")) for i in range(d + 1)]).alias("__sums"))


def _drawn(trained: Any, df: DataFrame, key: str, background: Sequence[float], orders: list[list[int]], first: int) -> DataFrame:
    """(key, f, pair, v): what each feature earns, on average, in a pair of an order and its reverse."""
    d = len(trained.features)
    steps = []
    for k, order in enumerate(orders):
        for j in range(d + 1):
            gained, lost = (order[j - 1] if j else -1), (order[j] if j < d else -1)
            steps.append(F.struct(_mask(d, order[:j]), F.lit(gained).alias("gained"), F.lit(lost).alias("lost"), F.lit(first + k // 2).alias("pair")))
    scored = _switched(trained, df, key, background, steps)
    parts = F.array(
        F.struct(F.col("__s.gained").alias("f"), F.col("__out").alias("v")),
        F.struct(F.col("__s.lost").alias("f"), (-F.col("__out")).alias("v")),
        F.struct(F.lit(d).alias("f"), F.when(F.col("__s.gained") == -1, F.col("__out")).alias("v")),
    )
    long = scored.select(col(key), F.col("__s.pair").alias("pair"), F.inline(parts)).filter((F.col("f") >= 0) & F.col("v").isNotNull())
    return long.groupBy(col(key), "f", "pair").agg((F.sum("v") / 2).alias("v"))


def sampled_contributions(trained: Any, df: DataFrame, key: str, background: Sequence[float], permutations: int | None = None, seed: int = 42, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, feature, contribution, base_value, std_error) for a model of any kind.

    Up to ``ENUMERATED`` features all coalitions are scored: exact, with an error of 0. With more, features are switched
    from the background to the row in random orders, each followed by its reverse, and each switch earns the
    change of the output. Pairs of orders are added until the standard error, as a root mean square over rows and
    features, is at most ``tolerance`` times the root mean square of what a row's contributions sum to. ``permutations``
    asks for a fixed (even) number of orders instead. Rows are expanded and scored by the model itself.
    """
    names, d = trained.features, len(trained.features)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1)
    if permutations is None and d <= ENUMERATED:
        per_key = _enumerated(trained, df, key, background)
        each = per_key.select(col(key), F.posexplode(F.slice("__sums", 1, d)).alias("f", "contribution"), F.get("__sums", F.lit(d)).alias("base_value"))
        return each.select(col(key), label.alias("feature"), "contribution", "base_value", F.lit(0.0).alias("std_error"))
    rng, total, pairs = np.random.default_rng(seed), None, 0
    while True:
        more = PAIRS if permutations is None else max(1, permutations // 2)
        orders = [o for p in (rng.permutation(d).tolist() for _ in range(more)) for o in (p, p[::-1])]
        drawn = _drawn(trained, df, key, background, orders, pairs).groupBy(col(key), "f").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
        if total is not None:
            drawn = total.unionByName(drawn).groupBy(col(key), "f").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
        total, pairs = materialise(drawn, "orders"), pairs + more
        n = F.lit(float(pairs))
        spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0)) / (n * F.greatest(n - 1, F.lit(1.0)))
        sums = total.select(col(key), "f", (F.col("s") / n).alias("contribution"), F.sqrt(spread).alias("std_error"))
        if permutations is not None:
            break
        per_row = sums.filter(F.col("f") < d).groupBy(col(key)).agg(F.sum("contribution").alias("c"), F.avg(F.col("std_error") ** 2).alias("e"))
        seen = per_row.agg(F.avg(F.col("c") ** 2).alias("c"), F.avg("e").alias("e")).first()
        if seen["e"] is None or seen["e"] <= tolerance**2 * seen["c"] or seen["e"] < 1e-24:
            break
    with_base = sums.withColumn("base_value", F.max(F.when(F.col("f") == d, F.col("contribution"))).over(W.partitionBy(col(key))))
    return with_base.filter(F.col("f") < d).select(col(key), label.alias("feature"), "contribution", "base_value", "std_error")


def vector_means(df: DataFrame) -> list[float]:
    from pyspark.ml.stat import Summarizer  # noqa: PLC0415
    return df.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()


def contributions(trained: Any, df: DataFrame, key: str, background: Sequence[float] | None = None) -> DataFrame:
    """(key, feature, contribution, base_value, std_error): tree models by their paths and linear ones by their weights, both
    exact; everything else by coalitions or orders."""
    model = getattr(trained, "model", None)
    if model is not None and any(t in type(model).__name__ for t in ("DecisionTree", "RandomForest", "GBT")):
        return tree_contributions(trained, df, key).withColumn("std_error", F.lit(0.0))
    means = list(background) if background is not None else vector_means(df)
    if model is not None and getattr(trained, "n_classes", 0) <= 2 and hasattr(model, "coefficients"):
        values = vector_to_array("features")
        wide = df.select(col(key), *[values[i].alias(f) for i, f in enumerate(trained.features)])
        weights = dict(zip(trained.features, model.coefficients.toArray()))
        base = float(model.intercept) + float(np.dot(model.coefficients.toArray(), means))
        return linear_contributions(wide, key, weights, dict(zip(trained.features, means))).withColumns({"base_value": F.lit(base), "std_error": F.lit(0.0)})
    return sampled_contributions(trained, df, key, means)


# partial dependence --------------------------------------------------------------------------------
def grid_of(df: DataFrame, feature: str, size: int = GRID) -> list[float]:
    row = df.agg(F.min(col(feature).cast("double")).alias("a"), F.max(col(feature).cast("double")).alias("b")).first()
    return [float(v) for v in np.linspace(row["a"], row["b"], size)]


def on_grid(df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """Every row once per grid value with the feature set to it; the fixed grid is exploded, nothing is joined."""
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(grid)])
    wide = df.withColumn("__g", F.explode(points))
    return wide.withColumn("grid_id", F.col("__g.i")).withColumn(feature, F.col("__g.v")).drop("__g")


def partial_dependence(trained: Any, df: DataFrame, feature: str, size: int = GRID) -> DataFrame:
    """(grid_id, value, mean prediction) over all rows of (features vector)."""
    at = trained.features.index(feature)
    flat = df.select(vector_to_array("features").alias("__v"))
    grid = grid_of(flat.select(F.col("__v")[at].alias("x")), "x", size)
    wide = on_grid(flat, "__x", grid)
    replaced = F.transform("__v", lambda v, i: F.when(i == at, F.col("__x")).otherwise(v))
    scored = trained.predict(wide.select("grid_id", F.col("__x").alias("value"), array_to_vector(replaced).alias("features")))
    return scored.groupBy("grid_id", "value").agg(F.avg("prediction").alias("prediction"))


# what-if -------------------------------------------------------------------------------------------
def scenario_rows(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Scenarios as given by users: values that are absent or no numbers count as 0."""
    have = set(df.columns)
    values = [
        F.coalesce(col(f).cast("string").try_cast("double"), F.lit(0.0)).alias(f) if f in have else F.lit(0.0).alias(f) for f in features
    ]
    return df.select(*[col(c) for c in keep], *values)


def what_if(trained: Any, scenarios: DataFrame, key: str, background: Sequence[float]) -> DataFrame:
    """Prediction, class scores and the strongest contributions of each scenario, as one row per scenario."""
    from .models import assemble  # noqa: PLC0415

    rows = assemble(scenario_rows(scenarios, trained.features, [key]), trained.features, [key])
    scored = trained.predict(rows).select(col(key), "prediction", F.transform("scores", lambda s: F.round(s, 4)).alias("probabilities"))
    top = top_contributions(contributions(trained, rows, key, background), key)
    packed = top.groupBy(col(key)).agg(
        F.max("base_value").alias("base_value"),
        F.sort_array(F.collect_list(F.struct("rank", "feature", "contribution", "direction"))).alias("contributions"))
    return scored.join(packed, key)
