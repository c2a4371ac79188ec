"""Trees of tables with many rows and few bins.

To a tree that cuts each feature into bins, rows whose features fall into the same bins are one. Where there can be far fewer such
cells than rows, one pass counts them, and the trees are grown over cells with weights. A cell is kept as points: one for each
class with the number of its rows, or two values with the number, mean and variance of its labels, which is all that a split asks
for. A bootstrap sample has a Poisson number of a point's rows, so the counts of a class are as if its rows were drawn one by one, and
the sums of labels have the same mean and variance.

Bins are cut at all values of a feature that has at most as many as bins, else at quantiles of all rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import materialise, new_path
from . import grower

FEWER = 4  # rows for each cell there can be, at least
LEAST = 500_000  # rows of a table that is worth the passes that count its cells
BLOCK = 8192  # points of a block
DENSE = 1 << 22  # numbers of sums that a task holds for all cells at once
ROWS = 1 << 20  # that a task sums at a time
LABEL = "label"


# bins ----------------------------------------------------------------------------------------------
def edges_of(df: DataFrame, dims: int, bins: int, limit: float) -> list[np.ndarray] | None:
    """The cuts of each feature of ``df`` (features), or None if they make more than ``limit`` cells."""
    if 2**dims > limit:
        return None
    x = vector_to_array("features")
    flat = df.select(*[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(dims)])
    at = [i / bins for i in range(1, bins)]
    found = flat.agg(*[F.approx_count_distinct(f"x{i}") for i in range(dims)], *[F.percentile_approx(f"x{i}", at, 10_000) for i in range(dims)]).first()
    edges = [np.unique(np.array(q, dtype=np.float64)) for q in found[dims:]]
    few = [i for i in range(dims) if found[i] <= 2 * bins]  # about that many values, so they can be collected
    if few:
        for i, values in zip(few, flat.agg(*[F.sort_array(F.collect_set(f"x{i}")) for i in few]).first()):
            if len(values) <= bins:
                edges[i] = (np.array(values[:-1]) + np.array(values[1:])) / 2
    return edges if cells_of(edges) <= limit else None


def cells_of(edges: Sequence[np.ndarray]) -> int:
    return math.prod(len(e) + 1 for e in edges)


# cells ---------------------------------------------------------------------------------------------
def points(df: DataFrame, edges: dict[str, list[np.ndarray]], classes: int) -> DataFrame:
    """A written table of blocks of points: (rows, fold, block, label, weight, bins), the last three as plain numbers.

    ``df``: rows (name of the set, a key of ``edges``), fold, label and a ``features`` vector. ``classes`` 0: regression. A block's
    number and its order do not depend on how ``df`` is dealt to tasks.
    """
    kinds = classes or 1
    middle = 0.0 if classes else float(df.agg(F.avg(LABEL)).first()[0] or 0.0)  # sums of squares lose nothing far from 0
    places = {name: np.cumprod([1, *[len(e) + 1 for e in own[:-1]]]).astype(np.int64) for name, own in edges.items()}
    sizes = {name: cells_of(own) * kinds for name, own in edges.items()}
    width = 1 if classes else 3

    def add(batches):
        total: dict[tuple[str, int], Any] = {}
        held: dict[tuple[str, int], list] = {}
        waiting = 0

        def close():
            for at, parts in held.items():
                code, values = (np.concatenate(p) for p in zip(*parts))
                if sizes[at[0]] * width <= DENSE:
                    now = np.stack([np.bincount(code, values[:, j], sizes[at[0]]) for j in range(width)], axis=1)
                    total[at] = total[at] + now if at in total else now
                else:
                    if at in total:
                        code, values = np.append(total[at][0], code), np.concatenate([total[at][1], values])
                    code, place = np.unique(code, return_inverse=True)
                    total[at] = code, np.stack([np.bincount(place, values[:, j]) for j in range(width)], axis=1)
            held.clear()

        for batch in batches:
            for name, own in grower._sets(batch):
                if own.column("label").null_count:
                    raise ValueError("a row without a label cannot be learned from")
                x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                fold, y = own.column("fold").to_numpy(), own.column("label").to_numpy() - middle
                code = sum(np.searchsorted(e, x[:, i], "left") * p for i, (e, p) in enumerate(zip(edges[name], places[name])))
                if classes:
                    code, values = code * kinds + y.astype(np.int64), np.ones((len(y), 1))
                else:
                    values = np.stack([np.ones(len(y)), y, y * y], axis=1)
                for f in np.unique(fold).tolist():
                    some = fold == f
                    held.setdefault((name, f), []).append((code[some], values[some]))
                waiting += own.num_rows
            if waiting > ROWS:
                close()
                waiting = 0
        close()
        for (name, f), found in total.items():
            code, sums = found if isinstance(found, tuple) else (np.flatnonzero(found[:, 0]), found[found[:, 0] > 0])
            for lo in range(0, len(code), 1 << 16):
                part, s = code[lo : lo + (1 << 16)], sums[lo : lo + (1 << 16)]
                s = s if width == 3 else np.column_stack([s, np.zeros((len(s), 2))])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([f] * len(part), pa.int32()), pa.array(part), *map(pa.array, s.T)], ["rows", "fold", "code", "n", "s", "q"])

    def pack(batches):
        first, block, rest = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            whole = batch.to_pandas() if rest is None else pd.concat([rest, batch.to_pandas()], ignore_index=True)
            runs = (whole["rows"].ne(whole["rows"].shift()) | whole["fold"].ne(whole["fold"].shift())).cumsum()
            pieces = [p.iloc[lo : lo + BLOCK] for _, p in whole.groupby(runs) for lo in range(0, len(p), BLOCK)]
            rest = pieces.pop() if pieces else None  # it may go on in the next batch
            for p in pieces:
                yield packed(p, first + block)
                block += 1
        if rest is not None:
            yield packed(rest, first + block)

    def packed(p, block):
        name, n = p["rows"].iloc[0], p["n"].to_numpy()
        code, label = p["code"].to_numpy(), None
        cell = code // kinds
        bins = np.stack([cell // place % (len(e) + 1) for place, e in zip(places[name], edges[name])], axis=1).astype(np.uint8)
        if classes:
            label = (code % kinds).astype(np.float64)
        else:
            mean = p["s"].to_numpy() / n
            spread = np.where(n > 1, np.sqrt(np.maximum(p["q"].to_numpy() / n - mean * mean, 0.0)), 0.0)
            two = spread > 0
            label = middle + np.concatenate([mean + spread, (mean - spread)[two]])
            n = np.concatenate([np.where(two, n / 2, n), n[two] / 2])
            bins = np.concatenate([bins, bins[two]])
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([p["fold"].iloc[0]], pa.int32()), pa.array([block]), *[pa.array([v.tobytes()], pa.binary()) for v in (label, n, bins)]],
                                          ["rows", "fold", "block", "label", "weight", "bins"])

    flat = df.select("rows", "fold", F.col(LABEL).cast("double").alias("label"), vector_to_array("features").alias("x"))
    parts = max(flat.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes.values()) // (16 * BLOCK)))
    sums = flat.mapInArrow(add, "rows string, fold int, code bigint, n double, s double, q double").repartition(parts, "rows", "fold", "code")
    cells = sums.groupBy("rows", "fold", "code").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).sortWithinPartitions("rows", "fold", "code")
    return materialise(cells.mapInArrow(pack, "rows string, fold int, block bigint, label binary, weight binary, bins binary"), "points")


def folded_points(df: DataFrame, dims: int, classes: int, folds: int) -> DataFrame | None:
    """The points of (fold, label, features) with the edges of ``grower.bin_rows``; None if there may be too many cells."""
    if 2**dims * folds * (classes or 2) * FEWER > (n := df.count()) or n < LEAST:
        return None
    edges = grower.quantile_edges(df.select(F.lit("").alias("rows"), "features"), {"": dims})
    if cells_of(edges[""]) * folds * (classes or 2) * FEWER > n:
        return None
    return points(df.select(F.lit("").alias("rows"), "fold", "label", "features"), edges, classes)


# models --------------------------------------------------------------------------------------------
def fit(estimator: Any, name: str, df: DataFrame, dims: int, task: str, params: dict[str, Any], n_rows: int, n_classes: int, depths: tuple[int, int]) -> Any:
    """What ``estimator``, MLlib's tree, forest or boosted trees, learns from ``df``; None if there may be too many cells."""
    classes = n_classes if task == "classification" else 0
    bins = int(params.get("max_bins", grower.BINS))
    least = max(int(params.get("min_samples_leaf", 1)), -(-int(params.get("min_samples_split", 2)) // 2))
    forest = name == "random_forest"
    if float(params.get("subsample", 1.0)) < 1 or bins > (grower.BINS if forest else 256) or least * 2 >= n_rows or n_rows < LEAST:
        return None
    edges = edges_of(df, dims, bins, n_rows / FEWER / (classes or 2))
    if edges is None:
        return None
    table = points(df.select(F.lit("").alias("rows"), F.lit(0).alias("fold"), "label", "features"), {"": edges}, classes)
    if forest:
        model = grower.forest_model(name, params, task, "", -1, *depths)
        grower.grow(table, {"": dims}, [model], classes)
        return _forest(estimator, df.sparkSession, model, dims, classes, edges)

    def unpack(batches):
        for batch in batches:
            for _, _, _, label, own, weight in grower._by_part(batch):
                offsets = pa.array(np.arange(len(label) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(own.astype(np.float64).ravel())), pa.array(label), pa.array(weight)], ["x", "label", "weight"])

    rows = table.mapInArrow(unpack, "x array<double>, label double, weight double").select(array_to_vector("x").alias("features"), "label", "weight").persist()
    try:
        # so many bins that MLlib looks at all points to find the bins, which are the numbers 0, 1, 2 ...
        each = {"maxBins": max(bins, math.isqrt(rows.count()) + 1), "minInstancesPerNode": 1, "minWeightFractionPerNode": (least - 0.5) / n_rows if least > 1 else 0.0}
        inner = estimator.getClassifier() if estimator.hasParam("classifier") else estimator
        weighted = inner.copy({inner.getParam(k): v for k, v in each.items()})
        weighted.setWeightCol("weight")
        if inner is estimator:
            return _moved(weighted.fit(rows), df.sparkSession, edges, inner)
        many = estimator.copy({estimator.getParam("classifier"): weighted, estimator.getParam("weightCol"): "weight"}).fit(rows)
        return estimator._copyValues(OneVsRestModel(models=[_moved(m, df.sparkSession, edges, inner) for m in many.models]))
    finally:
        rows.unpersist()


def _saved_again(model: Any, spark, data, estimator: Any) -> Any:
    """``model`` with its nodes replaced by ``data(nodes)``, by way of its saved form, and the settings of ``estimator``."""
    path = new_path(spark, "trees")
    model.write().save(f"{path}/before")
    about = json.loads(spark.read.text(f"{path}/before/metadata").first()[0])
    for p in ("maxBins", "minInstancesPerNode", "minWeightFractionPerNode"):
        about["paramMap"][p] = estimator.getOrDefault(p)
    about["paramMap"].pop("weightCol", None)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/after/metadata")
    nodes = spark.read.parquet(f"{path}/before/data")
    data(nodes).write.parquet(f"{path}/after/data")
    if "treeID" in nodes.columns:
        spark.read.parquet(f"{path}/before/treesMetadata").write.parquet(f"{path}/after/treesMetadata")
    return type(model).load(f"{path}/after")


def _moved(model: Any, spark, edges: list[np.ndarray], estimator: Any) -> Any:
    """Trees over numbers of bins as trees over values."""
    cuts = F.array(*[F.array(*[F.lit(float(v)) for v in e]).cast("array<double>") for e in edges])

    def data(nodes: DataFrame) -> DataFrame:
        split = "nodeData.split" if "treeID" in nodes.columns else "split"
        at = F.floor(F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0))).cast("int")
        own = F.when(F.col(f"{split}.featureIndex") >= 0, F.array(F.get(F.get(cuts, F.col(f"{split}.featureIndex")), at))).otherwise(F.col(f"{split}.leftCategoriesOrThreshold"))
        if "treeID" in nodes.columns:
            return nodes.withColumn("nodeData", F.col("nodeData").withField("split.leftCategoriesOrThreshold", own))
        return nodes.withColumn("split", F.col("split").withField("leftCategoriesOrThreshold", own))

    return _saved_again(model, spark, data, estimator)


def _forest(estimator: Any, spark, model: grower.Model, dims: int, classes: int, edges: list[np.ndarray]) -> Any:
    """Grown trees as MLlib's forest."""
    rows = [(float(c), Vectors.dense([0.0] * dims)) for c in range(classes or 1)]
    empty = estimator.fit(spark.createDataFrame(rows, ["label", "features"]))
    nodes = [(t, *n) for t, tree in enumerate(model.grown) for n in _nodes(tree, classes, edges)]
    return _saved_again(empty, spark, lambda old: spark.createDataFrame([(n[0], n[1:]) for n in nodes], old.schema), estimator)


def _nodes(tree: grower.Tree, classes: int, edges: list[np.ndarray]) -> list[tuple]:
    """MLlib's rows of a tree. Two leaves that predict the same become one, as MLlib does it."""
    size = len(tree.feature)
    value = [np.array(v if v is not None else [0.0] * (classes or 3)) for v in tree.value]
    weight = [float(v.sum() if classes else v[0]) for v in value]
    spread = [float(grower._spread(v, classes)) for v in value]
    said = [float(v.argmax()) if classes else float(v[1] / max(v[0], 1e-300)) for v in value]
    leaf = [f < 0 for f in tree.feature]
    for i in range(size - 1, -1, -1):  # children have higher numbers
        if not leaf[i]:
            a, b = tree.left[i], tree.right[i]
            leaf[i] = leaf[a] and leaf[b] and said[a] == said[b]
    number, order = {}, [0]
    for i in order:
        number[i] = len(number)
        if not leaf[i]:
            order += [tree.left[i], tree.right[i]]
    out = []
    for i in order:
        n = max(weight[i], 1e-300)
        own = (number[i], said[i], spread[i] / n, value[i].tolist(), int(weight[i]))
        if leaf[i]:
            out.append((*own, -1.0, -1, -1, (-1, [], -1)))
        else:
            a, b = tree.left[i], tree.right[i]
            out.append((*own, (spread[i] - spread[a] - spread[b]) / n, number[a], number[b], (tree.feature[i], [float(edges[tree.feature[i]][tree.cut[i]])], -1)))
    return out
