"""Density clustering over cells of points, and the closeness measure used to judge any clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.ordering import row_index
from ..functions.staging import materialise
from .neighbors import CHUNK_ROWS, Points, _matrix, distinct_points, radius_blocks, radius_cells, vector_of, within_counts

NOISE = -1


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node name of each component, from undirected (a, b) edges.

    Every round takes the smallest label around a node and then follows labels one step further; each
    round is written, so lineage stays short and a lost executor does not restart the loop.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("t_label"))
        jumped = stepped.join(target, F.col("low") == F.col("t"), "left")
        new = materialise(jumped.select("node", F.col("label").alias("old"), F.least("low", F.coalesce("t_label", "low")).alias("label")), "labels")
        changed = not new.filter(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's tree over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the smallest node of each node's tree, after the edges (a, b); edges inside a tree cost nothing more."""
    a, b = root[a], root[b]
    apart = a != b
    if not apart.any():
        return root
    ends, at = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
    n = len(at) // 2
    new = np.arange(len(root))
    new[ends] = ends[_roots(len(ends), at[:n], at[n:])]
    return new[root]


def _load_core(points: pa.Table):
    return Points(_matrix(points.column("vec"))), points.column("fine").to_numpy()


def _core_links(eps: float) -> Callable:
    """Which fine cells of core points hang together inside a block, as a forest: each cell but the roots with the root of its tree.

    A border query gets one row per tree that reaches it. So a batch of queries returns at most one row per cell or border
    point and tree, however dense its surroundings are.
    """
    def link(ready, queries: pa.RecordBatch):
        points, fine = ready
        q, m = _matrix(queries.column("vec")), queries.num_rows
        qid, core = queries.column("qid").to_numpy(), queries.column("core").to_numpy(zero_copy_only=False).astype(bool)
        names, code = np.unique(np.concatenate([queries.column("fine").to_numpy(), fine]), return_inverse=True)
        own, other = code[:m], code[m:]
        root = np.arange(len(names))
        touched: list[tuple[np.ndarray, np.ndarray]] = []
        for s in points.strips(m):
            r, c = np.nonzero(points.within(q[s], eps))
            r, c = r + s.start, other[c]
            linked = core[r]
            root = _joined(root, own[r[linked]], c[linked])
            pairs = np.unique(r[~linked] * len(names) + c[~linked])  # each border query with the fine cells around it
            touched.append((pairs // len(names), pairs % len(names)))
        # a cell takes part if it holds core points: those of core queries, and all of the points
        cells = np.unique(np.concatenate([own[core], other]))
        cells = cells[root[cells] != cells]
        yield _link_rows(np.zeros(len(cells), np.int64), names[cells], names[root[cells]], True)
        r, c = (np.concatenate(x) for x in zip(*touched))
        pairs = np.unique(r * len(names) + root[c])
        r, c = pairs // len(names), pairs % len(names)
        yield _link_rows(qid[r], names[own[r]], names[c], False)
    return link


def _link_rows(qid: np.ndarray, fine: np.ndarray, near: np.ndarray, core: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(fine, pa.int64()), pa.array(near, pa.int64()), pa.array(np.full(len(qid), core))], ["qid", "fine", "near", "core"])


def _density(points: DataFrame, dims: int, eps: float, min_samples: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``points`` (id, vec, weight) marked with ``core``, and (id, cluster) of all that belong to a cluster.

    Points of one fine cell (side eps / sqrt(d)) are all within eps of each other, so core points are
    connected cell by cell. A border point joins the lowest-numbered cluster that reaches it.
    """
    celled, cells = radius_cells(points, dims, chunk)
    counts = within_counts(celled, cells, eps, chunk)
    side = eps / math.sqrt(dims)
    place = F.concat_ws("|", F.transform("vec", lambda x: F.floor(x / F.lit(side)).cast("string")))
    placed = materialise(
        celled.join(counts, F.col("id") == F.col("qid")).select("id", "vec", "cell", place.alias("place"), (F.col("n") >= min_samples).alias("core")), "placed")
    # the written numbers of the fine cells stay what they are
    numbers = materialise(placed.select("place").distinct().withColumn("fine", F.monotonically_increasing_id()), "fine")
    marked = materialise(placed.join(numbers, "place").select("id", "vec", "cell", "fine", "core"), "marked")
    core = marked.filter("core").select("id", "vec", "cell", "fine")
    queries = marked.select(F.col("id").alias("qid"), "vec", "fine", "core")
    links = materialise(radius_blocks(core, cells, eps, _load_core, _core_links(eps), "qid long, fine long, near long, core boolean", queries, chunk), "links")
    alone = core.select(F.col("fine").alias("a"), F.col("fine").alias("b"))  # a cell may be linked with itself only
    edges = links.filter("core").select(F.col("fine").alias("a"), F.col("near").alias("b")).unionByName(alone)
    components = connected_components(edges)
    # clusters are numbered by their smallest core key
    owner = core.join(components, core["fine"] == components["node"]).groupBy("component").agg(F.min("id").alias("first"))
    named = materialise(components.join(owner, "component").select("node", "first"), "named")
    core_label = core.join(named, core["fine"] == named["node"]).select("id", "first")
    border = links.filter(~F.col("core")).join(named, F.col("near") == F.col("node")).groupBy(F.col("qid").alias("id")).agg(F.min("first").alias("first"))
    firsts = materialise(core_label.unionByName(border), "firsts")
    code = row_index(owner.select("first"), ["first"], name="cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return marked, firsts.join(code, "first").select("id", "cluster")


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(key, cluster): clusters are numbered by their smallest core key, noise is -1."""
    features = list(features)
    points = materialise(distinct_points(df, key, features), "distinct")
    marked, labelled = _density(points, len(features), eps, min_samples, chunk)
    per_vec = marked.join(labelled, "id", "left").select("vec", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    rows = df.na.drop(subset=features).select(col(key), vector_of(features).alias("vec"))
    return rows.join(per_vec, "vec").select(col(key), "cluster")


class DbscanModel:
    """The core points of a fitted table with their clusters.

    A row belongs to the lowest-numbered cluster with a core point within ``eps`` of it, and is noise (-1) without one. For
    the rows of the fit these are the clusters of ``dbscan``.
    """

    def __init__(self, cores: DataFrame, dims: int, eps: float, chunk: int = CHUNK_ROWS) -> None:
        self.eps, self.chunk, self.dims, self.cores = eps, chunk, dims, cores

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with an integer ``prediction``."""
        rows = df.withColumn("__vec", vector_to_array(features))
        kinds = rows.select("__vec").distinct().withColumn("qid", F.monotonically_increasing_id())
        kinds = materialise(kinds.withColumnRenamed("__vec", "vec"), "asked")
        if self.cores.isEmpty():
            return df.withColumn("prediction", F.lit(NOISE))
        celled, cells = radius_cells(self.cores, self.dims, self.chunk)
        near = radius_blocks(celled, cells, self.eps, _load_clusters, _lowest_cluster(self.eps), "qid long, cluster int", kinds.select("qid", "vec"), self.chunk)
        found = near.groupBy("qid").agg(F.min("cluster").alias("prediction"))
        named = kinds.join(found, "qid", "left").select(F.col("vec").alias("__v"), F.coalesce("prediction", F.lit(NOISE)).alias("prediction"))
        return rows.join(named, F.col("__vec") == F.col("__v")).drop("__vec", "__v")


def _load_clusters(points: pa.Table):
    return Points(_matrix(points.column("vec"))), points.column("cluster").to_numpy()


def _lowest_cluster(eps: float) -> Callable:
    def lowest(ready, queries: pa.RecordBatch):
        points, cluster = ready
        q, none = _matrix(queries.column("vec")), np.iinfo(np.int32).max
        best = np.full(len(q), none)
        for s in points.strips(len(q)):
            r, c = np.nonzero(points.within(q[s], eps))
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            if len(r):
                best[s.start + r[starts]] = np.minimum.reduceat(cluster[c], starts)
        some = np.flatnonzero(best < none)
        yield pa.RecordBatch.from_arrays([queries.column("qid").take(pa.array(some)), pa.array(best[some].astype(np.int32))], ["qid", "cluster"])
    return lowest


def fit_dbscan(df: DataFrame, dims: int, eps: float = 0.5, min_samples: int = 5, chunk: int = CHUNK_ROWS) -> DbscanModel:
    """Fit on a table with a ``features`` vector. Clusters are numbered in the order of their least core point."""
    rows = df.select(vector_to_array("features").alias("vec"))
    merged = rows.groupBy("vec").agg(F.count("*").alias("weight"))
    points = row_index(merged, ["vec"], name="id").select("id", "vec", "weight")
    marked, labelled = _density(materialise(points, "distinct"), dims, eps, min_samples, chunk)
    cores = materialise(marked.filter("core").join(labelled, "id").select("id", "vec", "cluster"), "cores")
    return DbscanModel(cores, dims, eps, chunk)


# agglomerative -------------------------------------------------------------------------------------
def ward_merges(centres: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges (a, b, rise of the sum of squares) of weighted points, by chains of nearest neighbours; b joins a.

    A chain goes from a cluster to its nearest one until two are each other's nearest; those merge. The merges are those
    of always taking the closest pair, in another order; sorted by their rise they are the tree.
    """
    n = len(centres)
    x, w = centres.astype(float).copy(), weight.astype(float).copy()
    alive = np.ones(n, bool)
    merges, chain = [], []

    def rises(i: int) -> np.ndarray:
        d = np.square(x - x[i]).sum(axis=1) * (w * w[i] / (w + w[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        d = rises(chain[-1])
        near = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[near]:
            a, b = sorted((chain.pop(), chain.pop()))
            merges.append((a, b, float(min(d[a], d[b]))))
            x[a] = (w[a] * x[a] + w[b] * x[b]) / (w[a] + w[b])
            w[a] += w[b]
            alive[b] = False
        else:
            chain.append(near)
    return merges


def cut_merges(n: int, merges: list[tuple[int, int, float]], clusters: int) -> np.ndarray:
    """Cluster numbers after all but the last ``clusters`` - 1 merges, in the order of each cluster's first point."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in sorted(merges, key=lambda m: m[2])[: max(0, n - clusters)]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


class WardModel:
    """Clusters of micro-clusters: a row belongs where its nearest centre does."""

    def __init__(self, centres: np.ndarray, labels: np.ndarray) -> None:
        self.centres, self.labels = centres, labels

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        centres, labels = self.centres, self.labels
        square = np.square(centres).sum(axis=1)

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=np.int32)
            rows = np.stack(x.to_numpy())
            step = max(1, (1 << 22) // len(centres))
            found = [labels[(square - 2 * rows[lo : lo + step] @ centres.T).argmin(axis=1)] for lo in range(0, len(rows), step)]
            return pd.Series(np.concatenate(found).astype(np.int32))

        return df.withColumn("prediction", nearest(vector_to_array(features)))


MICRO = 2000  # micro-clusters that Ward's method works on


def fit_ward(df: DataFrame, dims: int, clusters: int = 3, most: int = MICRO, seed: int = 42) -> WardModel:
    """Agglomerative clustering with Ward's linkage.

    Up to ``most`` distinct points are merged as they are. More are first summed up in ``most`` micro-clusters (number of
    rows and mean, by k-means over distinct points); their merges are then exact. ``clusters`` beyond the number of
    points gives each point its own.
    """
    merged = df.select(vector_to_array("features").alias("vec")).groupBy("vec").agg(F.count("*").alias("weight"))
    merged = materialise(merged, "distinct")
    if merged.limit(most + 1).count() > most:
        rows = merged.withColumn("features", array_to_vector("vec"))
        near = KMeans(k=most, maxIter=5, seed=seed, weightCol="weight").fit(rows).transform(rows)
        w = F.col("weight")
        means = [(F.sum(w * F.get("vec", F.lit(j))) / F.sum(w)).alias(f"m{j}") for j in range(dims)]
        found = near.groupBy("prediction").agg(F.sum("weight").alias("weight"), *means).select("weight", F.array(*[f"m{j}" for j in range(dims)]).alias("vec"))
    else:
        found = merged
    held = sorted((tuple(r.vec), r.weight) for r in found.collect())  # at most ``most`` rows
    centres = np.array([v for v, _ in held], dtype=float).reshape(len(held), dims)
    weight = np.array([w for _, w in held], dtype=float)
    return WardModel(centres, cut_merges(len(held), ward_merges(centres, weight), clusters))


def silhouette(predictions: DataFrame, features: str = "features", prediction: str = "prediction") -> float | None:
    """None when there is only one cluster to judge."""
    if predictions.select(prediction).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(predictions)
