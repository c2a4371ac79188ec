"""Many trees at once: forests of all folds and all candidates grow together from shared histograms.

MLlib grows one model per chain of jobs, so five folds of five strategies wait for twenty-five chains. Here the rows are
binned once and written; then every pass over that table adds up, for all open nodes of all trees of all models, how the
labels are spread over the bins of each feature. Sums are made per task first and then, a tree's part at a time, by the task
that also picks its best splits; the driver only sees splits. A pass takes as many trees as fit the memory of a task,
so the number of passes follows from the depth and the size of the histograms, not from the number of models. One more
pass scores all models on the rows they have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import materialise
from . import metrics

BINS = 32  # of a feature, at most
HISTOGRAM = 16 << 20  # numbers in the histograms of a pass
PIECE = 1 << 17  # numbers of one tree's histogram that are summed together
GROWABLE = ("decision_tree", "random_forest")
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098,
                      0.0030656620097620196, 0.0005109436682936699, 7.299195261338141e-05])  # P(at most k draws), mean 1


@dataclass
class Model:
    """One model to grow: it learns from the rows of ``rows`` whose fold is not ``held`` and is scored on the others."""

    rows: str
    held: int
    trees: int
    depth: int
    least: int = 1  # rows in a leaf
    share: str = "all"  # features tried per node: all, sqrt or third
    bootstrap: bool = False
    seed: int = 42
    grown: list[Tree] = field(default_factory=list)

    @property
    def family(self) -> tuple:
        """Models of a family have the same trees, of which one takes more than another, or more of their levels."""
        return self.rows, self.held, self.least, self.share, self.bootstrap, self.seed


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. ``value``: class counts, or (n, sum, sum of squares)."""

    model: int
    seed: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    level: list[int] = field(default_factory=lambda: [0])
    value: list[list[float] | None] = field(default_factory=lambda: [None])
    open: list[int] = field(default_factory=lambda: [0])
    deepest: int = 0  # levels it may get

    def splittable(self, node: int, least: int, classes: int) -> bool:
        """Whether a new node is asked for splits, if the tree may get deeper."""
        value = self.value[node]
        n = sum(value) if classes else value[0]
        return n >= 2 * least and bool(_spread(np.array(value), classes) > 1e-9)

    def deepen(self, depth: int, least: int, classes: int) -> None:
        """Let a tree grow on to ``depth``: the nodes of its last level are open again."""
        if depth > self.deepest:
            if not self.open:  # grown before
                self.open = [i for i, level in enumerate(self.level) if level == self.deepest and self.splittable(i, least, classes)]
            self.deepest = depth

    def upto(self, depth: int) -> Tree:
        """The tree as it was at ``depth``: nodes are numbered level by level, so it is the first of them."""
        n = sum(level <= depth for level in self.level)
        feature, cut, left, right = ([at_leaf if level == depth else v for v, level in zip(x[:n], self.level)]
                                     for x, at_leaf in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0)))
        return Tree(self.model, self.seed, feature, cut, left, right, self.level[:n], self.value[:n], [], depth)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, dtype=np.int32) for x in (self.feature, self.cut, self.left, self.right))


def forest_model(name: str, params: dict, task: str, rows: str, held: int, forest_depth: int, tree_depth: int) -> Model:
    """The registry's decision tree or random forest with its familiar parameters."""
    forest = name == "random_forest"
    least = max(int(params.get("min_samples_leaf", 1)), -(-int(params.get("min_samples_split", 2)) // 2))
    depth = int(params.get("max_depth") or (forest_depth if forest else tree_depth))
    if depth > 30:
        raise ValueError("trees deeper than 30 levels are not supported")
    share = ("sqrt" if task == "classification" else "third") if forest else "all"
    return Model(rows, held, int(params.get("n_estimators", 100)) if forest else 1, depth, least, share, forest, int(params.get("random_state", 42)))


def tried(features: int, share: str, seed: int, node: int) -> np.ndarray:
    """The features a node may split on."""
    n = {"all": features, "sqrt": int(np.ceil(np.sqrt(features))), "third": -(-features // 3)}[share]
    return np.arange(features) if n >= features else np.sort(np.random.default_rng((seed, node)).choice(features, n, replace=False))


def draws(row: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: Poisson numbers that depend on row and tree alone."""
    x = row.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, "right")


# binning -------------------------------------------------------------------------------------------
def bin_rows(df: DataFrame, widths: dict[str, int], key: str) -> tuple[DataFrame, dict[str, list[np.ndarray]]]:
    """(rows, fold, row, label, bins) as a written table, and the edges of each feature by set of rows.

    ``df``: rows (name of the set), fold, the key, label and a ``features`` vector. A bin holds the values above one edge
    up to the next; edges are quantiles over all rows of the set, found in one aggregate for all features and sets.
    """
    flat = df.select("rows", "fold", F.xxhash64(F.col(key)).alias("row"), "label", vector_to_array("features").alias("x"))
    edges = quantile_edges(df, widths)

    def cut(batches):
        for batch in batches:
            for name, own in _sets(batch):
                x = own.column("x").flatten().to_numpy().reshape(own.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges[name])], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rows", "fold", "row", "label")), _packed(bins)],
                                                 ["rows", "fold", "row", "label", "bins"])

    return materialise(flat.mapInArrow(cut, "rows string, fold int, row bigint, label double, bins binary"), "binned"), edges


def quantile_edges(df: DataFrame, widths: dict[str, int]) -> dict[str, list[np.ndarray]]:
    """The edges of each feature by set of rows."""
    at = [i / BINS for i in range(1, BINS)]
    long = df.select("rows", F.posexplode(vector_to_array("features")).alias("i", "v"))
    edges = {name: [np.zeros(0)] * width for name, width in widths.items()}
    for r in long.groupBy("rows", "i").agg(F.percentile_approx("v", at, 10_000).alias("q")).collect():  # a row per set and feature
        edges[r["rows"]][r["i"]] = np.unique(np.array(r["q"], dtype=np.float64))
    return edges


def _sets(batch: pa.RecordBatch):
    """(set, its rows) of a batch; mostly there is one."""
    coded = batch.column("rows").dictionary_encode()
    names = coded.dictionary.to_pylist()
    if len(names) == 1:
        yield names[0], batch
        return
    for i, name in enumerate(names):
        yield name, batch.filter(pc.equal(coded.indices, i))


def _packed(bins: np.ndarray) -> pa.Array:
    """A row's bins as one binary value each, without a Python object per row."""
    n, width = bins.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The matrix that ``_packed`` was given; ``column`` may be a part of a longer array."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _by_set(batch: pa.RecordBatch):
    """(set, fold, row, label, bins matrix) of the rows of each set in a batch."""
    for name, own in _sets(batch):
        yield name, *(own.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "row", "label")), _unpacked(own.column("bins"))


def _by_part(batch: pa.RecordBatch):
    """As ``_by_set``, and the weights. Of a table of points: of each block, whose number takes the place of the rows' own; rows
    that stand for themselves have no weights."""
    if "weight" not in batch.schema.names:
        yield from ((*part, None) for part in _by_set(batch))
        return
    for i in range(batch.num_rows):
        label, weight = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64) for c in ("label", "weight"))
        bins = np.frombuffer(batch.column("bins")[i].as_buffer(), dtype=np.uint8).reshape(len(label), -1)
        yield batch.column("rows")[i].as_py(), np.full(len(label), batch.column("fold")[i].as_py()), batch.column("block")[i].as_py(), label, bins, weight


def _counted(row, weight: np.ndarray | None, inside: np.ndarray, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each row of ``inside`` is in a tree's sample, or how many of a point's rows are."""
    if weight is None:
        return draws(row[inside], seed) if bootstrap else np.ones(len(inside), np.int64)
    return np.random.default_rng((seed, row)).poisson(weight)[inside] if bootstrap else weight[inside]


def _fall(arrays, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node each row stands in."""
    feature, cut, left, right = arrays
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        low = bins[rows, np.maximum(f, 0)] <= cut[node]
        node = np.where(inner, np.where(low, left[node], right[node]), node)
    return node


# growing -------------------------------------------------------------------------------------------
@dataclass
class _Pass:
    """What a task needs for one pass: models by set, and for each tree its arrays, seed and open nodes."""

    models: dict[str, list[tuple[int, int, bool, list[int]]]]  # set: (model, held, bootstrap, trees)
    trees: dict[int, tuple]  # tree: (arrays, seed, open nodes, features each of them tries, levels)
    classes: int  # 0 for regression

    @property
    def width(self) -> int:
        return self.classes or 3


def _sums(broadcast):
    def add(batches):
        now: _Pass = broadcast.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, fold, row, label, bins, times in _by_part(batch):
                for _, held, bootstrap, trees in now.models.get(name, []):
                    inside = np.flatnonzero(fold != held)
                    for t in trees if len(inside) else ():
                        arrays, seed, nodes, features, levels = now.trees[t]
                        n_features = features.shape[1]
                        place = np.arange(n_features, dtype=np.int64) * BINS
                        slot_of = np.full(len(arrays[0]), -1, np.int64)
                        slot_of[nodes] = np.arange(len(nodes))
                        weight = _counted(row, times, inside, seed, bootstrap)
                        used = inside[weight > 0]
                        weight = weight[weight > 0]
                        slot = slot_of[_fall(arrays, bins[used], levels)]
                        good = slot >= 0
                        used, weight, slot = used[good], weight[good].astype(np.float64), slot[good]
                        size = len(nodes) * n_features * BINS * now.width
                        cell = (slot[:, None] * (n_features * BINS) + place + bins[used[:, None], features[slot]]) * now.width
                        if now.classes:
                            got = np.bincount((cell + label[used].astype(np.int64)[:, None]).ravel(), np.repeat(weight, n_features), size)
                        else:
                            y = label[used]
                            got = sum(np.bincount((cell + j).ravel(), np.repeat(weight * v, n_features), size) for j, v in enumerate((np.ones(len(y)), y, y * y)))
                        total[t] = total[t] + got if t in total else got
        trees, pieces, sums = [], [], []
        for t, got in total.items():
            step = _nodes_of_piece(len(got) // len(now.trees[t][2])) * (len(got) // len(now.trees[t][2]))
            for i, lo in enumerate(range(0, len(got), step)):
                trees.append(t)
                pieces.append(i)
                sums.append(got[lo : lo + step].tobytes())
            if len(sums) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(pieces, pa.int32()), pa.array(sums, pa.binary())], ["tree", "piece", "sums"])
                trees, pieces, sums = [], [], []
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(pieces, pa.int32()), pa.array(sums, pa.binary())], ["tree", "piece", "sums"])

    return add


def _nodes_of_piece(node_size: int) -> int:
    return max(1, PIECE // node_size)


def _spread(stats: np.ndarray, classes: int) -> np.ndarray:
    """Impurity times weight: weighted Gini, or the sum of squared deviations."""
    if classes:
        n = stats.sum(axis=-1)
        return n - np.square(stats).sum(axis=-1) / np.maximum(n, 1e-300)
    n, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
    return np.maximum(q - s * s / np.maximum(n, 1e-300), 0.0)


def best_splits(sums: np.ndarray, least: int, classes: int) -> list[tuple | None]:
    """(feature, cut, left stats, right stats) for each node of ``sums`` [node, feature, bin, stats]; None: no gain."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    weigh = (lambda x: x.sum(axis=-1)) if classes else (lambda x: x[..., 0])
    gain = _spread(whole, classes) - _spread(left, classes) - _spread(right, classes)
    gain[(weigh(left) < least) | (weigh(right) < least)] = -1.0
    out: list[tuple | None] = []
    for i, g in enumerate(gain):
        f, b = np.unravel_index(int(np.argmax(g)), g.shape)
        enough = 1e-9 * max(float(_spread(whole[i, 0, 0], classes)), 1e-12)
        out.append(None if g[f, b] <= enough else (int(f), int(b), left[i, f, b].tolist(), right[i, f, b].tolist()))
    return out


def _splits(settings):
    """``settings``: tree -> (open nodes, features each of them tries, least, classes)."""

    def split(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, piece, data in zip(*(batch.column(c).to_pylist() for c in ("tree", "piece", "sums"))):
                own = np.frombuffer(data, dtype=np.float64)
                held[t, piece] = held[t, piece] + own if (t, piece) in held else own
        rows = []
        for (t, piece), flat in held.items():
            nodes, features, least, classes = settings.value[t]
            width, n_features = classes or 3, features.shape[1]
            sums = flat.reshape(-1, n_features, BINS, width)
            first = piece * _nodes_of_piece(n_features * BINS * width)
            own, names = nodes[first : first + len(sums)], features[first : first + len(sums)]
            for n, feature, here, s in zip(own, names, sums, best_splits(sums, least, classes)):
                rows.append((t, n, here[0].sum(axis=0).tolist(), *((int(feature[s[0]]), *s[1:]) if s else (-1, 0, None, None))))
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["tree", "node", "value", "feature", "cut", "left", "right"])

    return split


def grow(binned: DataFrame, widths: dict[str, int], models: Sequence[Model], classes: int, known: dict[tuple, Model] | None = None) -> None:
    """Grow all ``models`` (their ``grown`` is filled). ``classes`` 0: regression.

    Trees that several models have in common are grown once, to the depth of the deepest of them, and cut back for the others.
    ``known`` keeps them by family, for later calls with the same ``binned``, which grow on where these ended.
    """
    known = {} if known is None else known
    for model in models:
        whole = known.setdefault(model.family, replace(model, grown=[]))
        whole.grown += [Tree(0, model.seed * 100_003 + i + 1) for i in range(len(whole.grown), model.trees)]
        for tree in whole.grown[: model.trees]:
            tree.deepen(model.depth, model.least, classes)
    families = list(known.values())
    for m, whole in enumerate(families):
        for tree in whole.grown:
            tree.model = m
    _grow_open(binned, widths, families, classes)
    for model in models:
        model.grown = [tree.upto(model.depth) for tree in known[model.family].grown[: model.trees]]


def _grow_open(binned: DataFrame, widths: dict[str, int], models: Sequence[Model], classes: int) -> None:
    """Passes until no tree of ``models`` has open nodes."""
    context = binned.sparkSession.sparkContext
    trees = dict(enumerate(tree for model in models for tree in model.grown))
    width = classes or 3
    while True:
        chosen, room = [], HISTOGRAM
        for t, tree in trees.items():
            model = models[tree.model]
            size = len(tree.open) * len(tried(widths[model.rows], model.share, 0, 0)) * BINS * width
            if tree.open and (not chosen or size <= room):
                chosen.append(t)
                room -= size
        if not chosen:
            return
        by_set: dict[str, dict[int, tuple]] = {}
        settings = {}
        for t in chosen:
            tree, model = trees[t], models[trees[t].model]
            by_set.setdefault(model.rows, {}).setdefault(tree.model, (tree.model, model.held, model.bootstrap, []))[3].append(t)
            features = np.stack([tried(widths[model.rows], model.share, tree.seed, n) for n in tree.open])
            settings[t] = (tree.open, features, model.least, classes)
        now = _Pass({s: list(m.values()) for s, m in by_set.items()},
                    {t: (trees[t].arrays(), trees[t].seed, np.array(trees[t].open), settings[t][1], max(trees[t].level) + 1) for t in chosen}, classes)
        state, limits = context.broadcast(now), context.broadcast(settings)
        sums = binned.mapInArrow(_sums(state), "tree int, piece int, sums binary")
        parts = max(1, min(len(chosen), 2 * context.defaultParallelism))
        found = sums.repartition(parts, "tree", "piece").mapInArrow(
            _splits(limits), "tree int, node int, value array<double>, feature int, cut int, left array<double>, right array<double>").collect()
        seen = {(r.tree, r.node): r for r in found}
        for t in chosen:
            tree, model = trees[t], models[trees[t].model]
            after = []
            for node in tree.open:
                r = seen.get((t, node))
                if r is None:  # no rows at all
                    continue
                tree.value[node] = r.value
                if r.feature < 0 or tree.level[node] >= tree.deepest:
                    continue
                tree.feature[node], tree.cut[node] = r.feature, r.cut
                for side, value in (("left", r.left), ("right", r.right)):
                    child = len(tree.feature)
                    getattr(tree, side)[node] = child
                    for column, x in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.right, 0), (tree.level, tree.level[node] + 1), (tree.value, value)):
                        column.append(x)
                    if tree.level[child] < tree.deepest and tree.splittable(child, model.least, classes):
                        after.append(child)
            tree.open = after
        state.destroy()
        limits.destroy()


# scoring -------------------------------------------------------------------------------------------
def _leaf_scores(tree: Tree, classes: int) -> np.ndarray:
    """What each node says: class shares, or the mean."""
    out = np.zeros((len(tree.feature), classes or 1))
    for i, v in enumerate(tree.value):
        if v is not None:
            total = sum(v) if classes else v[0]
            out[i] = (np.array(v) if classes else np.array(v[1:2])) / (total or 1.0)
    return out


def score(binned: DataFrame, models: Sequence[Model], classes: int) -> DataFrame:
    """(model int, label, prediction, n) for classes; (model int, n, y, yy, ee) sums for regression: rows that were held out."""
    packed: dict[str, list] = {}
    for m, model in enumerate(models):
        packed.setdefault(model.rows, []).append((m, model.held, [(t.arrays(), _leaf_scores(t, classes), max(t.level) + 1) for t in model.grown]))
    state = binned.sparkSession.sparkContext.broadcast(packed)

    def judge(batches):
        for batch in batches:
            out = []
            for name, fold, _, label, bins, times in _by_part(batch):
                for m, held, trees in state.value.get(name, []):
                    at = np.flatnonzero(fold == held)
                    if not len(at):
                        continue
                    said = np.zeros((len(at), classes or 1))
                    for arrays, values, levels in trees:
                        said += values[_fall(arrays, bins[at], levels)]
                    y, weight = label[at], np.ones(len(at)) if times is None else times[at]
                    if classes:
                        cells, place = np.unique(np.stack([y, said.argmax(axis=1).astype(np.float64)]), axis=1, return_inverse=True)
                        out += [(m, float(a), float(b), int(c)) for a, b, c in zip(*cells, np.bincount(place.ravel(), weight))]
                    else:
                        error = y - said[:, 0] / len(trees)
                        out.append((m, float(weight.sum()), float(weight @ y), float(weight @ (y * y)), float(weight @ (error * error))))
            if out:
                kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64()] if classes else [pa.int32(), *[pa.float64()] * 4]
                names = ["model", "label", "prediction", "n"] if classes else ["model", "n", "y", "yy", "ee"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    if classes:
        cells = binned.mapInArrow(judge, "model int, label double, prediction double, n bigint")
        return cells.groupBy("model", "label", "prediction").agg(F.sum("n").alias("n"))
    sums = binned.mapInArrow(judge, "model int, n double, y double, yy double, ee double")
    return sums.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "ee")])


def primary_scores(binned: DataFrame, models: Sequence[Model], classes: int, positive_f1: bool = False) -> list[float]:
    """Each model's score on its held-out rows: weighted F1 (or F1 of class 1), or R2."""
    found = score(binned, models, classes)
    if not classes:
        rows = {r.model: r for r in found.collect()}
        out = []
        for m in range(len(models)):
            r = rows.get(m)
            spread = r.yy - r.y * r.y / r.n if r else 0.0
            out.append(round(1.0 - r.ee / spread, metrics.DIGITS) if spread > 0 else 0.0)
        return out
    table = metrics.per_class(found, ["model"])
    if positive_f1:
        got = {r.model: r.f1 for r in table.filter(F.col("class") == 1.0).collect()}
    else:
        got = {r.model: r.f1 for r in metrics.weighted_scores(table, ["model"]).collect()}
    return [got.get(m) or 0.0 for m in range(len(models))]
