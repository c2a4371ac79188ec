"""Approximate nearest neighbours by largest inner product: stable projections, kd-trees, a chi-square stop.

One more coordinate, sqrt(M^2 - |x|^2) with the largest norm M (0 for a query), turns the largest inner product into the
smallest distance. A Gaussian (2-stable) matrix projects the vectors to 8 dimensions, where the squared projected distance of
a point at distance d is d^2 times a chi-square variable with 8 degrees of freedom. Points are looked at in
the order of their projected distance, leaf by leaf of a kd-tree, and verified by their inner products in double
precision. The search stops when the next projected distance, divided by the k-th best distance found, lies beyond the
quantile of the chi-square distribution: a true neighbour is still unseen with at most 1 - confidence.

The upper levels of the kd-tree, fitted on a sample, deal all points to cells, a cell to a task. A query is first answered
in the cell it lies in; the k-th score found there bounds its radius, and only cells whose box is within it are asked
as well, starting from that bound. An audit against brute force raises the confidence until the recall is enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomtab.functions.staging import materialise

NEAREST = 20
DIMS = 8  # of the projection; even
CONFIDENCE = 0.95  # to start with
TARGET = 0.95  # audited recall
AUDIT = 256  # query vectors that are compared with brute force
SAMPLE = 20_000  # vectors whose projections the upper tree is fitted on; all are indexed
CELL, CELLS, LARGEST_CELL = 8192, 65_536, 200_000  # vectors of a cell; more only beyond CELLS cells, up to LARGEST_CELL
LEAF = 64
ASKED = 32_768  # queries of a cell in one task; the cell is copied for more


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, dims) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < p else (low, middle)
    return high


class Projection:
    """The Gaussian matrix for vectors of one length, with the norm bound of the added coordinate."""

    def __init__(self, length: int, largest: float, seed: int = 0) -> None:
        self.matrix = np.random.default_rng((seed, length)).standard_normal((length + 1, DIMS))
        self.square = largest

    def points(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", x, x), 0.0))
        return x @ self.matrix[:-1] + more[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


class Splits:
    """Upper levels of a kd-tree: medians of the widest coordinate of a sample; cells are numbered from ``base``."""

    def __init__(self, sample: np.ndarray, cells: int, base: int) -> None:
        self.depth, self.base = int(math.log2(cells)), base
        self.axis, self.value = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
        groups = [sample]
        for level in range(self.depth):
            after = []
            for i, own in enumerate(groups):
                node = (1 << level) - 1 + i
                if len(own):
                    a = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                    self.axis[node], self.value[node] = a, np.median(own[:, a])
                right = own[:, self.axis[node]] > self.value[node]
                after += [own[~right], own[right]]
            groups = after

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth) + 1 + self.base


def _box_distance(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, a row per point."""
    out = np.zeros((len(p), len(low)))
    for j in range(p.shape[1]):
        gap = np.maximum(low[None, :, j] - p[:, j, None], p[:, j, None] - high[None, :, j])
        out += np.square(np.maximum(gap, 0.0))
    return out


class Cell:
    """A kd-tree over the projections of a cell's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection) -> None:
        # in the order of the ids, so that a place is also the rank among ties
        order = np.argsort(ids, kind="stable")
        self.ids, self.projection = ids[order], projection
        self.x = np.concatenate([vectors[order], np.zeros((1, vectors.shape[1]))])  # the last row fills up leaves
        p = projection.points(self.x[:-1])
        leaves, todo = [], [np.arange(len(p))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            a = int(np.argmax(p[own].max(axis=0) - p[own].min(axis=0)))
            half = np.argpartition(p[own, a], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.members = np.full((len(leaves), LEAF), len(p))
        for i, own in enumerate(leaves):
            self.members[i, : len(own)] = own
        self.low = np.array([p[own].min(axis=0) for own in leaves])
        self.high = np.array([p[own].max(axis=0) for own in leaves])

    def nearest(self, queries: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and scores of the k best found for each query, best first; none below its ``least``."""
        none, count = len(self.x) - 1, len(self.members)
        distance = _box_distance(self.projection.queries(queries), self.low, self.high)
        order = np.argsort(distance, axis=1, kind="stable")
        distance = np.take_along_axis(distance, order, 1)
        constant = self.projection.square + np.einsum("ij,ij->i", queries, queries)
        place = np.full((len(queries), k), none)
        score = np.full((len(queries), k), -np.inf)
        active, at, step = np.arange(len(queries)), 0, 1
        while len(active) and at < count:
            near = self.members[order[active, at : at + step]].reshape(len(active), -1)
            s = np.einsum("awd,ad->aw", self.x[near], queries[active])
            s[(near == none) | (s < np.maximum(score[active, -1], least[active])[:, None])] = -np.inf
            better = np.flatnonzero((s > -np.inf).any(axis=1))
            if len(better):
                rows = active[better]
                both_s = np.concatenate([score[rows], s[better]], axis=1)
                both_p = np.concatenate([place[rows], near[better]], axis=1)
                first = np.lexsort((both_p, -both_s), axis=1)[:, :k]
                score[rows], place[rows] = np.take_along_axis(both_s, first, 1), np.take_along_axis(both_p, first, 1)
            at, step = at + step, min(2 * step, max(1, 2048 // len(queries)))
            if at < count:
                radius = factor * np.maximum(constant[active] - 2 * np.maximum(score[active, -1], least[active]), 0.0)
                active = active[distance[active, at] <= radius]
        place[score == -np.inf] = -1
        return place, score


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _by_length(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, pa.RecordBatch]]:
    import pyarrow.compute as pc

    size = pc.list_value_length(batch.column(column)).to_numpy()
    for n in np.unique(size).tolist():
        yield n, batch.filter(pa.array(size == n))


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, name) of the rows that take part; ``name`` is 128 bits of the vector."""
    v = F.col("v")
    good = F.expr("""id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))
        and exists(v, x -> x <> 0)""")
    name = F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v)))
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter(good).withColumn("name", name)


def _cells_of(points: DataFrame) -> tuple[dict[int, tuple[Projection, Splits]], int]:
    """For each vector length its projection and upper tree."""
    square = F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")
    sizes = points.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max(square).alias("largest")).collect()
    total = sum(r.n for r in sizes)
    projections = {r.length: Projection(r.length, r.largest) for r in sizes}
    share = min(1.0, SAMPLE / max(total, 1))
    few = points.filter(F.xxhash64(F.lit(3), "id") <= F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1)).select("v")

    def project(batches):
        for batch in batches:
            for n, own in _by_length(batch):
                p = projections[n].points(_vectors(own.column("v"), own.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, np.int32)), pa.array(list(p), pa.list_(pa.float64()))], ["length", "p"])

    sample = few.mapInArrow(project, "length int, p array<double>").toArrow()
    lengths, flat = sample.column("length").to_numpy(), sample.column("p").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    plan, base = {}, 0
    for r in sorted(sizes, key=lambda r: r.length):
        size = min(max(CELL, r.n / CELLS), LARGEST_CELL)
        cells = 1 << max(0, math.ceil(math.log2(r.n / size)))
        plan[r.length] = projections[r.length], Splits(flat[lengths == r.length], cells, base)
        base += cells
    return plan, base


def _answer(plan, k: int, factor: float, id_kind: pa.DataType):
    """Rows of cells and their queries (sorted by cell, part, asks) to (name, v, cell, ids, scores, same), a row per query; same: an equal vector."""

    def answer(batches):
        at, cell, held = None, None, []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "asks")])
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(where, axis=1) != 0).any(axis=0)])) if batch.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                own, now = batch.slice(lo, hi - lo), tuple(where[:2, lo].tolist())
                if now != at:
                    at, cell, held = now, None, []
                if not where[2, lo]:
                    held.append((own.column("id").to_numpy(zero_copy_only=False), _vectors(own.column("v"), own.num_rows)))
                    continue
                if held:
                    ids, vectors = (np.concatenate(x) for x in zip(*held))
                    cell, held = Cell(ids, vectors, plan[vectors.shape[1]][0]), []
                for start in range(0, own.num_rows, 256):
                    part = own.slice(start, 256)
                    if cell is None:  # no vectors in this cell
                        ids = scores = same = [[]] * part.num_rows
                    else:
                        least = part.column("least").to_numpy()
                        q = _vectors(part.column("v"), part.num_rows)
                        place, score = cell.nearest(q, least, k, factor)
                        same = [(cell.x[p[p >= 0]] == v).all(axis=1) for p, v in zip(place, q)]
                        ids = [cell.ids[p[p >= 0]].tolist() for p in place]
                        scores = [s[p >= 0] for p, s in zip(place, score)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("name"), part.column("v"), part.column("cell"), pa.array(ids, pa.list_(id_kind)), pa.array(scores, pa.list_(pa.float64())),
                         pa.array(same, pa.list_(pa.bool_()))], ["name", "v", "cell", "ids", "scores", "same"])

    return answer


def _place(plan, as_query: bool):
    """Add the cell."""

    def place(batches):
        for batch in batches:
            for n, own in _by_length(batch):
                if n in plan:  # a length that no indexed vector has
                    projection, splits = plan[n]
                    x = _vectors(own.column("v"), own.num_rows)
                    cell = splits.cell(projection.queries(x) if as_query else projection.points(x))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.astype(np.int32))], [*own.schema.names, "cell"])

    return place


def _boxes(placed: DataFrame, plan, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounding boxes of the cells' projections; cells without vectors are infinitely far."""

    def bound(batches):
        low, high = {}, {}
        for batch in batches:
            for n, own in _by_length(batch):
                p, cell = plan[n][0].points(_vectors(own.column("v"), own.num_rows)), own.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
                for c, a, b in zip(cell[order][first].tolist(), np.minimum.reduceat(p[order], first), np.maximum.reduceat(p[order], first)):
                    low[c] = np.minimum(low.get(c, a), a)
                    high[c] = np.maximum(high.get(c, b), b)
        if low:
            side = pa.array([[*low[c], *high[c]] for c in low], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), side], ["cell", "box"])

    sides = [f(F.get("box", F.lit(i))).alias(f"b{i}") for i, f in enumerate([F.min] * DIMS + [F.max] * DIMS)]
    found = placed.select("v", "cell").mapInArrow(bound, "cell int, box array<double>").groupBy("cell").agg(*sides).toArrow()
    low, high = np.full((cells, DIMS), np.inf), np.full((cells, DIMS), np.inf)
    at = found.column("cell").to_numpy()
    for i in range(DIMS):
        low[at, i], high[at, i] = found.column(f"b{i}").to_numpy(), found.column(f"b{DIMS + i}").to_numpy()
    return low, high


def _reach(plan, boxes, k: int, factor: float):
    """The cells each query still has to ask (``others``) and the score below which nothing matters there (``least``)."""

    def reach(batches):
        low, high = boxes.value
        for batch in batches:
            for n, own in _by_length(batch):
                projection, splits = plan[n]
                span = slice(splits.base, splits.base + (1 << splits.depth))
                for start in range(0, own.num_rows, 64):
                    part = own.slice(start, 64)
                    q = _vectors(part.column("v"), part.num_rows)
                    least = np.array([s[-1] if len(s) == k else -np.inf for s in part.column("scores").to_pylist()])
                    radius = factor * np.maximum(projection.square + np.einsum("ij,ij->i", q, q) - 2 * least, 0.0)
                    distance = _box_distance(projection.queries(q), low[span], high[span])
                    near = (distance <= radius[:, None]) & (distance < np.inf)
                    near[np.arange(len(q)), part.column("cell").to_numpy() - splits.base] = False
                    others = [(np.flatnonzero(r) + splits.base).astype(np.int32) for r in near]
                    yield pa.RecordBatch.from_arrays([part.column("name"), part.column("v"), pa.array(least), pa.array(others, pa.list_(pa.int32()))],
                                                     ["name", "v", "least", "others"])

    return reach


def _search(placed: DataFrame, asking: DataFrame, plan, cells: int, boxes, k: int, confidence: float) -> DataFrame:
    """(name, id, score, same): the k best found for each vector of ``asking`` (name, v, cell)."""
    factor = quantile(confidence)
    kind = placed.schema["id"].dataType.simpleString()
    v_kind = placed.schema["v"].dataType.simpleString()
    id_arrow = placed.select("id").limit(0).toArrow().schema.field("id").type
    answer = _answer(plan, k, factor, id_arrow)
    schema = f"name string, v {v_kind}, cell int, ids array<{kind}>, scores array<double>, same array<boolean>"
    nobody = F.lit(None).cast(kind)

    def ask(points: DataFrame, queries: DataFrame, label: str) -> DataFrame:
        both = points.select("cell", "part", F.lit(0).alias("asks"), "id", "v", F.lit("").alias("name"), F.lit(0.0).alias("least")).union(
            queries.select("cell", "part", F.lit(1), nobody, "v", "name", "least"))
        dealt = both.repartition(min(cells, 8192), "cell", "part").sortWithinPartitions("cell", "part", "asks")
        return materialise(dealt.mapInArrow(answer, schema), label)

    zero = F.lit(0).alias("part")
    home = ask(placed.select("cell", zero, "id", "v"), asking.select("cell", zero, "v", "name", F.lit(float("-inf")).alias("least")), "home")
    reach = home.mapInArrow(_reach(plan, boxes, k, factor), f"name string, v {v_kind}, least double, others array<int>")
    visits = materialise(reach.select("name", "v", "least", F.explode("others").alias("cell")), "visits")
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    parts = F.broadcast(materialise(parts, "parts"))  # a row per cell
    copies = placed.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
    asked = visits.join(parts, "cell").select("cell", F.expr("cast(pmod(xxhash64(name), parts) as int)").alias("part"), "v", "name", "least")
    away = ask(copies, asked, "away")
    found = home.union(away).select("name", F.explode(F.arrays_zip("ids", "scores", "same")).alias("f"))
    best = W.partitionBy("name").orderBy(F.col("score").desc(), "id")
    found = found.select("name", F.col("f.ids").alias("id"), F.col("f.scores").alias("score"), F.col("f.same").alias("same"))
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("name", "id", "score", "same")


def _recall(points: DataFrame, asking: DataFrame, found: DataFrame, k: int) -> float:
    """Share of the true k nearest (by score) that were found, for ``AUDIT`` of the query vectors, chosen by hash."""
    spark = points.sparkSession
    audit = [(r.name, list(r.v)) for r in asking.orderBy("name").limit(AUDIT).select("name", "v").collect()]
    if not audit:
        return 1.0
    groups = {}
    for name, v in audit:
        groups.setdefault(len(v), []).append((name, v))
    sent = spark.sparkContext.broadcast({n: ([x[0] for x in g], np.array([x[1] for x in g], dtype=np.float64)) for n, g in groups.items()})

    def brute(batches):
        for batch in batches:
            for n, own in _by_length(batch):
                if n in sent.value:
                    names, q = sent.value[n]
                    score = np.sort(_vectors(own.column("v"), own.num_rows) @ q.T, axis=0)[::-1][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), len(score))), pa.array(score.T.ravel())], ["name", "score"])

    best = W.partitionBy("name").orderBy(F.col("score").desc())
    true = points.select("v").mapInArrow(brute, "name string, score double").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    edge = true.groupBy("name").agg(F.min("score").alias("edge"), F.count("*").alias("n"))
    hits = found.join(F.broadcast(edge), "name").filter(F.col("score") >= F.col("edge") - 1e-9).count()
    total = edge.agg(F.sum("n")).first()[0]
    return hits / total if total else 1.0


def nearest(df: DataFrame, asks: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding",
            confidence: float = CONFIDENCE, target: float = TARGET) -> tuple[DataFrame, float]:
    """(query_id, rank int, key, score double) and the audited recall.

    The rows of ``df`` for which ``asks`` (a condition on its columns) is true are queries, and all others of its rows
    their candidates. Nearness is the inner product in double precision, equal ones in the order of the key; a query with
    fewer than k candidates gets them all. Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows with a null key; vectors of different lengths are no candidates of each other. Rows that repeat
    key and vector are one row; a key with several vectors has a row for each of them, which ask and answer apart. A result column is named ``key``, after it ``query_id`` for the query's own. Other columns
    are not read. Empty tables and tables without a query give no rows.

    Equal vectors are searched once, and only the k + 1 smallest keys among them can be answers, so copies
    cost nothing. Shuffled are the vectors (to their cells, twice), a query per cell it asks, and k rows per query.
    """
    marked = df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{vector}`").alias("__v"), F.coalesce(asks, F.lit(False)).alias("__asks"))
    rows = _rows(marked, "__k", "__v")
    first = W.partitionBy("name").orderBy("id")
    points = rows.dropDuplicates(["name", "id"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    points = materialise(points, "points")
    queries = materialise(_rows(marked.filter("__asks"), "__k", "__v").select("id", "name", "v").dropDuplicates(["id", "name"]), "queries")
    plan, cells = _cells_of(points)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    if not plan:
        return df.sparkSession.createDataFrame([], f"query_id {kinds['id']}, rank int, `{key}` {kinds['id']}, score double"), 1.0
    placed = points.select("id", "v").mapInArrow(_place(plan, False), f"id {kinds['id']}, v {kinds['v']}, cell int")
    placed = materialise(placed, "cells")
    distinct = queries.select("name", "v").dropDuplicates(["name"])
    asking = materialise(distinct.mapInArrow(_place(plan, True), f"name string, v {kinds['v']}, cell int"), "asking")
    boxes = df.sparkSession.sparkContext.broadcast(_boxes(placed, plan, cells))
    while True:
        found = materialise(_search(placed, asking, plan, cells, boxes, k + 1, confidence), "found")
        recall = _recall(points, asking, found, k + 1)
        if recall >= target:
            break
        confidence = 1 - (1 - confidence) / 4
    own = queries.select(F.col("id").alias("query_id"), "name").join(found, "name").filter("id <> query_id or not same")
    best = W.partitionBy("query_id", "name").orderBy(F.col("score").desc(), "id")
    out = own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "score"), recall


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: every key divisible by 20 asks."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)[0]


SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id % 20 = 0 and (q.vec_id <> c.vec_id or q.e <> c.e) and len(q.e) = len(c.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pair qualify rank <= 20"""
