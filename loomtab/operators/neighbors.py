"""Exact nearest-neighbour and radius searches over cells of points.

Points belong to the nearest of some pivots, and a cell is what belongs to one. Of every cell its bounding box is known, and
the least and largest distance of its points to each of a few pivots. Both bound the distance of a query to anything in
the cell (the second by the triangle inequality), so a query visits only cells that can still hold an answer. The number
of cells grows with the table: a cell is what one task can hold. A visit is planned by number alone; then the vectors of a
cell are sent once and kept, and those of its queries stream past them. Cells with very many points or queries are dealt
to several tasks on both sides. A task returns at most k candidates (or one count) per query: pairs are never
written out, and nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import col, shuffle_key
from ..functions.staging import materialise

CHUNK_ROWS = 32_768  # points of a cell that a task holds
ASKED = 32_768  # queries that one task answers for a cell, at most
FEWEST_ASKED = 1024
UNITS_PER_CORE = 4
STRIP = 1 << 21  # distances held at a time
LARGEST = 1e150  # numbers whose squares can be added
MOST_OFF = 1e30  # beyond it single precision is not tried
MAX_CELLS = 65_536
RINGS = 16  # pivots to which the distances of every cell are known
BROADCAST_CELLS = 100_000
DISTANCE_DIGITS = 9
MAX_GROUPS = 10_000
NO_NEED = -1

CANDIDATES = "qid long, need int, id long, dist double, value double"


# distances -----------------------------------------------------------------------------------------
def _matrix(column) -> np.ndarray:
    """Rows of numbers from a list column or a sequence of lists; gaps become NaN."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances on the coordinates present on both sides, scaled up to all of them."""
    total = np.zeros((len(a), len(b)))
    holes = np.isnan(a).any() or np.isnan(b).any()
    if not holes:
        for j in range(a.shape[1]):
            total += (a[:, j, None] - b[None, :, j]) ** 2
        return np.sqrt(total)
    both = np.zeros_like(total)
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        seen = ~np.isnan(diff)
        total += np.where(seen, diff * diff, 0.0)
        both += seen
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(np.where(both > 0, total * a.shape[1] / both, np.nan))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs, rounded so that ties are ties."""
    return np.round(np.sqrt(np.square(a - b).sum(axis=1)), DISTANCE_DIGITS)


def _exact_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs as ``_distances`` gives them, rounded so that ties are ties."""
    total, both = np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        diff = a[:, j] - b[:, j]
        seen = ~np.isnan(diff)
        total += np.where(seen, diff * diff, 0.0)
        both += seen
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(np.sqrt(np.where(both > 0, total * a.shape[1] / both, np.nan)), DISTANCE_DIGITS)


class GappyPoints:
    """Vectors with missing numbers in a task, with fast squared distances that are off by at most ``slack``.

    Distances use the coordinates both rows have and are scaled up to all of them; without any they are infinite.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.x, self.seen = vectors, ~np.isnan(vectors)
        n = np.maximum(self.seen.sum(axis=0), 1)
        with np.errstate(over="ignore", invalid="ignore"):
            centre = np.where(self.seen, vectors, 0.0).sum(axis=0) / n
        self.centre = np.where(np.isfinite(centre), centre, 0.0)
        filled, seen = self._filled(vectors)
        self.plain = self._small(filled)
        if self.plain:
            square = np.square(filled)
            self.other = np.hstack([seen, square, -2.0 * filled]).T
            self.marks, self.largest = seen.T.astype(np.float32), square.sum(axis=1).max(initial=0.0)

    def _filled(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = ~np.isnan(vectors)
        return np.where(seen, vectors - self.centre, 0.0), seen.astype(float)

    @staticmethod
    def _small(filled: np.ndarray) -> bool:
        return bool((np.abs(filled) < LARGEST).all())

    def near_squares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled, seen = self._filled(q)
        if not (self.plain and self._small(filled)):  # sums could overflow
            found = np.square(_distances(q, self.x))
            found[np.isnan(found)] = np.inf
            return found, np.zeros(len(q))
        square, dims = np.square(filled), q.shape[1]
        found = np.hstack([square, seen, filled]) @ self.other
        shared = seen.astype(np.float32) @ self.marks
        with np.errstate(divide="ignore", invalid="ignore"):
            found *= dims / shared.astype(float)
        found[shared == 0] = np.inf
        return found, 1e-12 * dims * (square.sum(axis=1) + self.largest) + 1e-300


class Points:
    """Whole vectors in a task, with fast squared distances that are off by at most ``slack``."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.x = vectors
        self.square = np.einsum("ij,ij->i", vectors, vectors)
        self.single: np.ndarray | None = None

    def _single(self) -> np.ndarray:
        """The points in single precision, so that a product with a query is minus half the squared distance."""
        if self.single is None:
            self.centre = self.x.mean(axis=0)
            x = self.x - self.centre
            square = np.einsum("ij,ij->i", x, x)
            self.largest = square.max(initial=0.0)
            with np.errstate(over="ignore"):
                self.single = np.ascontiguousarray(np.hstack([x, -square[:, None] / 2, np.ones((len(x), 1))]).astype(np.float32).T)
        return self.single

    def near_squares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.einsum("ij,ij->i", q, q)
        found = own[:, None] + self.square[None, :] - 2.0 * (q @ self.x.T)
        slack = 1e-12 * (own + self.square.max(initial=0.0)) + 1e-300
        return found, slack

    def _near_and_unsure(self, q: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are surely within eps, and which may be: in single precision, or in double where it leaves many open."""
        rounding = 4.0 * 10.0**-DISTANCE_DIGITS * (eps + 1.0)
        points, dims = self._single(), q.shape[1]
        x = q - self.centre
        own = np.einsum("ij,ij->i", x, x)
        off = 1.2e-7 * ((dims + 8) * (own + self.largest) + eps * eps)  # twice what rounding can come to
        if (off < MOST_OFF).all():
            half = np.hstack([x, np.ones((len(x), 1)), -own[:, None] / 2]).astype(np.float32) @ points
            near = half >= (off - (eps * eps - rounding) / 2).astype(np.float32)[:, None]
            unsure = half >= (-off - (eps * eps + rounding) / 2).astype(np.float32)[:, None]
            unsure ^= near
            if np.count_nonzero(unsure) <= unsure.size // 64:
                return near, unsure
        found, slack = self.near_squares(q)
        slack = slack + rounding
        near = found <= eps * eps - slack[:, None]
        return near, (found <= eps * eps + slack[:, None]) & ~near

    def within(self, q: np.ndarray, eps: float) -> np.ndarray:
        """Which pairs have a (rounded) distance of at most eps."""
        near, unsure = self._near_and_unsure(q, eps)
        r, c = np.nonzero(unsure)
        for lo in range(0, len(r), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            near[r[s], c[s]] = _exact(q[r[s]], self.x[c[s]]) <= eps
        return near

    def strips(self, n: int) -> Iterator[slice]:
        return _strips(len(self.x), n)


def _strips(points: int, n: int) -> Iterator[slice]:
    step = max(1, STRIP // max(1, points))
    for lo in range(0, n, step):
        yield slice(lo, min(lo + step, n))


# block join ----------------------------------------------------------------------------------------
def blocked(queries: DataFrame, points: DataFrame, chunk: int, load: Callable, answer: Callable, schema: str) -> DataFrame:
    """Run ``answer(load(points), queries)`` for every cell: all its points at once, its queries batch by batch.

    ``queries``: qid, vec, an array ``cells`` to visit and what ``answer`` reads. ``points``: id, vec, cell and what
    ``load`` reads. Cells with over ``chunk`` points or ``ASKED`` visits (fewer, if that leaves cores without work) are cut by
    hash on that side, and the other side is sent to each part; the cuts come from counts of numbers only, before any vector moves.
    """
    queries = materialise(queries, "planned")
    asked = materialise(queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q")), "asked")
    # fewer queries a task while there are not enough for all cores
    visited = asked.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    most = min(ASKED, max(FEWEST_ASKED, -(-visited // (UNITS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism))))
    sizes = points.groupBy("cell").agg(F.count("*").alias("p")).join(asked, "cell")
    cut = materialise(sizes.select("cell", F.ceil(F.col("q") / most).cast("int").alias("nq"), F.ceil(F.col("p") / chunk).cast("int").alias("np")), "cuts")
    units = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("nq") * F.col("np")), F.lit(0)).alias("u")).first()
    cut = F.broadcast(cut) if units["n"] <= BROADCAST_CELLS else cut
    visits = queries.withColumn("cell", F.explode("cells")).drop("cells").join(cut, "cell")
    visits = visits.withColumn("qc", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).withColumn("pc", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    held = points.join(cut, "cell").withColumn("pc", F.pmod(F.xxhash64("id"), F.col("np")).cast("int")).withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    both = held.drop("nq", "np").withColumn("asks", F.lit(0)).unionByName(visits.drop("nq", "np").withColumn("asks", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(int(min(max(units["u"], 1), 8192)), "cell", "pc", "qc").sortWithinPartitions("cell", "pc", "qc", "asks")

    def run(batches):
        unit, parts, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "pc", "qc", "asks")])
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=1) != 0).any(axis=0)])) if batch.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows]):
                own = batch.slice(lo, hi - lo)
                if tuple(keys[:3, lo]) != unit:
                    unit, parts, ready = tuple(keys[:3, lo]), [], None
                if not keys[3, lo]:
                    parts.append(own)
                    continue
                if ready is None and parts:
                    ready, parts = load(pa.Table.from_batches(parts)), []
                if ready is not None:  # otherwise this part of the cell is empty
                    yield from (b for b in answer(ready, own) if b.num_rows)

    return dealt.mapInArrow(run, schema)


def _rows(schema: dict[str, pa.DataType], columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))


_CANDIDATE = {"qid": pa.int64(), "need": pa.int32(), "id": pa.int64(), "dist": pa.float64(), "value": pa.float64()}


def _load_by_id(points: pa.Table):
    ids, vectors = points.column("id").to_numpy(), _matrix(points.column("vec"))
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order], bool(np.isnan(vectors).any())


def _top_k(k: int, skip_self: bool) -> Callable:
    def whole(ids: np.ndarray, points: Points, qid: np.ndarray, q: np.ndarray):
        """k nearest on whole vectors: fast distances first, exact ones for what may be among the k."""
        for s in points.strips(len(q)):
            found, slack = points.near_squares(q[s])
            if skip_self:
                found[qid[s][:, None] == ids[None, :]] = np.inf
            n = min(k, found.shape[1])
            kth = np.partition(found, n - 1, axis=1)[:, n - 1]
            kth = np.where(np.isfinite(kth), kth, np.nanmax(np.where(np.isfinite(found), found, -np.inf), axis=1, initial=-np.inf))
            limit = kth + 2 * slack + 4.0 * 10.0**-DISTANCE_DIGITS * (np.sqrt(np.maximum(kth, 0.0)) + 1.0)
            r, c = np.nonzero(found <= limit[:, None])
            dist = _exact(q[s][r], points.x[c])
            order = np.lexsort((c, dist, r))
            r, c, dist = r[order], c[order], dist[order]
            first = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - first < k
            yield qid[s][r[keep]], c[keep], dist[keep]

    def gappy(ids: np.ndarray, points: GappyPoints, qid: np.ndarray, q: np.ndarray, row: np.ndarray, need: np.ndarray):
        """The same for each pair of a query (its ``row``) and what it needs, among the points that have it: the distances of a
        query serve all its needs, mostly by a few nearest points."""
        few = min(len(ids), 4 * k + 32)
        for s in _strips(len(ids), len(q)):
            found, slack = points.near_squares(q[s])
            if skip_self:
                found[qid[s][:, None] == ids[None, :]] = np.inf
            own = slice(*np.searchsorted(row, [s.start, s.stop]))
            r, c = row[own] - s.start, need[own]
            nearest = np.argpartition(found, few - 1, axis=1)[:, :few]
            reach = np.take_along_axis(found, nearest, axis=1)
            able = (c == NO_NEED)[:, None] | points.seen[nearest[r], np.maximum(c, 0)[:, None]]
            near = np.where(able, reach[r], np.inf)
            n = min(k, few)
            limit = _limit(np.partition(near, n - 1, axis=1)[:, n - 1], slack[r])
            sure = (limit < reach.max(axis=1)[r]) | (few == len(ids))
            p, at = np.nonzero(np.isfinite(near) & (near <= limit[:, None]) & sure[:, None])
            pairs, cols = [p], [nearest[r[p], at]]
            for i in np.flatnonzero(~sure):  # too few of the nearest points have it: all that do
                mine = found[r[i]] if c[i] == NO_NEED else np.where(points.seen[:, c[i]], found[r[i]], np.inf)
                inside = np.flatnonzero(np.isfinite(mine) & (mine <= _limit(np.partition(mine, n - 1)[n - 1], slack[r[i]])))
                if len(inside) > few:  # ties
                    dist = _exact_shared(np.broadcast_to(q[s][r[i]], (len(inside), q.shape[1])), points.x[inside])
                    inside = inside[np.argsort(dist, kind="stable")[:k]]
                pairs.append(np.full(len(inside), i))
                cols.append(inside)
            p, at = np.concatenate(pairs), np.concatenate(cols)
            dist = _exact_shared(q[s][r[p]], points.x[at])
            good = np.isfinite(dist)
            p, at, dist = p[good], at[good], dist[good]
            order = np.lexsort((at, dist, p))  # columns are in id order, so ties go to the smaller id
            p, at, dist = p[order], at[order], dist[order]
            keep = np.arange(len(p)) - np.searchsorted(p, p, "left") < k
            p, at = p[keep], at[keep]
            value = np.where(c[p] == NO_NEED, np.nan, points.x[at, np.maximum(c[p], 0)])
            yield _rows(_CANDIDATE, [qid[s][r[p]], c[p], ids[at], dist[keep], value])

    def answer(ready, queries: pa.RecordBatch):
        ids, b, holes = ready
        lists = queries.column("needs")
        row, need = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        qid, q = queries.column("qid").to_numpy(), _matrix(queries.column("vec"))
        if holes or np.isnan(q).any() or (need != NO_NEED).any():
            yield from gappy(ids, GappyPoints(b), qid, q, row, need)
            return
        for asked, at, dist in whole(ids, Points(b), qid, q):
            yield _rows(_CANDIDATE, [asked, np.full(len(at), NO_NEED), ids[at], dist, np.full(len(at), np.nan)])

    return answer


def _limit(kth, slack):
    """What a fast squared distance may be, for its exact one to be among the k smallest."""
    kth = np.asarray(kth)
    root = np.sqrt(np.maximum(np.where(np.isfinite(kth), kth, 0.0), 0.0))
    return kth * (1 + 1e-12) + 2 * slack + 4.0 * 10.0**-DISTANCE_DIGITS * (root + 1.0)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """k smallest (distance, id) per query; trimmed per task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("qid", "need").orderBy("dist", "id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


# cells ---------------------------------------------------------------------------------------------
class Cells:
    """What every task knows of the cells: boxes, distances to the ring pivots, sizes; per group if there are groups."""

    def __init__(self, table: pd.DataFrame, dims: int, pivots: np.ndarray) -> None:
        self.ids, self.group, self.rows = (table[c].to_numpy() for c in ("cell", "grp", "n"))

        def column(name: str, width: int) -> np.ndarray:
            return table[[f"{name}{j}" for j in range(width)]].to_numpy(dtype=float) if width else np.zeros((len(table), 0))

        self.filled = column("f", dims)
        partial = self.filled < self.rows[:, None]
        self.low, self.high = np.where(partial, np.nan, column("lo", dims)), np.where(partial, np.nan, column("hi", dims))
        self.rings = pivots[:RINGS] if len(table) and not partial.any() else pivots[:0]  # distances need whole vectors
        self.near, self.far = column("near", len(self.rings)), column("far", len(self.rings))

    def lower_bounds(self, q: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each cell, on coordinates the whole cell has."""
        total = np.zeros((len(q), len(self.ids)))
        for j in range(q.shape[1]):
            gap = np.maximum(self.low[None, :, j] - q[:, j, None], q[:, j, None] - self.high[None, :, j])
            gap = np.where(np.isnan(gap), 0.0, np.maximum(gap, 0.0))
            total += gap * gap
        seen = np.maximum((~np.isnan(q)).sum(axis=1), 1)
        bound = np.sqrt(total * (q.shape[1] / seen)[:, None])
        if len(self.rings):
            to_pivot = _distances(q, self.rings)  # NaN where a query has gaps: then the boxes alone count
            for p in range(len(self.rings)):
                ring = np.maximum(self.near[None, :, p] - to_pivot[:, p, None], to_pivot[:, p, None] - self.far[None, :, p])
                bound = np.fmax(bound, np.where(np.isnan(q).any(axis=1)[:, None], 0.0, ring * (1 - 1e-12)))
        return bound


def _place(pivots: np.ndarray, dims: int) -> Callable:
    """Add the nearest pivot and the distances to the ring pivots (null for vectors with gaps)."""
    def assign(batches):
        for batch in batches:
            v = _matrix(batch.column("vec"))
            d = np.zeros((len(v), len(pivots)))
            for j in range(dims):
                diff = v[:, j, None] - pivots[None, :, j]
                d += np.where(np.isnan(diff), 0.0, diff * diff)
            rings = _distances(v, pivots[:RINGS])
            whole = ~np.isnan(v).any(axis=1) & ~np.isnan(pivots[:RINGS]).any()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(d.argmin(axis=1).astype(np.int64)), pa.array([r if w else None for r, w in zip(rings, whole)], pa.list_(pa.float64()))],
                [*batch.schema.names, "pivot", "rings"])
    return assign


def build_cells(points: DataFrame, n: int, dims: int, chunk: int, max_cells: int = MAX_CELLS) -> tuple[DataFrame, Cells]:
    """``points`` (id, vec and more; ``grp`` if only points of one group are comparable) with their cell, and the cells."""
    if "grp" not in points.columns:
        points = points.withColumn("grp", F.lit(0))
    wanted = max(1, min(max_cells, math.ceil(n / chunk)))
    # a fixed number of pivots, taken in shuffled order
    pivots = _matrix([r["vec"] for r in points.orderBy(shuffle_key("pivot", F.col("id"))).limit(max(wanted, RINGS)).select("vec").collect()])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    centres, rings = pivots[:wanted], pivots[:RINGS]

    def assign(batches):
        place_rings, place_cells = _place(rings, dims), _place(centres, dims)
        for batch in batches:
            for a, b in zip(place_rings([batch]), place_cells([batch])):
                yield a.set_column(a.schema.get_field_index("pivot"), "pivot", b.column("pivot"))

    placed = points.mapInArrow(assign, f"{kinds}, pivot long, rings array<double>")
    placed = materialise(placed.withColumn("cell", F.col("grp").cast("long") * wanted + F.col("pivot")).drop("pivot"), "cells")
    aggs = [F.count("*").alias("n"), F.min("grp").alias("grp")]
    for j in range(dims):
        v = F.col("vec")[j]
        aggs += [F.min(v).alias(f"lo{j}"), F.max(v).alias(f"hi{j}"), F.count(v).alias(f"f{j}")]
    for p in range(len(rings)):
        aggs += [F.min(F.get("rings", F.lit(p))).alias(f"near{p}"), F.max(F.get("rings", F.lit(p))).alias(f"far{p}")]
    table = placed.groupBy("cell").agg(*aggs).toPandas().sort_values("cell").reset_index(drop=True)  # a row per cell and group
    return placed.drop("rings"), Cells(table, dims, rings)


def _plan(cells: Cells, choose: Callable) -> Callable:
    """Batches with a ``cells`` list added: ``choose(batch, own cells, bounds)`` gives a mask of the cells to visit."""
    def plan(batches):
        for batch in batches:
            groups = batch.column("grp").to_numpy() if "grp" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
            step = max(1, STRIP // max(1, len(cells.ids)))
            for lo in range(0, batch.num_rows, step):
                part, group = batch.slice(lo, step), groups[lo : lo + step]
                q = _matrix(part.column("vec"))
                lists: list = [None] * len(q)
                for g in np.unique(group):
                    mine, own = np.flatnonzero(group == g), np.flatnonzero(cells.group == g)
                    bound = cells.lower_bounds(q[mine])[:, own]
                    mask = choose(part.take(pa.array(mine)), own, bound)
                    for i, m in zip(mine, mask):
                        lists[i] = cells.ids[own[m]]
                kept = [c for c in part.schema.names if c != "reach"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lists, pa.list_(pa.int64()))], [*kept, "cells"])
    return plan


def _first_cells(cells: Cells, k: int) -> Callable:
    """The nearest cells that together surely hold k answers to everything a query needs."""
    def choose(part, own, bound):
        lists = part.column("needs")
        row, need = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        order = np.argsort(bound, axis=1, kind="stable")
        take = np.zeros(len(lists), np.int64)
        for n in np.unique(need).tolist():
            mine = row[need == n]
            able = cells.rows[own] if n == NO_NEED else cells.filled[own][:, n]
            sums = np.cumsum(able[order[mine]], axis=1)
            take[mine] = np.maximum(take[mine], np.minimum((sums < k).sum(axis=1) + 1, bound.shape[1]))
        mask = np.zeros(bound.shape, bool)
        np.put_along_axis(mask, order, np.arange(bound.shape[1])[None, :] < take[:, None], axis=1)
        return mask
    return choose


def _more_cells(cells: Cells, k: int) -> Callable:
    """Further cells that may hold something as near as the k-th answer so far."""
    first = _first_cells(cells, k)

    def choose(part, own, bound):
        reach = part.column("reach").to_numpy()[:, None] * (1 + 1e-12) + 10.0**-DISTANCE_DIGITS
        return (bound <= reach) & ~first(part, own, bound)
    return choose


def search(queries: DataFrame, points: DataFrame, dims: int, k: int, skip_self: bool, chunk: int = CHUNK_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """(qid, need, id, dist, value, rank) for queries (qid, needs, vec) among points (id, vec).

    ``needs`` lists the coordinates for each of which a query wants the k nearest points that have it (``NO_NEED``: the
    k nearest points). With a ``grp`` number on both sides only points of the query's group count.
    """
    # k + 1 copies of a point serve every query, one of them may be the query itself
    groups = ["grp"] if "grp" in points.columns else []
    copy = F.row_number().over(W.partitionBy(*groups, "vec").orderBy("id"))
    points = materialise(points.withColumn("__copy", copy).filter(F.col("__copy") <= k + 1).drop("__copy"), "points")
    queries = materialise(queries, "queries")
    n = points.count()
    find = _top_k(k, skip_self)
    celled, cells = build_cells(points, n, dims, chunk, max_cells)
    planned = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cells array<long>"
    enough = k + (1 if skip_self else 0)

    def visit(asking: DataFrame, choose: Callable) -> DataFrame:
        return blocked(asking.mapInArrow(_plan(cells, choose), planned).drop("grp"), celled.drop("grp"), chunk, _load_by_id, find, CANDIDATES)

    near = materialise(_best(visit(queries, _first_cells(cells, enough)), k), "near")
    if len(cells.ids) <= 1:
        return near
    found = F.map_from_entries(F.collect_list(F.struct("need", "dist")))  # an entry per need
    reach = near.filter(F.col("rank") == k).groupBy("qid").agg(found.alias("__found"))
    far = F.array_max(F.transform("needs", lambda n: F.coalesce(F.try_element_at("__found", n), F.lit(float("inf")))))
    bounded = queries.join(reach, ["qid"], "left").withColumn("reach", far)
    rest = visit(bounded.select(*queries.columns, "reach"), _more_cells(cells, enough))
    return _best(near.drop("rank").unionByName(rest), k)


# operators -----------------------------------------------------------------------------------------
def vector_of(features: Sequence[str]):
    return F.array(*[col(c).cast("double") for c in features])


def knn_join(df: DataFrame, key: str, features: Sequence[str], k: int = 5, within: str | None = None, chunk: int = CHUNK_ROWS, max_cells: int = MAX_CELLS, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest other rows of each row as (key, neighbor, distance, rank).

    ``key`` is a unique whole number; ties go to the smaller key. Rows with a missing feature take no part.
    With ``within`` only rows of the same group (of any type, at most ``MAX_GROUPS`` groups) are neighbours.
    """
    parts = [*features]
    group = []
    if within:
        found = df.select(col(within).cast("string").alias("g")).filter("g is not null").distinct().limit(MAX_GROUPS + 1).collect()
        if len(found) > MAX_GROUPS:
            raise ValueError(f"{within!r} has more than {MAX_GROUPS} groups")
        numbers = F.create_map(*[F.lit(v) for i, g in enumerate(sorted(r["g"] for r in found)) for v in (g, i)]) if found else None
        group = [(F.try_element_at(numbers, col(within).cast("string")) if found else F.lit(0)).alias("grp")]

    def shaped(t: DataFrame, name: str) -> DataFrame:
        rows = t.na.drop(subset=[*parts, *([within] if within else [])])
        return rows.select(col(key).cast("long").alias(name), vector_of(parts).alias("vec"), *group)

    q = shaped(df if queries is None else queries, "qid").withColumn("needs", F.array(F.lit(NO_NEED)))
    q = q.select("qid", "needs", "vec", *(["grp"] if within else []))
    if within:
        q = q.filter("grp is not null")  # a group without points
    found = search(q, shaped(df, "id"), len(parts), k, True, chunk, max_cells)
    return found.select(F.col("qid").alias(key), F.col("id").alias("neighbor"), F.col("dist").alias("distance"), "rank")


def knn_impute(df: DataFrame, columns: Sequence[str], k: int = 5, key: str | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Fill each missing number with the mean of the k nearest rows that have it.

    Distances use the coordinates both rows have. A row without any usable neighbour gets the column mean.
    """
    columns = list(columns)
    holes = df.agg(*[(F.count("*") - F.count(col(c))).alias(f"h{i}") for i, c in enumerate(columns)]).first() if columns else None
    wanted = [i for i in range(len(columns)) if holes[f"h{i}"]]
    if not wanted:
        return df
    rid = key or "__rid"
    if key is None:
        df = materialise(df.withColumn(rid, F.monotonically_increasing_id()), "impute")
    vec = vector_of(columns)
    lacking = F.array_compact(F.array(*[F.when(col(columns[i]).isNull(), F.lit(i)) for i in wanted]))
    queries = df.select(col(rid).cast("long").alias("qid"), lacking.alias("needs"), vec.alias("vec")).filter(F.size("needs") > 0)
    points = df.select(col(rid).cast("long").alias("id"), vec.alias("vec"))
    near = search(queries, points, len(columns), k, True, chunk)
    fill = near.groupBy("qid").agg(*[F.avg(F.when(F.col("need") == i, F.col("value"))).alias(f"__v{i}") for i in wanted])
    means = df.agg(*[F.avg(col(columns[i])).alias(f"m{i}") for i in wanted]).first()
    joined = df.join(fill, col(rid) == F.col("qid"), "left")
    filled = {columns[i]: F.coalesce(col(columns[i]).cast("double"), F.col(f"__v{i}"), F.lit(means[f"m{i}"])) for i in wanted}
    return joined.withColumns(filled).drop("qid", *[f"__v{i}" for i in wanted], *([] if key else [rid]))


# radius search -------------------------------------------------------------------------------------
def radius_cells(points: DataFrame, dims: int, chunk: int = CHUNK_ROWS) -> tuple[DataFrame, Cells]:
    """The cells of ``points`` (id, vec and more), to be searched by any number of ``radius_blocks``."""
    return build_cells(points, points.count(), dims, chunk)


def radius_blocks(celled: DataFrame, cells: Cells, eps: float, load: Callable, answer: Callable, schema: str, queries: DataFrame | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Compare every query with the points of all cells within ``eps`` of it: those whose box and pivot distances allow it.

    ``celled`` has id, vec and cell, plus anything ``load`` reads; ``queries`` has qid and vec, plus what ``answer`` reads.
    """
    if queries is None:
        queries = celled.select(F.col("id").alias("qid"), "vec")
    planned = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cells array<long>"
    reach = eps * (1 + 1e-12) + 10.0**-DISTANCE_DIGITS
    asking = queries.mapInArrow(_plan(cells, lambda part, own, bound: bound <= reach), planned)
    return blocked(asking, celled.drop("grp"), chunk, load, answer, schema)


def _load_weights(points: pa.Table):
    return Points(_matrix(points.column("vec"))), points.column("weight").to_numpy().astype(float)


def _weighed(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight in each row of ``near``."""
    if np.count_nonzero(near) > near.size // 8:
        return near @ weight
    r, c = np.nonzero(near)
    return np.bincount(r, weight[c], len(near))


def _count_within(eps: float) -> Callable:
    def count(ready, queries: pa.RecordBatch):
        points, weight = ready
        q = _matrix(queries.column("vec"))
        n = np.concatenate([_weighed(points.within(q[s], eps), weight) for s in points.strips(len(q))]).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([queries.column("qid").take(pa.array(some)), pa.array(n[some])], ["qid", "n"])
    return count


def distinct_points(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(id, vec, weight): copies of a point are merged into the one with the smallest key."""
    rows = df.na.drop(subset=list(features)).select(col(key).cast("long").alias("k"), vector_of(features).alias("vec"))
    return rows.groupBy("vec").agg(F.min("k").alias("id"), F.count("*").alias("weight")).select("id", "vec", "weight")


def within_counts(celled: DataFrame, cells: Cells, eps: float, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(qid, n): how much weight lies within ``eps`` of each point of ``celled`` (id, vec, weight, cell)."""
    counted = radius_blocks(celled, cells, eps, _load_weights, _count_within(eps), "qid long, n long", chunk=chunk)
    return counted.groupBy("qid").agg(F.sum("n").alias("n"))


def eps_counts(df: DataFrame, key: str, features: Sequence[str], eps: float, chunk: int = CHUNK_ROWS) -> DataFrame:
    """How many rows, itself included, lie within ``eps`` of each row."""
    points = materialise(distinct_points(df, key, features), "distinct")
    celled, cells = radius_cells(points, len(features), chunk)
    totals = within_counts(celled, cells, eps, chunk).withColumnRenamed("n", "n_within")
    per_vec = points.join(totals, F.col("id") == F.col("qid")).select("vec", "n_within")
    rows = df.na.drop(subset=list(features)).select(col(key), vector_of(features).alias("vec"))
    return rows.join(per_vec, "vec").select(col(key), "n_within")
