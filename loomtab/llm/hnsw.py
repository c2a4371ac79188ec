"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, exact cosines, components.

Equal vectors are one class; classes are dealt to shards. A shard's task builds a layered graph of its classes, in
batches: many nodes at a time search the graph so far, link to diverse neighbours and are linked back. Every other
shard's classes query it, each pair of shards once. Beams start narrow and are widened until an audit against brute force in
the shard passes; a query whose whole beam lies within the threshold is answered by a scan of the shard, whose pairs are
folded strip by strip. Matches are verified in double precision. A task returns link counts and, instead of pairs, one
link per query and local component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtab.functions.staging import materialise

from .common import components

THRESHOLD = 0.95
DEGREE = 16  # links of a node above the base layer; twice that in the base layer
TREE = 4  # links of a base node to nodes that were inserted later and count on it
BUILD_BEAM = 48
BEAM = 32
TARGET = 0.99  # audited recall
AUDIT = 1024  # queries of a shard's audit, of its own and again of others, at most
AUDIT_MATCHES = 200  # true matches that are enough for it
STRIP = 1 << 20  # cosines of a scan held at a time
SHARDS = 13  # at least; odd, so that each pair of shards has one direction
SHARD_SIZE = 200_000


class Graph:
    """Layers of adjacency lists over unit vectors; -1 fills unused places."""

    def __init__(self, unit: np.ndarray, seed: int = 0) -> None:
        self.x = unit
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(DEGREE)).astype(int), 8)
        # the last places of a base row hold a tree, so that every node stays reachable: TREE children and the parent
        self.layers = [np.full((n, 2 * DEGREE + TREE + 1 if l == 0 else DEGREE), -1, dtype=np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        self.children = np.zeros(n, dtype=np.int32)
        order = rng.permutation(n)
        # the highest node first: it is the entry
        if n:
            top = int(np.argmax(self.level))
            order = np.concatenate([[top], order[order != top]])
            self.entry = top
        done = 1
        while done < n:
            size = min(256, 2 * done, n - done)
            self._insert(order[done : done + size])
            done += size

    def _similar(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cosines of each query with its own row of ids (-1: -2)."""
        found = np.matmul(self.x[ids], queries[:, :, None])[:, :, 0]
        found[ids < 0] = -2.0
        return found

    def _beam(self, queries: np.ndarray, start: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query, best first: ids and cosines."""
        links, n, q = self.layers[layer], len(self.x), len(queries)
        ids = np.full((q, width), -1, dtype=np.int32)
        sims = np.full((q, width), -2.0, dtype=np.float32)
        open_ = np.zeros((q, width), dtype=bool)
        seen = np.zeros((q, n), dtype=bool)
        k = min(width, start.shape[1])
        first = self._similar(queries, start)
        best = np.argsort(-first, axis=1, kind="stable")[:, :k]
        ids[:, :k], sims[:, :k] = np.take_along_axis(start, best, 1), np.take_along_axis(first, best, 1)
        open_[:, :k] = ids[:, :k] >= 0
        row = np.arange(q)
        seen[row[:, None].repeat(start.shape[1], 1)[start >= 0], start[start >= 0]] = True
        step = 1 if width < 8 else 4
        active = row
        while True:
            active = active[open_[active].any(axis=1)]
            if not len(active):
                return ids, sims
            score = np.where(open_[active], sims[active], -3.0)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if step > 1 else score.argmax(axis=1)[:, None]
            valid = np.take_along_axis(open_[active], pick, 1)
            open_[active[:, None], pick] = False
            near = links[np.where(valid, ids[active[:, None], pick], 0)]
            near[~valid] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[active[:, None], np.where(fresh, near, 0)]
            some = fresh.any(axis=1)
            if not some.any():
                continue
            who, near, fresh = active[some], near[some], fresh[some]
            r, c = np.nonzero(fresh)
            seen[who[r], near[r, c]] = True
            found = np.full(near.shape, -2.0, dtype=np.float32)
            found[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], queries[who[r]])
            near[~fresh] = -1
            all_ids = np.concatenate([ids[who], near], axis=1)
            all_sims = np.concatenate([sims[who], found], axis=1)
            all_open = np.concatenate([open_[who], fresh], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[who], sims[who], open_[who] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_open))

    def _entries(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        at = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for layer in range(len(self.layers) - 1, down_to, -1):
            at = self._beam(queries, at, 1, layer)[0]
        return at

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row of candidates (best first) those nearer to the row's node than to any kept one; then the best others."""
        q, c = ids.shape
        v = self.x[np.where(ids < 0, 0, ids)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros((q, c), dtype=bool)
        worst = np.full((q, c), -2.0, dtype=np.float32)  # largest cosine with a kept candidate
        for j in range(c):
            take = (ids[:, j] >= 0) & (worst[:, j] < sims[:, j]) & (kept.sum(axis=1) < most)
            kept[take, j] = True
            worst[take] = np.maximum(worst[take], between[take, j])
        rank = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((q, most - out.shape[1]), -1, dtype=out.dtype)], axis=1)
        return out

    def _insert(self, nodes: np.ndarray) -> None:
        queries = self.x[nodes]
        at = np.full((len(nodes), 1), self.entry, dtype=np.int32)
        own = queries @ queries.T
        np.fill_diagonal(own, -2.0)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(self.level[nodes] >= layer)
            above = np.flatnonzero(self.level[nodes] < layer)
            if len(above):
                at[above] = self._beam(queries[above], at[above][:, :1], 1, layer)[0]
            if not len(here):
                continue
            ids, sims = self._beam(queries[here], at[here], BUILD_BEAM, layer)
            if at.shape[1] < BUILD_BEAM:
                at = np.concatenate([at, np.full((len(nodes), BUILD_BEAM - at.shape[1]), -1, dtype=np.int32)], axis=1)
            at[here] = ids
            if layer == 0:
                self._adopt(nodes[here], ids)
            # company inserted at the same time
            k = min(16, len(here) - 1)
            if k > 0:
                part = own[np.ix_(here, here)]
                mates = np.argsort(-part, axis=1, kind="stable")[:, :k]
                ids = np.concatenate([ids, nodes[here][mates].astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(part, mates, 1)], axis=1)
                rank = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
            links = self.layers[layer]
            most = 2 * DEGREE if layer == 0 else DEGREE
            chosen = self._diverse(ids, sims, DEGREE)
            links[nodes[here], :DEGREE] = chosen
            self._link_back(links, nodes[here], chosen, most)

    def _adopt(self, nodes: np.ndarray, ids: np.ndarray) -> None:
        """Tie each node both ways to the nearest earlier node that has a place left."""
        for v, near in zip(nodes.tolist(), ids):
            free = near[(near >= 0) & (self.children[near] < TREE)]
            p = int(free[0] if len(free) else near[0])
            while self.children[p] == TREE:  # down the tree, by the most similar child
                kids = self.layers[0][p, 2 * DEGREE : 2 * DEGREE + TREE]
                p = int(kids[np.argmax(self.x[kids] @ self.x[v])])
            self.layers[0][p, 2 * DEGREE + self.children[p]] = v
            self.layers[0][v, -1] = p
            self.children[p] += 1

    def _link_back(self, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray, most: int) -> None:
        r, c = np.nonzero(chosen >= 0)
        to, new = chosen[r, c], nodes[r].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(target), 512):
            t, f, n = target[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            incoming = np.full((len(t), int(n.max())), -1, dtype=np.int32)
            where = np.arange(int(n.max()))[None, :] < n[:, None]
            incoming[where] = new[f[0] : f[-1] + n[-1]]
            both = np.concatenate([links[t, :most], incoming], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = self._similar(self.x[t], both)
            rank = np.argsort(-sims, axis=1, kind="stable")[:, : most + DEGREE]
            both, sims = np.take_along_axis(both, rank, 1), np.take_along_axis(sims, rank, 1)
            full = (both >= 0).sum(axis=1) > most
            links[t[~full], :most] = both[~full][:, :most]
            if full.any():
                links[t[full], :most] = self._diverse(both[full], sims[full], most)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(queries, self._entries(queries, 0), width, 0)


class Labels:
    """Components of a shard's nodes: the smallest node of each, many unions at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n, dtype=np.int32)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            a, b = a[a != b], b[a != b]
            np.minimum.at(self.parent, b, a)


def _touched(hit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, label) of the distinct labels among each row's hits."""
    low = np.where(hit, label, np.int32(len(label))).min(axis=1)
    high = np.where(hit, label, np.int32(-1)).max(axis=1)
    one = np.flatnonzero((high >= 0) & (low == high))
    rows, found = [one], [low[one]]
    for r in np.flatnonzero(low < high):
        own = np.unique(label[hit[r]])
        rows.append(np.full(len(own), r))
        found.append(own)
    return np.concatenate(rows), np.concatenate(found)


class Shard:
    """Range search by cosine in one shard, with audited beams.

    A query whose beam is not filled by matches is answered by the graph, all others by a scan of the shard in strips. The
    pairs of a strip are folded into counts and components at once, so memory does not grow with the number of pairs.
    The beam is widened by an audit: queries, first some of the shard's own and then those of other shards, are answered
    by both ways until ``AUDIT_MATCHES`` true matches were seen at the present width (or ``AUDIT`` queries of each kind).
    """

    def __init__(self, vectors: np.ndarray, threshold: float) -> None:
        self.vectors = vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.vectors, axis=1)
        self.unit = (self.vectors / self.norm[:, None]).astype(np.float32)
        self.threshold = threshold
        self.slack = 1e-5 + 1.5e-7 * vectors.shape[1]  # more than single precision can be off
        self.graph = Graph(self.unit)
        self.block = max(16, min(1024, (1 << 25) // max(1, len(vectors))))
        self.strip = max(1, STRIP // max(1, len(vectors)))
        self.width = min(BEAM, len(vectors))
        self.foreign = self.true = self.seen = 0
        some = np.random.default_rng(len(vectors)).permutation(len(vectors))[:AUDIT]
        for lo in range(0, len(some), 256):
            if self.true >= AUDIT_MATCHES:
                break
            own = some[lo : lo + 256]
            self._audit(self._ready(self.vectors[own]), own)

    @staticmethod
    def _ready(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = vectors.astype(np.float64)
        norm = np.linalg.norm(vectors, axis=1)
        return vectors, norm, (vectors / norm[:, None]).astype(np.float32)

    def _exact(self, asked, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which pairs reach the threshold in double precision."""
        good = np.zeros(len(q), dtype=bool)
        for lo in range(0, len(q), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            dot = np.einsum("ij,ij->i", asked[0][q[s]], self.vectors[node[s]])
            good[s] = dot / (asked[1][q[s]] * self.norm[node[s]]) >= self.threshold
        return good

    def pairs(self, asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) of the links that the graph finds, and which queries need a scan instead."""
        unit, none = asked[2], np.zeros(0, np.int64)
        if self.width >= len(self.unit):
            return none, none, np.ones(len(unit), dtype=bool)
        full, q, node = np.zeros(len(unit), dtype=bool), [none], [none]
        for lo in range(0, len(unit), self.block):
            ids, sims = self.graph.search(unit[lo : lo + self.block], self.width)
            own = (sims >= self.threshold - self.slack) & (ids >= 0)
            more = own[:, -1]
            full[lo : lo + self.block] = more
            r, c = np.nonzero(own & ~more[:, None])
            q.append(r + lo)
            node.append(ids[r, c].astype(np.int64))
        q, node = np.concatenate(q), np.concatenate(node)
        good = self._exact(asked, q, node)
        return q[good], node[good], full

    def scan(self, asked, rows: np.ndarray):
        """(rows, hit) strips: the exact links of some queries with all nodes."""
        for lo in range(0, len(rows), self.strip):
            own = rows[lo : lo + self.strip]
            sims = asked[2][own] @ self.unit.T
            hit = sims >= self.threshold + self.slack
            r, c = np.nonzero((sims >= self.threshold - self.slack) & ~hit)
            hit[r, c] = self._exact(asked, own[r], c)
            yield own, hit

    def _audit(self, asked, own: np.ndarray | None = None) -> None:
        """Compare the graph with a scan; ``own``: the queries are these nodes, which do not count as their own matches."""
        q, node, full = self.pairs(asked)
        if own is not None:
            q = q[own[q] != node]
        self.seen += len(q)
        for rows, hit in self.scan(asked, np.flatnonzero(~full)):
            if own is not None:
                hit[np.arange(len(rows)), own[rows]] = False
            self.true += int(hit.sum())
        if self.seen < TARGET * self.true:
            self.width, self.true, self.seen = min(2 * self.width, len(self.unit)), 0, 0

    def links_inside(self, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of each node's rows with others, component of each node). A pair counts if either side finds it."""
        n, asked = len(self.unit), (self.vectors, self.norm, self.unit)
        q, node, full = self.pairs(asked)
        some = ~full[node] & (q != node)  # pairs with a scanned node come from its scan
        both = np.unique(np.minimum(q, node)[some] * n + np.maximum(q, node)[some])
        a, b = both // n, both % n
        counts = 0.0 + np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
        labels = Labels(n)
        labels.join(a, b)
        rest = np.flatnonzero(~full)
        for rows, hit in self.scan(asked, np.flatnonzero(full)):
            hit[np.arange(len(rows)), rows] = False
            counts[rows] += hit @ copies
            counts[rest] += copies[rows] @ hit[:, rest]
            r, label = _touched(hit, labels.roots())
            labels.join(rows[r], label)
        return counts, labels.roots()

    def links_to(self, vectors: np.ndarray, weight: np.ndarray, copies: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links of each query, and (query, component) of the components it touches); ``counts`` of the nodes are raised."""
        asked = self._ready(vectors)
        if self.foreign < AUDIT and self.true < AUDIT_MATCHES:
            self.foreign += len(vectors)
            self._audit(asked)
        q, node, full = self.pairs(asked)
        links = np.bincount(q, weights=copies[node], minlength=len(vectors)).astype(np.float64)
        counts += np.bincount(node, weights=weight[q], minlength=len(counts))
        ties = [(q, label[node])]
        for rows, hit in self.scan(asked, np.flatnonzero(full)):
            links[rows] += hit @ copies
            counts += weight[rows] @ hit
            r, touched = _touched(hit, label)
            ties.append((rows[r], touched))
        both = np.unique(np.concatenate([q for q, _ in ties]).astype(np.int64) * len(label) + np.concatenate([t for _, t in ties]))
        return links.astype(np.int64), both // len(label), both % len(label)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``audited_near_duplicates`` alone."""
    return audited_near_duplicates(df, key, vector, threshold)[0]


def audited_near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, n_links long, component_id, kept boolean), one row per row of ``df``.

    Two rows are linked if the cosine of their vectors is at least the threshold, found by the graphs and verified in double
    precision. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
    vectors of different lengths with each other. ``component_id``: smallest key reachable. Equal vectors are each
    other's links. ``key`` should identify rows; rows that repeat a key count as further copies. An empty table
    gives no rows. Other columns are not read.

    The number of shards is 13, or more for over 2.6 million vectors, so that a shard fits a task.

    The second table is the audit: (shard, width, matches, found) with the beam of each shard in the end, the true matches that
    its audit saw at that width, and how many of them the graph found.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    good = F.expr("""v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))
        and exists(v, x -> x <> 0)""")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    grouped = rows.filter("good").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = materialise(grouped, "vectors")
    total = classes.count()
    shards = max(SHARDS, 2 * (total // (2 * SHARD_SIZE)) + 1)
    half = (shards - 1) // 2
    dealt = classes.withColumn("own", F.pmod(F.xxhash64("v", "id"), F.lit(shards))).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.lit(half)))
    ).select(
        (F.size("v") * F.lit(shards).cast("long") + F.pmod(F.col("own") - F.col("ask"), F.lit(shards))).alias("target"),
        (F.col("ask") > 0).cast("int").alias("asks"), "id", "copies", "v",
    )
    id_kind = rows.schema["id"].dataType.simpleString()
    id_arrow = rows.select("id").limit(0).toArrow().schema.field("id").type

    def link(batches):
        target, shard, ids, copies, counts, local = None, None, None, None, None, None
        held: list = []

        def build():
            nonlocal shard, ids, copies, counts, local
            ids = np.array([i for h in held for i in h[0]], dtype=object)
            copies = np.concatenate([h[1] for h in held]).astype(np.float64)
            shard = Shard(np.concatenate([h[2] for h in held]), threshold)
            held.clear()
            counts, local = shard.links_inside(copies)

        def rows_(a, n, b, audit=None):
            more = [pa.array([x] * len(a), pa.int64()) for x in audit or [None] * 4]
            return pa.RecordBatch.from_arrays([pa.array(list(a), id_arrow), pa.array(n, pa.int64()), pa.array(list(b), id_arrow), *more],
                                              ["a", "links", "b", "shard", "width", "matches", "found"])

        def close():
            some = np.flatnonzero(counts)
            tied = np.flatnonzero(local != np.arange(len(local)))
            yield rows_(ids[some], counts[some].astype(np.int64), [None] * len(some))
            yield rows_(ids[tied], [None] * len(tied), ids[local[tied]])
            yield rows_([None], [None], [None], [int(target), shard.width, shard.true, shard.seen])

        for batch in batches:
            goals = batch.column("target").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (goals[1:] != goals[:-1]) | (np.diff(batch.column("asks").to_numpy()) != 0)]))
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if goals[lo] != target:
                    if held:
                        build()
                    if shard is not None:
                        yield from close()
                    target, shard = goals[lo], None
                own = part.column("v")
                vectors = own.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if not part.column("asks")[0].as_py():
                    held.append((part.column("id").to_pylist(), part.column("copies").to_numpy(), vectors))
                    continue
                if held:
                    build()
                if shard is None:  # the shard itself is empty
                    continue
                asking, weight = np.array(part.column("id").to_pylist(), dtype=object), part.column("copies").to_numpy().astype(np.float64)
                for at in range(0, len(asking), 1024):
                    own = asking[at : at + 1024]
                    links, q, component = shard.links_to(vectors[at : at + 1024], weight[at : at + 1024], copies, local, counts)
                    some = np.flatnonzero(links)
                    yield rows_(own[some], links[some], [None] * len(some))
                    yield rows_(own[q], [None] * len(q), ids[component])
        if held:
            build()
        if shard is not None:
            yield from close()

    spread = dealt.repartitionByRange(shards, "target").sortWithinPartitions("target", "asks", "id")
    found = materialise(spread.mapInArrow(link, f"a {id_kind}, links bigint, b {id_kind}, shard bigint, width bigint, matches bigint, found bigint"), "links")
    counts = found.filter("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(classes.select(F.col("id").alias("node")).distinct(), found.filter("b is not null").select("a", "b"))
    per_class = classes.join(counts, F.col("id") == F.col("a"), "left").join(joined, F.col("id") == F.col("node"), "left").select(
        F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = rows.filter("good").join(per_class, F.col("v") == F.col("w")).select("id", "n_links", "component_id").union(
        rows.filter("not good").select("id", F.lit(0).cast("bigint"), "id"))
    result = out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return result, found.filter("shard is not null").select("shard", "width", "matches", "found")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(embeddings.select("vec_id", "embedding"))


SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, link.y from reach join link on reach.b = link.x)
select e.vec_id, (select count(*) from link where x = e.vec_id) as n_links, (select min(b) from reach where a = e.vec_id) as component_id,
       (select min(b) from reach where a = e.vec_id) = e.vec_id as kept
from embeddings e"""
