"""Radius searches: a first look in single precision, exact where it cannot tell, and links as forests of numbered cells."""

import numpy as np
import pyarrow as pa
import pytest

from loomtab.operators import cluster, neighbors


@pytest.mark.parametrize("kind", ["unit", "far", "spread", "huge", "edge"])
def test_pairs_within_reach_are_those_of_exact_distances(kind, monkeypatch):
    rng, eps = np.random.default_rng(1), 1.2
    x = rng.normal(size=(300, 8))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "far":
        x = x / 2 + 1e6
    if kind == "spread":
        x[::2] *= 1e5
    if kind == "huge":
        x[::3] *= 1e18
    if kind == "edge":  # steps of 0.4: many pairs are exactly at the radius
        x = np.round(x) * 0.4
    want = np.round(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)), neighbors.DISTANCE_DIGITS) <= eps
    assert (neighbors.Points(x).within(x, eps) == want).all()
    if kind == "unit":  # no double-precision product of all pairs
        monkeypatch.setattr(neighbors.Points, "near_squares", lambda *_: pytest.fail("all pairs in double precision"))
        assert (neighbors.Points(x).within(x, eps) == want).all()


@pytest.mark.parametrize("dense", [False, True])
def test_weights_within_reach(dense):
    rng = np.random.default_rng(2)
    near, weight = rng.random((40, 200)) < (0.7 if dense else 0.02), rng.integers(1, 9, 200).astype(float)
    assert (neighbors._weighed(near, weight) == (near * weight).sum(axis=1)).all()


def test_links_are_one_row_per_cell_that_is_no_root(monkeypatch):
    """A line of cells a step apart hangs together: each cell but the smallest is linked with it, and edges inside a tree are not
    looked at again."""
    n = 500
    vec = np.arange(n, dtype=float)[:, None]
    ready = neighbors.Points(vec), np.arange(n, dtype=np.int64) + 7
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array([[v] for v in vec[:, 0]], pa.list_(pa.float64())), pa.array(np.arange(n) + 7), pa.array(np.ones(n, bool))], ["qid", "vec", "fine", "core"])
    monkeypatch.setattr(neighbors, "STRIP", n * 20)
    seen, roots = [], cluster._roots
    monkeypatch.setattr(cluster, "_roots", lambda size, a, b: seen.append(len(a)) or roots(size, a, b))
    rows = [r for b in cluster._core_links(1.0)(ready, batch) for r in zip(*(b.column(c).to_pylist() for c in ("fine", "near", "core")))]
    assert sorted(rows) == [(i + 7, 7, True) for i in range(1, n)]
    assert max(seen) < 100  # the edges of a strip between different trees
