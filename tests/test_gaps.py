"""Nearest rows among rows with missing numbers: the distances of a row serve everything it needs."""

import numpy as np
import pyarrow as pa
import pytest

from loomtab.operators import neighbors


def _asked(points, queries, needs, k):
    """What a task answers: (qid, need) -> [(distance, id)]."""
    answer = neighbors._top_k(k, True)
    ids = np.arange(len(points), dtype=np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(queries), dtype=np.int64)), pa.array(needs, pa.list_(pa.int32())), pa.array([list(r) for r in queries], pa.list_(pa.float64()))], ["qid", "needs", "vec"])
    out = {}
    for found in answer((ids, points, bool(np.isnan(points).any())), batch):
        for qid, need, i, dist in zip(*(found.column(c).to_pylist() for c in ("qid", "need", "id", "dist"))):
            out.setdefault((qid, need), []).append((dist, i))
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "rare", "large", "infinite", "far"])
def test_several_needs_of_a_row_are_answered_as_by_brute_force(kind):
    rng, dims, k = np.random.default_rng(3), 6, 5
    data = rng.normal(size=(400, dims))
    if kind == "ties":
        data = np.floor(data)
    if kind == "large":
        data *= 1e160
    if kind == "far":
        data += 1e7
    data[rng.random(data.shape) < 0.25] = np.nan
    if kind == "rare":
        data[rng.random(400) < 0.95, 2] = np.nan
    if kind == "infinite":
        data[7, 1] = np.inf
    data[11] = np.nan
    needs = [np.flatnonzero(np.isnan(r)).tolist() for r in data]
    with np.errstate(all="ignore"):
        dist = np.round(neighbors._distances(data, data), neighbors.DISTANCE_DIGITS)
    np.fill_diagonal(dist, np.nan)
    got = _asked(data, data, needs, k)
    for i, own in enumerate(needs):
        for j in own:
            able = np.flatnonzero(~np.isnan(data[:, j]) & np.isfinite(dist[i]))
            want = able[np.argsort(dist[i, able], kind="stable")[:k]].tolist()
            assert [c for _, c in got.get((i, j), [])] == want, (kind, i, j)


def test_a_row_with_many_gaps_visits_a_cell_once(spark, monkeypatch):
    data = np.random.default_rng(4).normal(size=(60, 8))
    data[:, :5][np.random.default_rng(5).random((60, 5)) < 0.5] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)], "id long, " + ", ".join(f"c{j} double" for j in range(8)))
    visits, real = [], neighbors.blocked
    monkeypatch.setattr(neighbors, "blocked", lambda queries, *rest: visits.append(queries.count()) or real(queries, *rest))
    assert neighbors.knn_impute(df, [f"c{j}" for j in range(8)], 5, key="id").count() == 60
    assert visits == [int(np.isnan(data).any(axis=1).sum())]  # one row per row with gaps, not one per gap
