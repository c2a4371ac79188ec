"""Neighbours by inner product against brute force, the chi-square stop, odd vectors."""
import math

import numpy as np
from pyspark.sql import functions as F

from loomtab.llm import projected as P


def true_neighbours(rows, asks, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in good:
        if asks(q):
            found = sorted((-float(np.einsum("d,d->", a, b)), c) for c, b in good if len(a) == len(b) and (c != q or (a != b).any()))
            out[q] = [(c, -s) for s, c in found[:k]]
    return out


def clustered(rng, n, d):
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2, (n, 1))
    for i in range(0, n - 10, 10):
        x[i + 1 : i + 8] = x[i] + 0.3 * rng.standard_normal((7, d))
    x[-n // 6 :] = x[0] + 0.02 * rng.standard_normal((len(x[-n // 6 :]), d))  # a dense group
    return x.astype(np.float32)


def test_chi_square():
    rng = np.random.default_rng(0)
    square = (rng.standard_normal((200_000, P.DIMS)) ** 2).sum(axis=1)
    for p in (0.5, 0.9, 0.99):
        assert abs((square <= P.quantile(p)).mean() - p) < 0.005
        assert abs(P.chi_square(P.quantile(p)) - p) < 1e-9
    # closed form for two degrees of freedom
    assert math.isclose(P.quantile(0.9, 2), -2 * math.log(0.1), rel_tol=1e-9)


def test_search_of_a_cell_stops_early_and_finds_enough():
    rng = np.random.default_rng(1)
    x = clustered(rng, 6000, 32).astype(float)
    projection = P.Projection(32, float((x * x).sum(axis=1).max()))
    cell = P.Cell(np.arange(len(x)), x, projection)
    assert sorted(cell.members[cell.members < len(x)].tolist()) == list(range(len(x)))
    asked = rng.permutation(len(x))[:200]
    true = np.sort(x[asked] @ x.T, axis=1)[:, ::-1][:, :20]
    seen = []
    for confidence in (0.5, 0.95, 1 - 1e-12):
        place, score = cell.nearest(x[asked], np.full(200, -np.inf), 20, P.quantile(confidence))
        assert (np.diff(score, axis=1) <= 0).all() and np.allclose(score, np.einsum("qkd,qd->qk", x[place], x[asked]))
        seen.append((score >= true[:, -1:] - 1e-9).mean())
    assert seen[1] >= 0.93 and seen[0] <= seen[1] <= seen[2] == 1.0
    # a bound from elsewhere leaves only what is at least as good
    place, score = cell.nearest(x[asked], true[:, 4], 20, P.quantile(0.95))
    assert ((score >= true[:, 4:5] - 1e-12) | (place == -1)).all()


def test_table_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 150)  # several cells
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(clustered(rng, 900, 16))]
    rows += [(2000 + i, rows[40][1]) for i in range(0, 400)]  # a third are copies of a query
    rows += [(60, rows[60][1]), (60, rows[61][1])]  # a repeated row, and a key with two vectors
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(3000 + 20 * k, v) for k, v in enumerate(odd)] + [(4000, [1.0, 2.0]), (4001, [1.0, 3.0]), (4020, [5.0]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, name int").repartition(3)
    found, recall = P.nearest(df, F.col("vec_id") % 20 == 0, k=12)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    true = true_neighbours(rows, lambda i: i % 20 == 0, 12)
    true.pop(60)
    twice = got.pop(60)
    assert sorted(r for r, *_ in twice) == sorted([*range(1, 13)] * 2) and 60 in [i for _, i, _ in twice]
    assert set(got) | {4020} == set(true) and not true[4020]  # nothing else has one component
    assert [i for _, i, _ in sorted(got[4000])] == [4001]
    hits = total = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, len(true[q]) + 1)) and q not in [i for _, i, _ in own]
        assert own == [(r + 1, i, s) for r, (s, i) in enumerate(sorted(((s, i) for _, i, s in own), key=lambda x: (-x[0], x[1])))]
        exact = dict((i, s) for i, s in true_neighbours([(i, v) for i, v in rows if i in {x for _, x, _ in own} | {q}], lambda i: i == q, 99)[q]) if q not in (60,) else {}
        assert all(math.isclose(exact[i], s, rel_tol=1e-12) for _, i, s in own if i != 60)
        hits += sum(s >= true[q][-1][1] - 1e-12 for *_, s in own)
        total += len(true[q])
    assert hits >= 0.95 * total and recall >= 0.95
    # a copy's nearest, ties by key: the query itself is left out and no copy is missing
    assert [i for _, i, _ in got[2000]] == [i for i, _ in true[2000]]


def test_empty_tables_and_other_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    for part in (df, df.limit(0), df.filter("vec_id = 3")):
        found, recall = P.nearest(part, F.col("vec_id") % 20 == 0)
        assert found.count() == 0 and recall == 1.0 and found.columns == ["query_id", "rank", "vec_id", "score"]
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "name string, v array<double>")
    found, _ = P.nearest(named, F.col("name") == "c", key="name", vector="v")
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [("c", 1, "a", 0.0), ("c", 2, "b", 0.0)]
