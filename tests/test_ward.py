"""Ward's linkage against always merging the closest pair; micro-clusters; saved and reloaded."""
import numpy as np

from loomtab.operators import cluster as C, models
from loomtab.sources.models import load_model, save_model


def closest_pairs(x, w, clusters):
    groups = [[i] for i in range(len(x))]
    while len(groups) > clusters:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = groups[i], groups[j]
                na, nb = w[a].sum(), w[b].sum()
                gap = np.average(x[a], axis=0, weights=w[a]) - np.average(x[b], axis=0, weights=w[b])
                rise = na * nb / (na + nb) * (gap @ gap)
                if best is None or rise < best[0]:
                    best = (rise, i, j)
        _, i, j = best
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_chains_give_the_tree_of_closest_pairs():
    rng = np.random.default_rng(0)
    for k in range(20):
        n = int(rng.integers(2, 40))
        x, w = rng.standard_normal((n, 3)), rng.integers(1, 5, n).astype(float)
        merges = C.ward_merges(x, w)
        for clusters in (1, 2, 3, 5, n):
            label = C.cut_merges(n, merges, clusters)
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in np.unique(label)} == closest_pairs(x, w, min(clusters, n))
            assert label[0] == 0
    assert C.ward_merges(np.zeros((1, 2)), np.ones(1)) == [] and C.cut_merges(1, [], 3).tolist() == [0]


def test_tables(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 5, 9)])
    x = np.concatenate([x, x[:40]])  # repeated rows
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = models.assemble(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], ["id"])
    found = models.train("hierarchical", df, ["a", "b"], "clustering", {"n_clusters": 3})
    label = {r.id: r.prediction for r in found.predict(df).collect()}
    points, at = np.unique(x, axis=0, return_inverse=True)
    want = closest_pairs(points, np.bincount(at).astype(float), 3)
    assert {frozenset(at[i] for i in label if label[i] == c) for c in set(label.values())} == want
    assert models.evaluate(found, df)["silhouette"] > 0.8
    save_model(found, spark, str(tmp_path / "ward"))
    assert {r.id: r.prediction for r in load_model(spark, str(tmp_path / "ward")).predict(df).collect()} == label
    monkeypatch.setattr(C, "MICRO", 30)
    few = C.fit_ward(df, 2, 3, 30)
    assert len(few.centres) <= 30
    again = {r.id: r.prediction for r in few.transform(df).collect()}
    assert {frozenset(i for i in again if again[i] == c) for c in range(3)} == {frozenset(i for i in label if label[i] == c) for c in range(3)}
