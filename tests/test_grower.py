"""Trees grown together: against a plain tree, planted rules, folds, and leak-free strategy search."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import grower as G, models, tune
from loomtab.plans import automl

COLS = ["a", "b", "c"]


def plain_tree(x, y, depth, least, classes):
    """Best splits by trying every value; a nested tuple (feature, value, left, right), or the leaf's prediction."""
    def impurity(y):
        if classes:
            return len(y) - sum((y == c).sum() ** 2 for c in range(classes)) / max(len(y), 1)
        return ((y - y.mean()) ** 2).sum() if len(y) else 0.0

    def leaf(y):
        return int(np.bincount(y.astype(int), minlength=classes).argmax()) if classes else y.mean()

    best = (1e-9 * max(impurity(y), 1e-12), None, None)
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= v
                if min(low.sum(), (~low).sum()) >= least:
                    gain = impurity(y) - impurity(y[low]) - impurity(y[~low])
                    if gain > best[0] + 1e-12:
                        best = (gain, f, v)
    if best[1] is None:
        return leaf(y)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x[low], y[low], depth - 1, least, classes), plain_tree(x[~low], y[~low], depth - 1, least, classes)


def predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def rows_of(spark, x, y, fold, rows="s"):
    data = [(rows, int(f), i, float(t), [float(v) for v in r]) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame(data, "rows string, fold int, id long, label double, v array<double>").repartition(3)
    for i, c in enumerate(COLS):
        df = df.withColumn(c, F.col("v")[i])
    return models.assemble(df, COLS, ["rows", "fold", "id", "label"])


@pytest.mark.parametrize("classes", [3, 0])
def test_a_tree_equals_the_plain_one(spark, classes, monkeypatch):
    monkeypatch.setattr(G, "HISTOGRAM", 5000)  # several passes per level
    rng = np.random.default_rng(5)
    n = 400
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 5, n)], axis=1).astype(float)
    y = ((x[:, 0] > 5) + (x[:, 1] + rng.integers(0, 4, n) > 5)).astype(float) if classes else x[:, 0] * (x[:, 2] > 2) + rng.normal(0, 1, n)
    fold = rng.integers(0, 2, n)
    binned, _ = G.bin_rows(rows_of(spark, x, y, fold), {"s": 3}, "id")
    asked = [G.Model("s", held, 1, depth, least) for held in (0, 1) for depth, least in ((1, 1), (3, 15), (4, 20))]
    G.grow(binned, {"s": 3}, asked, classes)
    found = G.score(binned, asked, classes).collect()
    for m, model in enumerate(asked):
        inside = fold != model.held
        tree = plain_tree(x[inside], y[inside], model.depth, model.least, classes)
        said = np.array([predict(tree, r) for r in x[~inside]])
        if classes:
            cells = {(r.label, r.prediction): r.n for r in found if r.model == m}
            want = {}
            for a, b in zip(y[~inside], said):
                want[float(a), float(b)] = want.get((float(a), float(b)), 0) + 1
            assert cells == want
        else:
            r = next(r for r in found if r.model == m)
            assert r.n == (~inside).sum() and r.ee == pytest.approx(((y[~inside] - said) ** 2).sum())


def test_forests_learn_and_differ_by_draw(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((1500, 3)), 2)
    y = (x[:, 0] + 0.6 * x[:, 1] > 0.8).astype(float)
    fold = rng.integers(0, 3, 1500)
    binned, _ = G.bin_rows(rows_of(spark, x, y, fold), {"s": 3}, "id")
    asked = [G.Model("s", f, 15, 5, 2, "sqrt", True, seed) for f in range(3) for seed in (1, 2)]
    G.grow(binned, {"s": 3}, asked, 2)
    scores = G.primary_scores(binned, asked, 2)
    assert min(scores) > 0.9
    assert asked[0].grown[0].cut != asked[0].grown[1].cut and asked[0].grown[0].cut != asked[1].grown[0].cut
    w = G.draws(np.arange(200_000), 17)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, G.draws(np.arange(200_000), 18))[0, 1]) < 0.01
    # one class only, and a fold without rows
    binned, _ = G.bin_rows(rows_of(spark, x[:50], np.ones(50), np.zeros(50)), {"s": 3}, "id")
    asked = [G.Model("s", 1, 2, 3), G.Model("s", 0, 2, 3)]
    G.grow(binned, {"s": 3}, asked, 2)
    assert [len(t.feature) for m in asked for t in m.grown] == [1, 1, 1, 1]
    assert G.primary_scores(binned, asked, 2)[0] == 0.0  # nothing held out


def test_candidates_that_cannot_grow_rank_last(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, 3)), 2)
    df = rows_of(spark, x, (x[:, 1] > 0.4).astype(float), np.zeros(300)).drop("rows", "fold")
    found = tune.tune("decision_tree", df, COLS, "id", method="grid", space={"max_depth": [1, 40]})
    assert [s for _, s in found.trials] == [1.0, float("-inf")] and len(found.errors) == 1
    many = tune.tune("random_forest", df, COLS, "id", method="bayesian", space={"n_estimators": ("int", 2, 4), "max_depth": ("int", 1, 3)}, n_trials=7)
    assert len(many.trials) == 7 and many.best_score > 0.95


def test_strategies_do_not_see_the_rows_they_are_scored_on(spark):
    """A text column with two rows per value says nothing about a random label, but its mean over all rows does."""
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, 600)
    rows = [(i, f"k{i // 2}", float(rng.random()), "yes" if label[i] else "no") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, name string, noise double, grade string")
    config = {"models": ["decision_tree"], "shap": False, "transformation": {"encoding": "target"}}
    result, tried = automl.auto_explore(df, "grade", config=config, key="id", folds=3, trees=10, presets=["baseline", "standard"])
    assert result.status == "completed" and [t[3] for t in tried] == ["", ""]
    assert all(abs(score - 0.5) < 0.15 for _, score, *_ in tried)
