"""Trees over cells of rows: the same as over the rows themselves, where their bins are."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomtab.operators import cells, explain, models, tune
from loomtab.sources.models import load_model, save_model

N = 6000


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.choice([-3.5, 0.0, 1.0, 2.0, 40.0, 41.0, 1e6], N), rng.integers(0, 11, N) / 8], axis=1)
    sure = (x[:, 0] > 1) ^ (x[:, 1] > 0.6)
    pdf = pd.DataFrame({"id": np.arange(N), "class": (sure ^ (rng.random(N) < 0.2)).astype(float), "three": ((x[:, 1] * 8) // 4),
                        "value": sure * 100.0 + x[:, 1] + rng.normal(size=N) + 1e6, "x": x.tolist()})
    return spark.createDataFrame(pdf).select("id", "class", "three", "value", array_to_vector("x").alias("features")).repartition(3).persist()


def of(rows, label):
    return rows.select("id", F.col(label).alias("label"), "features")


def said(model, rows):
    return model.predict(rows).orderBy("id").select("prediction", "scores").toPandas()


@pytest.mark.parametrize("name,task,label,params", [
    ("decision_tree", "classification", "class", {"max_depth": 4}), ("decision_tree", "regression", "value", {"max_depth": 4, "min_samples_leaf": 40}),
    ("xgboost", "classification", "class", {"n_estimators": 4, "max_depth": 3}), ("lightgbm", "regression", "value", {"n_estimators": 4, "max_depth": 3}),
    ("xgboost", "classification", "three", {"n_estimators": 2, "max_depth": 2})])
def test_cells_give_the_trees_of_the_rows(spark, rows, monkeypatch, name, task, label, params):
    data = of(rows, label)
    plain = models.train(name, data, ["a", "b"], task, params)
    monkeypatch.setattr(cells, "LEAST", 0)
    fits = []
    points = cells.points
    monkeypatch.setattr(cells, "points", lambda *a: fits.append(points(*a)) or fits[-1])
    celled = models.train(name, data, ["a", "b"], task, params)
    assert len(fits) == 1  # not fitted on the rows
    a, b = said(plain, data), said(celled, data)
    assert np.allclose(a["prediction"], b["prediction"], rtol=1e-9)
    assert np.allclose(np.array(a["scores"].tolist()), np.array(b["scores"].tolist()), atol=1e-9)
    assert type(plain.model) is type(celled.model) and plain.n_samples == celled.n_samples
    assert np.allclose([v for _, v in sorted(models.importances(plain))], [v for _, v in sorted(models.importances(celled))], atol=1e-5)
    if label != "three":
        path = models_path(spark)
        save_model(celled, spark, path)
        assert np.array_equal(said(load_model(spark, path), data)["prediction"], b["prediction"])
        found = explain.contributions(celled, data.limit(20), "id").groupBy("id").agg(F.count("*").alias("n")).collect()
        assert len(found) == 20 and all(r.n == 2 for r in found)


def models_path(spark):
    from loomtab.functions.staging import new_path
    return new_path(spark, "model")


@pytest.mark.parametrize("task,label", [("classification", "class"), ("regression", "value")])
def test_forest_of_cells(rows, monkeypatch, task, label):
    data = of(rows, label)
    params = {"n_estimators": 30, "max_depth": 5}
    plain = models.evaluate(models.train("random_forest", data, ["a", "b"], task, params), data)
    monkeypatch.setattr(cells, "LEAST", 0)
    model = models.train("random_forest", data, ["a", "b"], task, params)
    celled, score = models.evaluate(model, data), models.PRIMARY[task]
    assert abs(plain[score] - celled[score]) < 0.02 and len(model.model.trees) == 30
    roots = [t._call_java("rootNode").impurityStats().count() for t in model.model.trees]
    assert len(set(roots)) > 20 and abs(np.mean(roots) - N) < 5 * np.sqrt(N / 30)  # a bootstrap sample each
    assert abs(np.std(roots) - np.sqrt(N)) < np.sqrt(N) / 2
    again = models.train("random_forest", data.repartition(5), ["a", "b"], task, params)
    assert np.allclose(said(model, data)["prediction"], said(again, data)["prediction"], rtol=1e-6)


def test_folds_and_weights_of_points(spark, rows, monkeypatch):
    for task, label in (("classification", "class"), ("regression", "value")):
        ask = lambda: tune.tune("decision_tree", of(rows, label), ["a", "b"], "id", task, "grid", {"max_depth": [1, 3], "min_samples_leaf": [1, 50]}).trials
        monkeypatch.setattr(cells, "LEAST", N * 10)
        plain = ask()
        monkeypatch.setattr(cells, "LEAST", 0)
        binned = []
        monkeypatch.setattr(cells.grower, "bin_rows", lambda *a: binned.append(a))
        assert [p for p, _ in ask()] == [p for p, _ in plain] and np.allclose([s for _, s in ask()], [s for _, s in plain], atol=1e-6) and not binned
        monkeypatch.undo()


def test_points_keep_counts_and_moments(spark, rows, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 10)
    monkeypatch.setattr(cells, "ROWS", 500)
    edges = {"": [np.array([0.5, 1.5, 30.0]), np.array([0.3])]}
    pdf = rows.toPandas()
    x = np.array([v.toArray() for v in pdf["features"]])
    cell = np.searchsorted(edges[""][0], x[:, 0]) * 2 + np.searchsorted(edges[""][1], x[:, 1])
    for dense in (1 << 22, 1):
        monkeypatch.setattr(cells, "DENSE", dense)
        for label, classes in (("three", 3), ("value", 0)):
            table = cells.points(of(rows, label).select(F.lit("").alias("rows"), (F.col("id") % 2).cast("int").alias("fold"), "label", "features"), edges, classes)
            got = {}
            for batch in table.toArrow().to_batches():
                for _, fold, _, y, bins, weight in cells.grower._by_part(batch):
                    for f, v, b, w in zip(fold, y, bins, weight):
                        got.setdefault((f, b[0] * 2 + b[1]), []).append((v, w))
            for (f, c), parts in got.items():
                y = pdf[label][(cell == c) & (pdf["id"] % 2 == f)]
                v, w = np.array(parts).T
                assert np.isclose(w.sum(), len(y)) and np.isclose((w @ v) / w.sum(), y.mean())
                assert np.isclose(np.sqrt(w @ (v - y.mean()) ** 2 / len(y)), y.std(ddof=0), rtol=1e-6, atol=1e-6)
            assert len(got) == len(set(zip(pdf["id"] % 2, cell)))


def test_tables_of_many_cells_are_left_alone(spark, rows, monkeypatch):
    monkeypatch.setattr(cells, "LEAST", 0)
    monkeypatch.setattr(cells, "points", lambda *a: 1 / 0)
    wide = rows.select("id", F.col("class").alias("label"), array_to_vector(F.array(*[F.rand(i) for i in range(3)])).alias("features"))
    assert models.train("decision_tree", wide, ["a", "b", "c"]).model.depth > 1
