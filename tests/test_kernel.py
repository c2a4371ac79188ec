"""Fourier features against the kernel, tube regression against brute force, machines by name, saved and reloaded."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import kernel as K, models
from loomtab.sources.models import load_model, save_model


def table(spark, x, y):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    names = [f"x{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} double" for n in names], "label double"])).repartition(3)
    return models.assemble(df, names, ["id", "label"]), names


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    df, _ = table(spark, x, np.zeros(60))
    fourier = K.fit_fourier(df, 3, "scale", 20_000)
    z = fourier.rows(x)
    gamma = 1.0 / (3 * x.var())
    true = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - true).max() < 0.05
    with pytest.raises(ValueError):
        K.fit_fourier(df, 3, "other")


def test_kernel_machine_finds_a_ring_that_a_line_cannot(spark, tmp_path):
    rng = np.random.default_rng(1)
    angle, radius = rng.uniform(0, 2 * np.pi, 400), np.where(rng.random(400) < 0.5, rng.uniform(0, 1, 400), rng.uniform(1.6, 2.4, 400))
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    df, names = table(spark, x, radius < 1.3)
    hit = lambda m: m.predict(df).filter("prediction = label").count()
    ring = models.train("svm", df, names, params={"C": 10.0})
    assert hit(ring) == 400 and hit(models.train("svm", df, names, params={"kernel": "linear"})) < 320
    assert ring.predict(df).filter("scores[cast(label as int)] > 0.5").count() == 400
    save_model(ring, spark, str(tmp_path / "ring"))
    again = load_model(spark, str(tmp_path / "ring"))
    assert hit(again) == 400 and again.calibration == ring.calibration
    with pytest.raises(ValueError):
        models.train("svm", df, names, params={"kernel": "other"})


def best_line(x, y, c, epsilon):
    """The optimum of a one-dimensional tube regression over a fine grid, then finer around the best."""
    def cost(w, b):
        return w * w / 2 + c * np.maximum(0, np.abs(y[:, None, None] - x[:, None, None] * w - b) - epsilon).sum(axis=0)

    w0, b0, wide = 0.0, 0.0, 6.0
    for _ in range(14):
        w, b = (m + wide * np.linspace(-1, 1, 41) for m in (w0, b0))
        value = cost(*np.meshgrid(w, b, indexing="ij"))
        i, j = np.unravel_index(value.argmin(), value.shape)
        w0, b0, wide = w[i], b[j], wide / 2.5
    return value.min()


def test_tube_regression_reaches_the_optimum(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, 60)
    y = 1.5 * x + 0.7 + rng.normal(0, 0.3, 60)
    y[:4] += 8  # outliers
    df, names = table(spark, x[:, None], y)
    for c, epsilon in itertools.product((0.1, 5.0), (0.0, 0.2)):
        rule = models.train("svm", df, names, "regression", {"kernel": "linear", "C": c, "epsilon": epsilon}).model
        w, b = rule.coefficients[0], rule.intercept
        own = w * w / 2 + c * np.maximum(0, np.abs(y - x * w - b) - epsilon).sum()
        assert own <= best_line(x, y, c, epsilon) * 1.01 + 1e-3, (c, epsilon)
    # a curve, by the kernel; and saved
    y = np.sin(2 * x)
    df, names = table(spark, x[:, None], y)
    model = models.train("svr", df, names, "regression", {"C": 10.0, "epsilon": 0.05, "gamma": 1.0})
    assert models.evaluate(model, df)["r2"] > 0.98
    save_model(model, spark, str(tmp_path / "curve"))
    assert models.evaluate(load_model(spark, str(tmp_path / "curve")), df) == models.evaluate(model, df)


def test_density_clusters_by_name(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(3, 0.1, (30, 2)), [[10.0, 10.0]]])
    df, names = table(spark, x, np.zeros(len(x)))
    model = models.train("dbscan", df, names, "clustering", {"eps": 0.5})
    found = {r.id: r.prediction for r in model.predict(df).collect()}
    assert len({found[i] for i in range(40)}) == 1 and len({found[i] for i in range(40, 70)}) == 1 and found[0] != found[50] and found[70] == -1
    assert models.evaluate(model, df)["silhouette"] > 0.9
    new, _ = table(spark, np.array([[0.2, 0.1], [3.1, 3.0], [50.0, 50.0]]), np.zeros(3))
    assert [r.prediction for r in model.predict(new).orderBy("id").collect()] == [found[0], found[50], -1]
    save_model(model, spark, str(tmp_path / "dense"))
    assert {r.id: r.prediction for r in load_model(spark, str(tmp_path / "dense")).predict(df).collect()} == found
    assert models.train("dbscan", df, names, "clustering", {"eps": 1e-9}).predict(df).filter("prediction <> -1").count() == 0


def test_no_table_as_wide_as_the_cosines_is_written(spark, monkeypatch):
    """A machine keeps the rows it was given, not the features made from them."""
    from loomtab.operators import blocks as B
    written = []
    keep = B.materialise
    monkeypatch.setattr(B, "materialise", lambda df, label: written.append(keep(df, label)) or written[-1])
    monkeypatch.setattr(K, "materialise", lambda df, label: written.append(keep(df, label)) or written[-1], raising=False)
    monkeypatch.setattr(models, "materialise", lambda df, label: written.append(keep(df, label)) or written[-1], raising=False)
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    y = (x[:, 0] > 0) + (x[:, 1] > 0.3) * 1.0  # three classes
    df, names = table(spark, x, y)
    model = models.train("svm", df, names, params={"C": 10.0, "n_components": 64, "max_iter": 15})
    assert len(written) == 1 and written[0].columns == ["data"]
    assert sum(len(r.data) for r in written[0].collect()) == 300 * 3 * 8
    said = model.predict(df).select("id", "label", "prediction", "scores").toPandas()
    assert (said.label == said.prediction).mean() > 0.85 and np.allclose([sum(s) for s in said.scores], 1.0)


def test_sums_over_blocks_are_those_over_rows(spark):
    from loomtab.operators import blocks as B
    x = np.arange(2000.0).reshape(1000, 2)
    df, _ = table(spark, x, np.arange(1000))
    rows = B.blocks(df)
    assert np.allclose(B.total(rows, 2, lambda k, x, y: np.array([len(y), k * x.sum(), (x[:, 0] * y).sum()]), 2.0, 3), [1000, 2 * x.sum(), (x[:, 0] * np.arange(1000)).sum()])
    big = B.total(rows, 2, lambda _, x, y: np.repeat(x.sum(axis=0), B.PIECE), None, 2 * B.PIECE)
    assert np.allclose(big, np.repeat(x.sum(axis=0), B.PIECE))
    assert B.total(B.blocks(df.limit(0)), 2, lambda *_: np.ones(1), None, 1) == [0.0]
