"""Fitted numbers against closed forms, brute force or defining properties."""
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.operators import balance, explain, isolation, models, reduce as reducing, select, transform, tune

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3)) * [1.0, 2.0, 0.5] + [0.0, 1.0, 3.0]
    value = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=500)
    label = (x[:, 0] * x[:, 2] > 0).astype(float)
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(500), value=value, label=label, three=np.digitize(x[:, 0], [-0.4, 0.4]).astype(float))
    return spark.createDataFrame(pdf).repartition(4), pdf


def vectors(df, label="label"):
    return models.assemble(df.withColumn("label", F.col(label)), COLS, ["id", "label"])


def test_ridge_equals_closed_form(data):
    df, pdf = data
    got = {r["feature"]: r["coefficient"] for r in select.ridge(df.select(*COLS, "value"), "value", 1.0).collect()}
    x = pdf[COLS].to_numpy() - pdf[COLS].to_numpy().mean(axis=0)
    want = np.linalg.solve(x.T @ x + np.eye(3), x.T @ (pdf["value"] - pdf["value"].mean()))
    assert np.allclose([got[c] for c in COLS], want, atol=1e-6)


def test_lasso_equals_coordinate_descent(data):
    df, pdf = data
    got = {r["feature"]: r["coefficient"] for r in select.lasso(df.select(*COLS, "value"), "value", 0.05).collect()}
    x = pdf[COLS].to_numpy() - pdf[COLS].to_numpy().mean(axis=0)
    y, w, n = (pdf["value"] - pdf["value"].mean()).to_numpy(), np.zeros(3), 500
    for _ in range(500):
        for j in range(3):
            r = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - 0.05, 0) / (x[:, j] @ x[:, j] / n)
    assert np.allclose([got[c] for c in COLS], w, atol=1e-4)


def test_logistic_equals_newton(data):
    df, pdf = data
    model = models.train("logistic_regression", vectors(df), COLS).model
    x = np.c_[pdf[COLS].to_numpy(), np.ones(500)]
    y, w = pdf["label"].to_numpy(), np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose(model.coefficients.toArray(), w[:3], atol=1e-3)


def test_boxcox_lambda_maximises_likelihood(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(1.0, 0.6, 3000)) ** 1.5
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = transform.fit_boxcox(df, ["x"])["x"]

    def likelihood(lam):
        y = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    grid = np.linspace(-2, 2, 40001)
    assert abs(got - grid[np.argmax([likelihood(g) for g in grid[::50]]) * 50]) < 0.01
    assert transform.fit_boxcox(df.withColumn("x", F.col("x") - 5), ["x"]) == {}


# Shapley values --------------------------------------------------------------------------------------
def _expected(tree, x, known, node=0):
    """Value of a tree when only some features are known: unknown splits average over their children."""
    if tree["left"][node] < 0:
        return tree["values"][node]
    f, left, right = tree["feature"][node], tree["left"][node], tree["right"][node]
    if f in known:
        return _expected(tree, x, known, left if x[f] <= tree["split"][node][0] else right)
    wl, wr = tree["cover"][left], tree["cover"][right]
    return (wl * _expected(tree, x, known, left) + wr * _expected(tree, x, known, right)) / (wl + wr)


@pytest.mark.parametrize("name,task,label", [
    ("random_forest", "classification", "label"), ("xgboost", "classification", "label"), ("decision_tree", "regression", "value"), ("random_forest", "regression", "value")])
def test_tree_contributions_equal_enumeration(data, name, task, label):
    df, pdf = data
    rows = vectors(df, label)
    model = models.train(name, rows, COLS, task, {"n_estimators": 4, "max_depth": 4})
    out = explain.tree_contributions(model, rows, "id").toPandas()
    total = out.groupby("id")["contribution"].sum() + out.groupby("id")["base_value"].first()
    scored = model.model.transform(rows).select("id", "prediction", *([F.col("rawPrediction")] if task == "classification" else [])).toPandas().set_index("id")
    if task == "regression":
        want = scored["prediction"]
    elif name == "xgboost":
        want = scored["rawPrediction"].map(lambda v: v[1])
    else:
        want = scored.apply(lambda r: r["rawPrediction"][int(r["prediction"])] / sum(r["rawPrediction"]), axis=1)
    assert np.allclose(total.sort_index(), want.sort_index(), atol=1e-9)
    trees = explain.tree_nodes(model, df.sparkSession)
    for i in (0, 7):
        x, pick = pdf.loc[i, COLS].to_numpy(), 0
        if task == "classification" and name != "xgboost":
            pick = int(scored.loc[i, "prediction"])
        phi = np.zeros(3)
        for order in permutations(range(3)):
            for j in range(3):
                with_f = sum(_expected(t, x, set(order[:j + 1]))[pick] for t in trees)
                without = sum(_expected(t, x, set(order[:j]))[pick] for t in trees)
                phi[order[j]] += (with_f - without) / 6
        got = out[out["id"] == i].set_index("feature")["contribution"]
        assert np.allclose([got[c] for c in COLS], phi, atol=1e-9)


def test_sampled_contributions_are_exact_for_a_linear_model(data):
    df, _ = data
    rows = vectors(df, "value")
    model = models.train("linear_regression", rows, COLS, "regression")
    means = explain.vector_means(rows)
    a = explain.contributions(model, rows, "id").toPandas().set_index(["id", "feature"])
    b = explain.sampled_contributions(model, rows, "id", means, 2).toPandas().set_index(["id", "feature"])
    assert np.allclose(a["contribution"].sort_index(), b["contribution"].sort_index(), atol=1e-9)
    assert np.allclose(a["base_value"].sort_index(), b["base_value"].sort_index(), atol=1e-9)


def test_any_model_is_explained_exactly_or_with_its_error(data, monkeypatch):
    df, _ = data
    rows = vectors(df, "value").limit(25)
    model = models.train("decision_tree", vectors(df, "value"), COLS, "regression", {"max_depth": 4})
    means = explain.vector_means(rows)
    exact = explain.sampled_contributions(model, rows, "id", means).toPandas().set_index(["id", "feature"]).sort_index()
    said = model.predict(rows).toPandas().set_index("id")["prediction"]
    assert (exact["std_error"] == 0).all()
    assert np.allclose(exact.groupby("id")["contribution"].sum() + exact.groupby("id")["base_value"].first(), said, atol=1e-9)
    monkeypatch.setattr(explain, "ENUMERATED", 0)
    drawn = explain.sampled_contributions(model, rows, "id", means, tolerance=0.05).toPandas().set_index(["id", "feature"]).sort_index()
    assert np.allclose(drawn.groupby("id")["contribution"].sum() + drawn.groupby("id")["base_value"].first(), said, atol=1e-9)
    off = (drawn["contribution"] - exact["contribution"]).to_numpy()
    total = exact.groupby("id")["contribution"].sum()
    assert np.sqrt((drawn["std_error"] ** 2).mean()) <= 0.05 * np.sqrt((total**2).mean()) + 1e-12
    assert np.sqrt((off**2).mean()) <= 3 * np.sqrt((drawn["std_error"] ** 2).mean()) + 1e-9


def test_coalitions_of_a_softmax_are_scored_without_copies_of_rows(data, monkeypatch):
    df, _ = data
    twice = vectors(df, "three").unionByName(vectors(df, "three").filter("id < 20"))
    model = models.train("logistic_regression", vectors(df, "three"), COLS)
    means = explain.vector_means(twice)
    found = explain.sampled_contributions(model, twice, "id", means)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1  # a row per key; and no rows per coalition
    assert "explode([[" not in plan
    got = found.toPandas().set_index(["id", "feature"]).sort_index()
    monkeypatch.setattr(explain, "_softmax_weights", lambda _: None)
    want = explain.sampled_contributions(model, twice, "id", means).toPandas().set_index(["id", "feature"]).sort_index()
    assert len(got) == 1500 and (got["std_error"] == 0).all()
    assert np.allclose(got[["contribution", "base_value"]], want[["contribution", "base_value"]], atol=1e-12)


def test_what_if_treats_bad_values_as_zero(spark, data):
    df, _ = data
    rows = vectors(df, "value")
    model = models.train("linear_regression", rows, COLS, "regression")
    asked = spark.createDataFrame([(1, "1.5", "oops")], "id long, a string, b string")
    out = explain.what_if(model, asked, "id", explain.vector_means(rows)).first()
    coef = model.model.coefficients.toArray()
    assert abs(out["prediction"] - (1.5 * coef[0] + model.model.intercept)) < 1e-9
    assert abs(out["base_value"] + sum(c["contribution"] for c in out["contributions"]) - out["prediction"]) < 1e-9


# reduction ---------------------------------------------------------------------------------------------
def test_pca_equals_svd(data):
    df, pdf = data
    p = reducing.fit_pca(df.select("id", *COLS), 2, exclude=["id"])
    x = pdf[COLS].to_numpy() - pdf[COLS].to_numpy().mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(p.explained, (s ** 2 / (s ** 2).sum())[:2], atol=1e-9)
    scores = p.apply(df.select("id", *COLS)).toPandas().sort_values("id")[["PC1", "PC2"]].to_numpy()
    assert np.allclose(np.abs(scores), np.abs(x @ vt[:2].T), atol=1e-8) and np.allclose(scores.mean(axis=0), 0, atol=1e-8)
    assert len(reducing.fit_pca(df.select(*COLS), None, 0.9999).names) == 3


def test_lda_separates_with_unit_variance_inside_classes(data):
    df, pdf = data
    p = reducing.fit_lda(df.select("id", *COLS, "three"), "three", exclude=["id"])
    out = p.apply(df.select("id", *COLS, "three")).toPandas()
    z = out[["LD1", "LD2"]] - out.groupby("three")[["LD1", "LD2"]].transform("mean")
    assert np.allclose((z.T @ z) / (500 - 3), np.eye(2), atol=1e-6)
    assert np.allclose(out[["LD1", "LD2"]].mean(), 0, atol=1e-8) and abs(sum(p.explained) - 1) < 1e-9


# outliers and balance ------------------------------------------------------------------------------------
def test_isolation_forest_flags_the_share_and_the_planted_row(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(1000), "a": rng.normal(size=1000), "b": rng.normal(size=1000)})
    pdf.loc[17, ["a", "b"]] = [40.0, -40.0]
    df = spark.createDataFrame(pdf)
    out = isolation.isolation_flags(df, ["a", "b"], 0.05, "id").toPandas()
    assert abs(out["is_outlier"].sum() - 50) <= 2 and out.set_index("id").loc[17, "is_outlier"]
    assert out["anomaly_score"].idxmax() == out.index[out["id"] == 17][0]
    many = isolation.fit_isolation_forest(df, ["a", "b"], trees=10, sample=32)
    assert len(many.trees) == 10


def test_new_rows_lie_between_rows_of_their_class(spark, data):
    df, pdf = data
    small = df.withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    out = balance.smote(small, "id", COLS, "label").toPandas()
    assert (out["label"] == 1).sum() == (out["label"] == 0).sum()
    minority = pdf[pdf["id"] % 10 == 0][COLS].to_numpy()
    made = out[out["synthetic"]]
    for _, r in made.head(60).iterrows():
        p, origin = r[COLS].to_numpy(float), pdf.loc[int(r["id"].split("#")[0]), COLS].to_numpy(float)
        gaps = np.linalg.norm(minority - p, axis=1) + np.linalg.norm(origin - p) - np.linalg.norm(minority - origin, axis=1)
        assert np.sort(np.abs(gaps))[0] < 1e-9
    assert balance.rebalance(small, "id", COLS, "label", "none of these").count() == 500
    grown = balance.adasyn(small, "id", COLS, "label").groupBy("label").count().toPandas().set_index("label")["count"]
    assert abs(grown[1] - grown[0]) < 60
    one_feature = balance.smote(small, "id", ["a"], "label")
    assert one_feature.filter("label = 1").count() == one_feature.filter("label = 0").count()


# training --------------------------------------------------------------------------------------------------
def test_a_failing_model_leaves_the_others(data):
    df, _ = data
    rows = vectors(df, "three")
    fitted = models.train_many(["decision_tree", "nothing", "svm"], rows, COLS, params={"svm": {"max_iter": 10}})
    scores = models.evaluate_many(fitted, rows, "classification")
    assert "error" in scores["nothing"] and scores["decision_tree"]["rank"] == 1 and scores["decision_tree"]["accuracy"] > 0.95
    probabilities = fitted["svm"].predict(rows).select(F.aggregate("scores", F.lit(0.0), lambda a, v: a + v).alias("s")).toPandas()["s"]
    assert np.allclose(probabilities, 1.0)
    with pytest.raises(ValueError):
        models.train("linear_regression", rows, COLS, "classification")


def test_kmeans_beats_random_assignment(data):
    df, pdf = data
    rows = vectors(df)
    model = models.train("kmeans", rows, COLS, "clustering", {"n_init": 2})
    x = pdf[COLS].to_numpy()
    lab = np.random.default_rng(0).integers(0, 3, 500)
    random_cost = sum(((x[lab == c] - x[lab == c].mean(axis=0)) ** 2).sum() for c in range(3))
    assert model.model.summary.trainingCost < random_cost


def test_search_is_no_worse_than_the_default_on_the_same_folds(data):
    df, _ = data
    rows = vectors(df).persist()
    base = tune.cross_validate("decision_tree", rows, COLS, "id", method="stratified", k=3, params={"max_depth": 10})
    found = tune.tune("decision_tree", rows, COLS, "id", method="grid", space={"max_depth": [2, 10]})
    assert found.best_score >= round(base.mean, 4) - 1e-9 and len(found.trials) == 2
    timed = tune.cross_validate("decision_tree", rows, COLS, "id", method="timeseries", k=3, order=["id"])
    assert len(timed.scores) == 3
    with pytest.raises(ValueError):
        tune.tune("decision_tree", rows, COLS, "id", method="grid")
    rows.unpersist()


def test_proposals_move_towards_good_trials():
    rng, space = np.random.default_rng(1), {"C": ("log", 0.001, 100.0)}
    trials = []
    for _ in range(40):
        p = tune.propose(space, trials, rng)
        trials.append((p, -abs(np.log10(p["C"]) - 1.0)))
    assert np.mean([s for _, s in trials[-10:]]) > np.mean([s for _, s in trials[:5]])
