"""Order, quantile and neighbour building blocks against plain numpy / pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from loomtab.functions.ordering import hash_cuts, row_index, running_total
from loomtab.functions.quantiles import exact_quantiles
from loomtab.operators import cluster, features, neighbors, profile, split


@pytest.fixture(scope="module")
def skewed(spark):
    """4 000 rows of which a third share one value and one group."""
    rng = np.random.default_rng(7)
    n = 4000
    hot = rng.random(n) < 0.34
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(hot, 0, rng.integers(1, 40, n)), "x": np.where(hot, 5.0, rng.normal(0, 10, n)), "y": rng.exponential(3.0, n),
    })
    pdf.loc[::17, "y"] = np.nan
    return spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(6), pdf


def test_selection_finds_exact_quantiles(spark, skewed, monkeypatch):
    from loomtab.functions import quantiles
    df, pdf = skewed
    monkeypatch.setattr(quantiles, "FEW_VALUES", 20)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"x": probs, "y": probs})
    for c in ("x", "y"):
        want = np.quantile(pdf[c].dropna(), probs)
        assert np.allclose(got[c], want, rtol=1e-12)
    ends = df.select("id").withColumn("v", F.when(F.col("id") < 1000, float("-inf")).when(F.col("id") >= 3500, float("inf")).otherwise(F.exp(F.col("id") / 100.0)))
    assert exact_quantiles(ends, {"v": [0.1, 0.5, 1.0]})["v"] == [float("-inf"), np.quantile(np.exp(np.arange(4000) / 100.0), 0.5), float("inf")]
    assert exact_quantiles(df.withColumn("e", F.lit(None).cast("double")), {"e": [0.5]}) == {"e": [None]}


def test_row_index_equals_global_row_number(skewed):
    df, _ = skewed
    got = row_index(df, ["x", "id"]).select("id", "row_index").toPandas().set_index("id")["row_index"]
    want = df.withColumn("r", F.row_number().over(W.orderBy("x", "id")) - 1).select("id", "r").toPandas().set_index("id")["r"]
    assert (got.sort_index() == want.sort_index()).all()


def test_row_index_within_groups_with_missing_key(skewed):
    df, _ = skewed
    df = df.withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    got = row_index(df, ["x", "id"], ["g"]).select("id", "row_index").toPandas().set_index("id")["row_index"]
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("x", "id")) - 1).select("id", "r").toPandas().set_index("id")["r"]
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all()


def test_running_total(skewed):
    df, pdf = skewed
    got = running_total(df.select("id", "g"), ["id"], {"before": "g"}).toPandas().sort_values("id")
    assert (got["before"].to_numpy() == pdf["g"].cumsum().shift(fill_value=0).to_numpy()).all()


def test_hash_cuts_give_exact_sizes_per_group(skewed):
    df, pdf = skewed
    parts = split.split(df, "id", "stratified", "g", 0.2, 0.1).groupBy("g", "part").count().toPandas()
    wide = parts.pivot(index="g", columns="part", values="count").fillna(0)
    n = wide.sum(axis=1)
    assert (wide["test"] == np.ceil(n * 0.2 - 1e-9)).all()
    assert (wide["val"] == np.ceil((n - wide["test"]) * 0.125 - 1e-9)).all()
    zero = hash_cuts(df, "id", 1, lambda n: [F.lit(0)]).first()
    assert zero["cut_0"] == "" and zero["n_rows"] == len(pdf)


def test_membership_does_not_depend_on_layout(skewed):
    df, _ = skewed
    a = {r["id"] for r in split.split(df, "id").filter("part = 'test'").collect()}
    b = {r["id"] for r in split.split(df.repartition(3).orderBy("y"), "id").filter("part = 'test'").collect()}
    assert a == b


def test_auc_many_scores_uses_range_partitions(skewed, monkeypatch):
    from loomtab.operators import metrics
    df, pdf = skewed
    data = df.select((F.col("id") % 3 == 0).cast("int").alias("label"), F.col("x").alias("score"))
    want = metrics.auc_binary(data).first()[0]
    monkeypatch.setattr(metrics, "ORDERED_SCORES", 10)
    assert metrics.auc_binary(data).first()[0] == want
    pos, neg = pdf[pdf.id % 3 == 0].x.to_numpy(), pdf[pdf.id % 3 != 0].x.to_numpy()
    brute = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert abs(want - brute) < 1e-4


@pytest.mark.parametrize("within", [[], ["g"]])
def test_rolling_over_buckets_equals_plain_windows(skewed, within):
    df, _ = skewed
    df = df.select("id", "g", "y")
    got = features.add_rolling(df, ["id"], ["y"], within=within, bucket_rows=97).toPandas().sort_values("id")
    frame = W.partitionBy(*within).orderBy("id")
    want = df.select("*", *features._rolling_exprs(["y"], features.WINDOWS, frame)).toPandas().sort_values("id")
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9), c


def test_bias_corrected_shape_equals_pandas(skewed):
    df, pdf = skewed
    got = profile.numeric_summary(df, ["x", "y"]).toPandas().set_index("column")
    for c in ("x", "y"):
        assert abs(got.loc[c, "skewness"] - pdf[c].skew()) < 1e-4
        assert abs(got.loc[c, "kurtosis"] - pdf[c].kurtosis()) < 1e-4


# neighbours ------------------------------------------------------------------------------------------
def _points(copies=True):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(600, 3)) + rng.integers(0, 4, (600, 1)) * 4
    if copies:
        data[::3] = data[0]  # a third of all rows are one point
    return data


def _brute(data, k, skip=True):
    d = np.zeros((len(data), len(data)))
    for j in range(data.shape[1]):
        d += (data[:, j, None] - data[None, :, j]) ** 2
    d = np.round(np.sqrt(d), neighbors.DISTANCE_DIGITS)
    if skip:
        np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("chunk", [4096, 40])
def test_knn_join_is_exact_with_hot_copies(spark, chunk):
    data = _points()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, a double, b double, c double")
    out = neighbors.knn_join(df, "id", ["a", "b", "c"], 4, chunk=chunk, max_cells=12).toPandas().sort_values(["id", "rank"])
    d, want = _brute(data, 4)
    got = out["neighbor"].to_numpy().reshape(len(data), 4)
    assert (np.take_along_axis(d, got, 1) == np.take_along_axis(d, want, 1)).all()
    assert (got == want).all()


@pytest.mark.parametrize("chunk", [4096, 30])
def test_knn_impute_with_gaps_is_exact(spark, chunk):
    data = _points(copies=False)[:250]
    rng = np.random.default_rng(5)
    data[rng.random(data.shape) < 0.12] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = neighbors.knn_impute(df, ["a", "b", "c"], 5, key="id", chunk=chunk).toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    dist = np.round(neighbors._distances(data, data), neighbors.DISTANCE_DIGITS)
    np.fill_diagonal(dist, np.nan)
    for i, j in zip(*np.nonzero(np.isnan(data))):
        able = np.flatnonzero(~np.isnan(data[:, j]) & ~np.isnan(dist[i]))
        best = able[np.argsort(dist[i, able], kind="stable")[:5]]
        want = data[best, j].mean() if len(best) else np.nanmean(data[:, j])
        assert abs(got[i, j] - want) < 1e-9
    assert not np.isnan(got).any()


@pytest.mark.parametrize("chunk", [4096, 25])
def test_radius_counts_and_dbscan(spark, chunk):
    data = _points()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, a double, b double, c double")
    eps, need = 0.7, 5
    d, _ = _brute(data, 1, skip=False)
    near = d <= eps
    counts = neighbors.eps_counts(df, "id", ["a", "b", "c"], eps, chunk).toPandas().sort_values("id")["n_within"].to_numpy()
    assert (counts == near.sum(axis=1)).all()
    core = near.sum(axis=1) >= need
    label, n = np.full(len(data), -1), 0
    for i in range(len(data)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                p = todo.pop()
                for q in np.flatnonzero(near[p]):
                    if label[q] < 0:
                        label[q] = n
                        if core[q]:
                            todo.append(q)
            n += 1
    got = cluster.dbscan(df, "id", ["a", "b", "c"], eps, need, chunk).toPandas().sort_values("id")["cluster"].to_numpy()
    assert n > 1 and (got == label).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120) if i != 60], "a string, b string")
    out = {r["node"]: r["component"] for r in cluster.connected_components(edges).collect()}
    assert out["n060"] == "n000" and out["n120"] == "n061"


def test_quantiles_of_extreme_and_uneven_values(spark):
    import numpy as np
    from loomtab.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(5)
    wide = np.concatenate([rng.standard_normal(3000) * 1e308 / 4, [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0]])
    heavy = np.concatenate([np.exp(rng.standard_normal(3000) * 100), np.full(1600, 0.125), -np.exp(rng.standard_normal(40) * 200)])
    n = min(len(wide), len(heavy))
    rng.shuffle(wide), rng.shuffle(heavy)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(wide[:n], heavy[:n])], "a double, b double")
    asked = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"a": asked, "b": asked})
    for c, values in (("a", wide[:n]), ("b", heavy[:n])):
        order = np.sort(values)
        for p, v in zip(asked, got[c]):
            at = (n - 1) * p
            low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
            assert low <= v <= high, (c, p)


def test_duplicates_by_row_hash_tell_gaps_apart(spark):
    from loomtab.operators.profile import duplicate_rows, overview
    rows = [(None, "a"), ("a", None), ("a", "a"), (None, None), ("a", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert tuple(duplicate_rows(df).first()) == (6, 2)
    assert overview(df).first()["total_missing"] == 7


def test_profiles_of_empty_columns(spark):
    from loomtab.operators.profile import histogram, iqr_outliers
    df = spark.createDataFrame([(None, None)], "x double, y double")
    assert histogram(df).count() == 0 and iqr_outliers(df).count() == 0


def test_named_columns_are_all_used(spark):
    from loomtab.operators.features import add_interactions
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(float(i) for i in range(10))], ", ".join(f"{n} double" for n in names))
    assert len(add_interactions(df, names).columns) == 10 + 45
    assert len(add_interactions(df).columns) == 10 + 28


def test_labels_of_any_kind(spark):
    from loomtab.operators.balance import smote
    from loomtab.operators.roles import prepare_label
    df = spark.createDataFrame([(i, [3, 7, -1][i % 3], float(i % 5), float(i % 7)) for i in range(30)], "id long, y int, a double, b double")
    out, classes = prepare_label(df, "y", "classification")
    assert classes == ["-1", "3", "7"] and {(r.y, r.label) for r in out.collect()} == {(-1, 0.0), (3, 1.0), (7, 2.0)}
    kept, none = prepare_label(df.selectExpr("id % 3 as y"), "y", "classification")
    assert none is None and {r.label for r in kept.collect()} == {0.0, 1.0, 2.0}
    text = df.selectExpr("id", "a", "b", "case when id % 5 = 0 then 'rare' else 'usual' end as kind")
    counts = {r["kind"]: r["count"] for r in smote(text, "id", ["a", "b"], "kind").groupBy("kind").count().collect()}
    assert counts == {"rare": 24, "usual": 24}
