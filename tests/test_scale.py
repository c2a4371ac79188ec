"""What one task gets stays bounded when the tables grow."""

from pyspark.sql import functions as F

from catalog import registry


def test_no_task_gets_more_rows_as_the_table_grows(spark, small, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 100)
    wide = registry.wide_table(spark, small, "lineitem")
    sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    plain = registry.table(spark, small, "lineitem")
    assert len(sizes) == -(-plain.count() // 100) and max(sizes) <= 200
    assert wide.exceptAll(plain).isEmpty() and plain.exceptAll(wide).isEmpty()


def test_small_tables_are_dealt_to_all_cores(spark, small):
    assert registry.wide_table(spark, small, "lineitem").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_isolation_samples_are_the_smallest_hashes_and_few_rows_are_sorted(spark, monkeypatch):
    from loomtab.functions.columns import shuffle_key
    from loomtab.operators import isolation
    written = []
    keep = isolation.materialise
    monkeypatch.setattr(isolation, "materialise", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    for ids, widest in (("id", 1.5), ("id % 3", None), ("cast(null as bigint)", None)):  # plain, repeated and null ids
        rows = spark.range(0, 4000, 1, 1).select(F.expr(ids).alias("id"), F.array(F.col("id").cast("double")).alias("vec"))
        got = isolation._tree_samples(rows, 4000, 3, 20, 42).select("tree", "h")
        want = []
        for t in range(3):
            want += sorted((t, r.h) for r in rows.select(shuffle_key(42, F.lit(t), F.col("id")).alias("h")).collect())[:20]
        assert sorted(map(tuple, got.collect())) == want
        if widest:
            assert written[-1][1].count() < 3 * 20 * isolation.BOUND * widest


def test_isolation_deals_a_small_file_to_all_cores(spark):
    from loomtab.operators import isolation
    one = spark.range(0, 3000, 1, 1).select("id", F.sin("id").alias("a"))
    flagged = isolation.isolation_flags(one, ["a"], key="id", trees=3)
    assert len([p for p in flagged.inputFiles()]) >= spark.sparkContext.defaultParallelism
    assert flagged.count() == 3000


def test_rows_without_a_key_are_paired_by_many_tasks(spark):
    from loomtab.operators import combine
    left = spark.range(0, 400, 1, 1).select(F.expr("case when id % 2 = 0 then null else id end").alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 300, 1, 1).select(F.expr("case when id % 3 = 0 then null else id end").alias("k"), F.col("id").alias("b"))
    for how in ("inner", "left", "right", "outer"):
        for l, r in ((left, right), (left.filter("k is not null"), right), (left, right.filter("k is not null"))):
            want = l.alias("l").join(r.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), how).select(F.coalesce("l.k", "r.k").alias("k"), "a", "b")
            got = combine.join_on(l, r, "k", how)
            assert got.columns == ["k", "a", "b"]
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    bare = combine.join_on(left, right, "k", "right").filter("k is null")
    sizes = [r["count"] for r in bare.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4_000


def test_trees_in_common_are_grown_once_and_cut_back(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from loomtab.operators import grower, tune
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    pdf = pd.DataFrame({"id": np.arange(600), "label": ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.1)).astype(float), "x": x.tolist()})
    df = spark.createDataFrame(pdf).select("id", "label", array_to_vector("x").alias("features"))
    rows = df.select(F.lit("").alias("rows"), (F.col("id") % 3).cast("int").alias("fold"), "id", "label", "features")
    binned, _ = grower.bin_rows(rows, {"": 3}, "id")
    for classes in (2, 0):
        for name in grower.GROWABLE:
            task = "classification" if classes else "regression"
            ask = lambda: [grower.forest_model(name, {"n_estimators": n, "max_depth": d, "min_samples_leaf": least}, task, "", f, 8, 10)
                           for n, d, least in ((3, 2, 1), (2, 5, 1), (2, 3, 4), (2, 5, 1)) for f in (0, 1)]
            alone, together, later = ask(), ask(), ask()
            for m in alone:
                grower.grow(binned, {"": 3}, [m], classes)
            grower.grow(binned, {"": 3}, together, classes)
            known = {}
            for m in later:
                grower.grow(binned, {"": 3}, [m], classes, known)
            for a, b, c in zip(alone, together, later):
                for t, u, v in zip(a.grown, b.grown, c.grown, strict=True):
                    assert (t.feature, t.cut, t.left, t.right, t.level) == (u.feature, u.cut, u.left, u.right, u.level) == (v.feature, v.cut, v.left, v.right, v.level)
                    assert np.allclose(np.array(t.value), np.array(u.value)) and np.allclose(np.array(t.value), np.array(v.value))
            assert sum(len(w.grown) for w in known.values()) == (10 if name == "random_forest" else 4)
    binnings, passes = [], []
    bin_rows, grow_open = grower.bin_rows, grower._grow_open
    monkeypatch.setattr(grower, "bin_rows", lambda *a: binnings.append(a) or bin_rows(*a))
    monkeypatch.setattr(grower, "_grow_open", lambda *a: passes.append(a[2]) or grow_open(*a))
    space = {"max_depth": ("int", 1, 3), "min_samples_leaf": ("int", 1, 2)}
    found = tune.tune("decision_tree", df, ["a", "b", "c"], "id", method="bayesian", space=space, n_trials=12)
    assert len(found.trials) == 12 and len(binnings) == 1 and all(len(p) <= 6 for p in passes)


def test_rows_of_one_pattern_are_explained_once(monkeypatch):
    import numpy as np
    from loomtab.operators import explain
    rng = np.random.default_rng(5)
    data = rng.random((3000, 4))
    rule = lambda cut: (np.array([cut]), False)
    leaves = [(np.array([0.2, 0.8]), [(0, 0.3, [(rule(0.3), True)]), (2, 0.6, [(rule(0.4), False), (rule(0.9), True)]), (3, 0.5, [(rule(0.5), True)])]),
              (np.array([0.7, 0.3]), [(1, 0.25, [(rule(0.75), False)])])]
    seen = []
    gains = explain._gains
    monkeypatch.setattr(explain, "_gains", lambda hits, shares: seen.append(len(hits)) or gains(hits, shares))
    many = explain._leaf_contributions(data, leaves, 2)
    assert seen == [8, 2]
    each = np.concatenate([explain._leaf_contributions(data[i : i + 1], leaves, 2) for i in range(len(data))])
    assert np.allclose(many, each, atol=1e-15)
    # contributions sum to what the leaves give the row less what they give on average
    out = sum(np.prod([explain._passes(data[:, f], t) for f, _, t in p], axis=0)[:, None] * v for v, p in leaves)
    assert np.allclose(many.sum(axis=1), out - sum(np.prod([z for _, z, _ in p]) * v for v, p in leaves))
