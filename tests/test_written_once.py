"""Joined codes and created columns are written once: later fits read them instead of making them again."""

from pyspark.sql import functions as F

from loomtab.operators import features, transform


def _rows(spark):
    return spark.range(0, 400, 1, 2).select(
        F.col("id").alias("row_key"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("name"), F.sin("id").alias("a"), F.cos("id").alias("b"),
        F.expr("case when id % 5 = 0 then null else cast(id % 11 as double) end").alias("c"), (F.col("id") % 2).cast("double").alias("label"))


def test_codes_are_joined_once_and_rows_are_those_of_the_plan(spark):
    df = _rows(spark)
    for encoding in ("target", "label"):
        settings = {"encoding": encoding, "scaling": "robust", "nonlinear": "boxcox"}
        plan, made = transform.fit_transform(df, settings, "label", ["row_key"])
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        want = plan.apply(df)
        assert made.columns == want.columns and "Join" in want._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_a_selection_reads_written_products(spark, monkeypatch):
    from loomtab.operators import select
    read, real = [], select.select_features
    monkeypatch.setattr(select, "select_features", lambda df, *rest: read.append(df) or real(df, *rest))
    df = _rows(spark).drop("name")
    settings = {"polynomial": True, "interactions": True, "selection_method": "mutual_info", "n_select": 4}
    plan = features.fit_feature_plan(df, settings, "label", "classification", ["row_key"])
    assert read[0].inputFiles()  # a written table, where the rows given have none
    assert sorted(map(str, read[0].collect())) == sorted(map(str, plan.build(df).collect()))
    assert len([c for c in plan.keep if c not in ("label", "row_key")]) == 4
