"""Sources, routing errors and whole runs."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.operators import clean, combine, features, roles
from loomtab.plans import automl
from loomtab.plans.presets import PRESETS, merged, preset
from loomtab.sources.history import RunHistory
from loomtab.sources.models import load_model, load_preparation, save_model, save_preparation
from loomtab.sources.tables import load_table


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({
        "id": np.arange(n), "x": rng.normal(size=n), "y": rng.exponential(size=n), "kind": rng.choice(["u", "v", "w"], n),
        "town": rng.choice([f"t{i:02d}" for i in range(14)], n), "day": pd.date_range("2024-01-01", periods=n, freq="7h").astype(str),
    })
    pdf["grade"] = np.where(pdf.x + (pdf.kind == "u") > 0.8, "high", np.where(pdf.y > 1.2, "mid", "low"))
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("id") % 9 != 0, F.col("y")))
    return df.unionByName(df.filter("id < 30"))


CONFIG = {"exclude_columns": [], "models": ["decision_tree", "logistic_regression"], "transformation": {"encoding": "auto", "scaling": "standard"}}


def test_csv_and_unknown_formats(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.5), (2, None, float("nan"))], "k int, s string, v double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    df = load_table(spark, f"{tmp_path}/t.csv")
    assert df.count() == 2 and df.filter("v is null and s is null").count() == 1
    with pytest.raises(ValueError):
        load_table(spark, f"{tmp_path}/t.xlsx")


def test_run_history(spark, tmp_path):
    runs = RunHistory(spark, f"{tmp_path}/runs")
    assert runs.all().count() == 0 and runs.clear() == 0
    first = runs.save_run({"target_col": "t"}, {"f1": 0.5}, "svm", "classification", n_rows=3)
    runs.save_run({"auto_explore": True}, {"accuracy": 0.25}, "mlp", "classification")
    assert sorted(r["score"] for r in runs.recent().collect()) == [0.25, 0.5] and len(first) == 8
    assert runs.delete(first) == 1 and runs.delete(first) == 0 and runs.all().count() == 1
    assert runs.clear() == 1 and runs.all().count() == 0


def test_combining_errors(spark):
    a, b = spark.range(3).withColumn("v", F.lit(1)), spark.range(2).withColumn("w", F.lit(2))
    for call in (
        lambda: combine.merge_tables([a]), lambda: combine.merge_tables([a, b], "join"), lambda: combine.merge_tables([a, b], "other"),
        lambda: combine.configure_tables({"a": a}, {"a": "test"}), lambda: combine.zip_columns(a, b, ["id"], ["id"]),
        lambda: combine.add_supplement(a, b, "absent"),
    ):
        with pytest.raises(ValueError):
            call()


def test_roles(spark):
    df = spark.createDataFrame([("2024-01-02", "n", 1, 1.5)], "when string, s string, i int, d double")
    assert roles.find_datetime_column(df) == "when" and roles.find_datetime_column(df.drop("when")) is None
    assert roles.detect_task(df, "s") == "classification" and roles.detect_task(df, "i") == "classification" and roles.detect_task(df, "d") == "regression"
    assert roles.detect_task(spark.range(30), "id") == "regression"


def test_target_is_never_treated_as_an_outlier(spark):
    df = spark.createDataFrame([(i, float(i % 10 == 0), float(i)) for i in range(100)], "id long, label double, v double")
    out = clean.clean(df, {}, exclude=["label"])
    assert out.agg(F.sum("label")).first()[0] == 10.0


def test_unparseable_dates_are_missing(spark):
    out = features.add_time_parts(spark.createDataFrame([("2024-01-06",), ("no date",), (None,)], "d string"), "d").toPandas()
    assert out["d_dayofweek"].tolist()[0] == 5 and out["d_is_weekend"].tolist() == [1, 0, 0] and out["d_hour"].isna().tolist() == [False, True, True]


def test_full_run_and_saved_form(spark, table, tmp_path):
    result = automl.run(table, "grade", config=CONFIG, key="id")
    assert result.status == "completed", result.error
    assert result.best and result.best_score > 0.7 and result.prepared.classes == ["high", "low", "mid"]
    report = {(r["step"], r["item"], r["name"]): r["value"] for r in result.report.table(spark).collect()}
    assert report[("created", "time", "day")] == "6" and ("evaluation", result.best, "f1") in report
    assert int(report[("splitting", "train", "n_rows")]) + int(report[("splitting", "test", "n_rows")]) == 600
    fresh = table.drop("grade").withColumnRenamed("id", automl.KEY)
    want = {r[automl.KEY]: r["predicted"] for r in result.predict(fresh).collect()}
    save_model(result.best_model, spark, f"{tmp_path}/m")
    save_preparation(result.prepared, spark, f"{tmp_path}/p")
    prepared, model = load_preparation(spark, f"{tmp_path}/p"), load_model(spark, f"{tmp_path}/m")
    again = automl.RunResult("classification", "grade", result.report, prepared, best="m", best_model=model)
    assert {r[automl.KEY]: r["predicted"] for r in again.predict(fresh).collect()} == want
    text = table.limit(5).withColumn("grade", F.lit("never seen"))
    assert again.predict(text).count() == 5


def test_run_with_reduction_balance_and_regression(spark, table):
    config = {**CONFIG, "models": ["decision_tree"], "dim_reduction": {"method": "pca", "n_components": 3}, "imbalance": {"method": "smote"}, "shap": False}
    result = automl.run(table, "grade", config=config, key="id")
    assert result.status == "completed", result.error
    assert result.prepared.columns == ["PC1", "PC2", "PC3"] and "imbalance_handling" in result.report.steps
    regression = automl.run(table.drop("grade"), "x", config={
        "models": ["linear_regression"], "feature_engineering": {"polynomial": True, "selection": "mutual_info"}, "tuning": {"enable": False}}, key="id")
    assert regression.status == "completed" and regression.task == "regression" and "tuning" not in regression.report.steps
    lost = automl.run(table, "not there")
    assert lost.status == "error" and "not there" in lost.error


def test_external_table_goes_through_the_same_steps(spark, table):
    result = automl.run(table.filter("id < 400"), "grade", config={**CONFIG, "models": ["decision_tree"], "shap": False}, key="id", test=table.filter("id >= 400"))
    assert result.status == "completed" and result.test_rows.count() == 200 and result.best_score > 0.6


def test_explore_and_goal_loop(spark, table):
    config = {"models": ["decision_tree"], "shap": False}
    result, tried = automl.auto_explore(table, "grade", config=config, key="id", folds=2, trees=3, presets=["baseline", "minimal"])
    assert result.status == "completed" and len(tried) == 2 and all(t[1] > 0 for t in tried)
    best, history, status = automl.optimise_until(table, "grade", goal={"metric": "accuracy", "target": 0.1}, max_iterations=3, config=config, key="id")
    assert status == "success" and len(history) == 1 and best is not None
    none, history, status = automl.optimise_until(table, "grade", task="classification", max_iterations=1, config={"models": ["absent"]}, key="id")
    assert none is None and status == "finished" and len(history) == 1


def test_presets_are_never_changed():
    before = repr(dict(PRESETS))
    plan = merged(preset("standard"), {"cleaning": {"imputation": "median"}, "models": ["svm"], "stacking": False})
    assert plan["cleaning"]["imputation"] == "median" and plan["cleaning"]["outlier_method"] == "iqr" and plan["stacking"] is False
    assert repr(dict(PRESETS)) == before


def test_rules_of_the_goal_loop():
    base = merged(automl.default_plan(), {})
    assert automl.next_plan(base, None, "boom", False, 1)["models"] == base["models"][:1]
    assert automl.next_plan(base, 0.9, None, True, 2)["model_params"]["random_forest"]["max_depth"] == 3
    assert "catboost" in automl.next_plan(base, 0.4, None, False, 2)["models"]
    assert automl._met(0.1, 0.2, "rmse") and not automl._met(None, 0.2, "f1") and automl._better(0.1, 0.2, "mae")


def test_fitted_run_scores_a_stream(spark, table, tmp_path):
    from loomtab.streaming.apply import score_stream
    result = automl.run(table, "grade", config={**CONFIG, "models": ["decision_tree"], "shap": False}, key="id")
    raw = table.drop("grade").dropDuplicates(["id"])
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    q = score_stream(result, stream, "id").writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 600
