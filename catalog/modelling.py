"""Reduction, models, tuning, explanation and whole runs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomtab.functions.staging import new_path
from loomtab.operators import explain, isolation, models, reduce as reducing, tune as tuning
from loomtab.operators.split import split
from loomtab.plans import automl
from loomtab.plans.report import save_report
from loomtab.sources.history import RunHistory
from loomtab.sources.models import load_model, save_model
from loomtab.sources.tables import StepCheckpoints

from .neighbours import DBSCAN_SQL, EPS, FEATURES, _vectors
from .registry import query, view, wide_table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# a class and a value that follow from the columns of the row, so that models have something to find
HEAVY = "case when l_quantity * (1 - l_discount) > 24 then 1 else 0 end"
BAND = "case when l_quantity > 34 then 2 when l_quantity > 17 then 1 else 0 end"
REVENUE = "l_extendedprice * (1 - l_discount)"


def _lines(spark, sf, label):
    df = wide_table(spark, sf, "lineitem")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("line_key")
    return df.select(key, *LINE, F.expr(f"cast({label} as double)").alias("label"))


def _vectors_of(df, features=LINE, key="line_key"):
    return models.assemble(df, features, [key, "label"])


def _parts(spark, sf, label):
    df = split(_lines(spark, sf, label), "line_key")
    return _vectors_of(df.filter("part = 'train'")).persist(), _vectors_of(df.filter("part = 'test'")).persist()


def _trained(spark, sf, name, task, params=None, label=None):
    label = label or (HEAVY if task == "classification" else REVENUE)
    train_rows, test_rows = _parts(spark, sf, label)
    try:
        model = models.train(name, train_rows, LINE, task, params)
        return models.results_table(spark, {name: {**models.evaluate(model, test_rows), "n_features": len(LINE), "n_samples": model.n_samples}})
    finally:
        train_rows.unpersist()
        test_rows.unpersist()


# Boosted trees take a fifth of the usual rounds: MLlib runs every level of every round as a job, which on tables of
# this size is waiting, not work. All other models have their usual settings.
BOOSTED = {"n_estimators": 20}
for _name in models.CLASSIFICATION:
    _params = BOOSTED if _name in models.BOOSTING else {}
    query(f"train_{_name}_classification")(lambda spark, sf, n=_name, p=_params: _trained(spark, sf, n, "classification", p))
for _name in models.REGRESSION:
    _params = BOOSTED if _name in models.BOOSTING else {}
    if _name != "linear_regression":
        query(f"train_{_name}_regression")(lambda spark, sf, n=_name, p=_params: _trained(spark, sf, n, "regression", p))


@query("train_linear_regression_regression", "select round(regr_slope(p_retailprice, p_partkey), 6) as slope, round(regr_intercept(p_retailprice, p_partkey), 4) as intercept from part")
def train_linear_regression(spark, sf):
    df = wide_table(spark, sf, "part").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("label"))
    model = models.train("linear_regression", models.assemble(df, ["x"], ["label"]), ["x"], "regression").model
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 4))], "slope double, intercept double")


@query("train_boosting_multiclass")
def train_boosting_multiclass(spark, sf):
    return _trained(spark, sf, "xgboost", "classification", {"n_estimators": 5, "max_depth": 3}, BAND)


def _clusters(name):
    def run(spark, sf):
        rows = models.assemble(_vectors(spark, sf), FEATURES, ["vec_id"]).persist()
        try:
            model = models.train(name, rows, FEATURES, "clustering")
            return model.predict(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))
        finally:
            rows.unpersist()
    return run


for _name in ("kmeans", "hierarchical", "gmm"):
    query(f"train_{_name}_clustering")(_clusters(_name))


@query("train_dbscan_clustering", "with d as (select cluster from (" + DBSCAN_SQL + ")) select cluster as prediction, count(*) as n from d group by 1")
def train_dbscan(spark, sf):
    rows = models.assemble(_vectors(spark, sf), FEATURES, ["vec_id"])
    model = models.train("dbscan", rows, FEATURES, "clustering", {"eps": EPS})
    return model.predict(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query("train_many")
def train_many(spark, sf):
    train_rows, test_rows = _parts(spark, sf, HEAVY)
    try:
        fitted = models.train_many(["logistic_regression", "decision_tree", "not_a_model"], train_rows, LINE)
        return models.results_table(spark, models.evaluate_many(fitted, test_rows, "classification"))
    finally:
        train_rows.unpersist()
        test_rows.unpersist()


@query("stacking")
def stacking(spark, sf):
    train_rows, test_rows = _parts(spark, sf, HEAVY)
    try:
        bases = [models.train(n, train_rows, LINE, params=p) for n, p in (("logistic_regression", {}), ("decision_tree", {"max_depth": 4}), ("random_forest", {}))]
        stacked = models.stack_models(bases, train_rows, "line_key")
        return models.results_table(spark, {"stacking": models.evaluate(stacked, test_rows)})
    finally:
        train_rows.unpersist()
        test_rows.unpersist()


@query("predict_batch")
def predict_batch(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY))
    return models.train("decision_tree", data, LINE).predict(data).select("line_key", "label", "prediction", F.col("scores")[1].alias("probability"))


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY))
    model, path = models.train("decision_tree", data, LINE), new_path(spark, "model")
    save_model(model, spark, path)
    return load_model(spark, path).predict(data).groupBy("label", "prediction").agg(F.count("*").alias("n"))


# reduction and outliers -----------------------------------------------------------------------------
@query("pca_k")
def pca_k(spark, sf):
    df = _vectors(spark, sf).drop("label", "rare")
    return reducing.fit_pca(df, 8, exclude=["vec_id"]).apply(df)


@query("pca_variance")
def pca_variance(spark, sf):
    df = _vectors(spark, sf).drop("label", "rare")
    return reducing.fit_pca(df, None, 0.95, exclude=["vec_id"]).apply(df)


@query("lda_project")
def lda_project(spark, sf):
    df = _vectors(spark, sf).drop("rare")
    return reducing.fit_lda(df, "label", exclude=["vec_id"]).apply(df)


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark, sf):
    df = view(spark, sf, "customer_outlier")
    return isolation.isolation_flags(df, ["c_acctbal", "c_nationkey"], key="c_custkey").select("c_custkey", "c_acctbal", "anomaly_score", "is_outlier")


@query("outlier_iforest_remove")
def outlier_iforest_remove(spark, sf):
    df = view(spark, sf, "customer_outlier")
    return isolation.handle_isolated(df, "remove", ["c_acctbal", "c_nationkey"], key="c_custkey")


# validation and search ------------------------------------------------------------------------------
@query("cross_validate")
def cross_validate(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY))
    cv = tuning.cross_validate("decision_tree", data, LINE, "line_key", method="stratified")
    rows = [(f"fold{i}", s) for i, s in enumerate(cv.scores)] + [("mean", cv.mean), ("std", cv.std)]
    return spark.createDataFrame(rows, "item string, value double")


def _tuned(name, method, space, n_trials):
    def run(spark, sf):
        data = _vectors_of(_lines(spark, sf, HEAVY))
        found = tuning.tune(name, data, LINE, "line_key", method=method, space=space, n_trials=n_trials)
        rows = [(i, str(p), s, p == found.best_params) for i, (p, s) in enumerate(found.trials)]
        return spark.createDataFrame(rows, "trial int, params string, score double, is_best boolean")
    return run


query("tune_grid")(_tuned("decision_tree", "grid", {"max_depth": [2, 4, 6]}, 0))
query("tune_random")(_tuned("decision_tree", "random", {"max_depth": ("int", 2, 8), "min_samples_leaf": [1, 5, 20]}, 50))
query("tune_bayesian")(_tuned("decision_tree", "bayesian", None, 50))


# A label that two columns with few distinct values decide: trees, forests and boosted trees must find it exactly, so SQL
# can say what they predict for every row.
PLANTED = "case when l_discount > 0.05 and l_tax < 0.035 then 1 else 0 end"
LEVEL = "case when l_discount > 0.05 then 3 else 1 end + case when l_tax < 0.035 then 10 else 0 end"
PLANTED_AT = {"at": "cast(case when l_discount > 0.05 and l_tax - 0.02 < 0.035 then 1 else 0 end as double)"}


# explanation ----------------------------------------------------------------------------------------
@query("feature_importance")
def feature_importance(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY)).persist()
    try:
        fitted = models.train_many(["decision_tree", "logistic_regression"], data, LINE)
        rows = [(n, f, v) for n, m in fitted.items() for f, v in models.importances(m)]
        return spark.createDataFrame(rows, "model string, feature string, importance double")
    finally:
        data.unpersist()


# The weights of the linear score that the exact explanation queries use.
WEIGHTS = {"l_quantity": 2.0, "l_extendedprice": 0.001, "l_discount": -30.0, "l_tax": 5.0}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("shap_linear", " union all ".join(
    f"select {', '.join(KEYS)}, '{c}' as feature, round({w} * ({c} - (select avg({c}) from lineitem)), 6) as contribution from lineitem" for c, w in WEIGHTS.items()))
def shap_linear(spark, sf):
    df = wide_table(spark, sf, "lineitem")
    means = df.agg(*[F.avg(c).alias(c) for c in WEIGHTS]).first().asDict()
    keyed = df.withColumn("k", F.struct(*KEYS))
    out = explain.linear_contributions(keyed, "k", WEIGHTS, means)
    return out.select("k.*", "feature", F.round("contribution", 6).alias("contribution"))


def _forest(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY))
    return models.train("random_forest", data, LINE, params={"n_estimators": 10, "max_depth": 5}), data


@query("shap_tree")
def shap_tree(spark, sf):
    model, data = _forest(spark, sf)
    return explain.mean_abs(explain.contributions(model, data, "line_key"))


@query("shap_local")
def shap_local(spark, sf):
    model, data = _forest(spark, sf)
    return explain.top_contributions(explain.contributions(model, data, "line_key"), "line_key", 3)


def _additive(model, data, scored):
    """How many rows are explained, for how many of them contributions and base do not sum to the output, and the largest error."""
    found = explain.contributions(model, data, "line_key", explain.vector_means(data))
    sums = found.groupBy("line_key").agg((F.sum("contribution") + F.first("base_value")).alias("total"), F.max("std_error").alias("error"))
    both = scored.select("line_key", F.col("out")).join(sums, "line_key")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("out") - F.col("total")) > 1e-6).alias("off"), F.count_if(F.col("error") > 0).alias("inexact"))


ADDITIVE = "select count(*) as n_rows, cast(0 as bigint) as off, cast(0 as bigint) as inexact from lineitem"


@query("shap_additivity_tree", ADDITIVE)
def shap_additivity_tree(spark, sf):
    model, data = _forest(spark, sf)
    chosen = F.col("scores")[F.col("prediction").cast("int")].alias("out")
    return _additive(model, data, model.predict(data).select("line_key", chosen))


@query("shap_additivity_any", ADDITIVE)
def shap_additivity_any(spark, sf):
    """Three classes of a logistic model: neither trees nor one set of weights, so all coalitions are scored."""
    data = _vectors_of(_lines(spark, sf, BAND)).persist()
    try:
        model = models.train("logistic_regression", data, LINE)
        return _additive(model, data, model.predict(data).select("line_key", F.col("scores")[F.col("prediction").cast("int")].alias("out")))
    finally:
        data.unpersist()


@query("planted_what_if", f"select {PLANTED_AT['at']} as prediction, count(*) as n, count(*) as explained from lineitem group by 1")
def planted_what_if(spark, sf):
    """Scenarios move the tax and keep the discount; a tree that found the rule must answer by the rule."""
    data = _planted(spark, sf, PLANTED)
    model = models.train("decision_tree", data, ["l_discount", "l_tax"])
    asked = _lines(spark, sf, PLANTED).select("line_key", "l_discount", F.expr("l_tax - 0.02").alias("l_tax"))
    said = explain.what_if(model, asked, "line_key", explain.vector_means(data))
    top = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"]) + F.col("base_value")
    fits = F.abs(top - F.element_at("probabilities", F.col("prediction").cast("int") + 1)) < 1e-3
    return said.groupBy("prediction").agg(F.count("*").alias("n"), F.count_if(fits).alias("explained"))


@query("grid_cross_join", """
    with g as (select unnest(range(50)) as i, (select min(l_quantity) from lineitem) as a, (select max(l_quantity) from lineitem) as b)
    select i::int as grid_id, round(a + i * (b - a) / 49, 6) as l_quantity, count(*) as n, round(avg(l_discount), 4) as mean_discount from g cross join lineitem group by i, a, b""")
def grid_cross_join(spark, sf):
    df = wide_table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    wide = explain.on_grid(df, "l_quantity", explain.grid_of(df, "l_quantity"))
    return wide.groupBy("grid_id", F.round("l_quantity", 6).alias("l_quantity")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean_discount"))


@query("pdp_linear", """
    with g as (select unnest(range(50)) as i, (select min(l_quantity) from lineitem) as a, (select max(l_quantity) from lineitem) as b)
    select i::int as grid_id, round(a + i * (b - a) / 49, 6) as value,
           round(2.0 * (a + i * (b - a) / 49) + (select avg(0.001 * l_extendedprice - 30.0 * l_discount + 5.0 * l_tax) from lineitem), 4) as prediction from g""")
def pdp_linear(spark, sf):
    df = wide_table(spark, sf, "lineitem").select(*LINE)
    wide = explain.on_grid(df, "l_quantity", explain.grid_of(df, "l_quantity"))
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return wide.groupBy("grid_id", F.round("l_quantity", 6).alias("value")).agg(F.round(F.avg(score), 4).alias("prediction"))


@query("pdp")
def pdp(spark, sf):
    data = _vectors_of(_lines(spark, sf, HEAVY))
    model = models.train("decision_tree", data, LINE, params={"max_depth": 4})
    return explain.partial_dependence(model, data, "l_quantity", 20)


@query("whatif_batch")
def whatif_batch(spark, sf):
    rows = _lines(spark, sf, HEAVY)
    data = _vectors_of(rows)
    model = models.train("decision_tree", data, LINE, params={"max_depth": 4})
    asked = rows.select("line_key", F.col("l_quantity").cast("string").alias("l_quantity"), F.lit("not a number").alias("l_discount"), "l_extendedprice")
    return explain.what_if(model, asked, "line_key", explain.vector_means(data))


# whole runs -----------------------------------------------------------------------------------------
def _orders(spark, sf):
    """Orders with their customers; the class follows the total and the customer's balance."""
    orders, customers = wide_table(spark, sf, "orders"), wide_table(spark, sf, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "c_acctbal", "c_mktsegment", "c_nationkey",
        F.when(F.col("o_totalprice") > 300000, "big").when((F.col("c_acctbal") > 5000) | (F.month("o_orderdate") == 12), "good").otherwise("usual").alias("grade"))


STANDARD = {
    "cleaning": {"imputation": "auto", "outlier_method": "iqr", "remove_duplicates": True},
    "transformation": {"encoding": "auto", "scaling": "standard"},
    "feature_engineering": {"time_features": True},
    "splitting": {"method": "stratified", "test_size": 0.2},
    "models": ["random_forest", "logistic_regression", "decision_tree"],
}


def flagship(spark, sf):
    """All steps of a run, with its tables, preparation, winning model and record kept as the last one."""
    result = automl.run(_orders(spark, sf), "grade", config=STANDARD, key="o_orderkey", folder=new_path(spark, "run"))
    if result.status != "completed":
        raise RuntimeError(result.error)
    return result.scores_table(spark)


query("automl_run")(flagship)


@query("run_roundtrip", """
    select count(*) as n_rows, cast(0 as bigint) as differing, cast(3 as bigint) as steps, cast(1 as bigint) as runs, 'decision_tree' as best_model
    from orders join customer on o_custkey = c_custkey""")
def run_roundtrip(spark, sf):
    """A run that keeps everything, read back: the reloaded run must predict the same for every row."""
    rows, folder = _orders(spark, sf), new_path(spark, "run")
    config = {**STANDARD, "models": ["decision_tree"], "shap": False}
    result = automl.run(rows, "grade", config=config, key="o_orderkey", folder=folder)
    if result.status != "completed":
        raise RuntimeError(result.error)
    keyed = rows.withColumn(automl.KEY, F.col("o_orderkey"))
    one, two = (r.predict(keyed).select(automl.KEY, F.col("predicted").alias(n)) for r, n in ((result, "a"), (automl.load_run(spark, folder), "b")))
    both = one.join(two, automl.KEY).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))
    steps = StepCheckpoints(spark, f"{folder}/steps").log().count()
    runs = RunHistory(spark, f"{folder}/history").all().collect()
    return both.select("n_rows", "differing", F.lit(steps).cast("long").alias("steps"), F.lit(len(runs)).cast("long").alias("runs"), F.lit(runs[0]["best_model"]).alias("best_model"))


@query("auto_explore")
def auto_explore(spark, sf):
    config = {"models": ["decision_tree", "logistic_regression"], "shap": False}
    result, tried = automl.auto_explore(_orders(spark, sf), "grade", config=config, key="o_orderkey")
    rows = [(name, score, deviation, name == max(tried, key=lambda t: t[1])[0], result.best) for name, score, deviation, _ in tried]
    return spark.createDataFrame(rows, "preset string, score double, deviation double, winner boolean, best_model string")


@query("explore_leakage", "select preset, true as at_chance from (values ('baseline'), ('standard')) t(preset)")
def explore_leakage(spark, sf):
    """A random class and a text key that is different in every row, encoded by target means: a strategy whose encoding has seen
    the rows it is tested on scores 1; a coin, or always the same class, scores two thirds at most."""
    orders = wide_table(spark, sf, "orders")
    rows = orders.select("o_orderkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("name"), "o_totalprice",
                         F.when(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 2 == 0, "yes").otherwise("no").alias("grade"))
    config = {"models": ["decision_tree"], "shap": False, "transformation": {"encoding": "target"}}
    _, tried = automl.auto_explore(rows, "grade", config=config, key="o_orderkey", trees=10, presets=["baseline", "standard"])
    return spark.createDataFrame([(name, not error and score < 0.75) for name, score, _, error in tried], "preset string, at_chance boolean")


@query("goal_loop")
def goal_loop(spark, sf):
    config = {"models": ["decision_tree", "logistic_regression"], "shap": False, "stacking": False}
    _, history, status = automl.optimise_until(_orders(spark, sf), "grade", goal={"metric": "f1", "target": 0.9}, max_iterations=2, config=config, key="o_orderkey")
    return spark.createDataFrame([(h["iteration"], h["status"], h["score"], h["best_model"], h["is_best"], status) for h in history],
                                 "iteration int, status string, score double, best_model string, is_best boolean, outcome string")


@query("external_test")
def external_test(spark, sf):
    rows = _orders(spark, sf)
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    config = {**STANDARD, "models": ["decision_tree"], "shap": False}
    result = automl.run(rows.filter(~late), "grade", config=config, key="o_orderkey", test=rows.filter(late))
    return result.scores_table(spark)


@query("report_json")
def report_json(spark, sf):
    config = {**STANDARD, "models": ["decision_tree", "logistic_regression"]}
    result = automl.run(_orders(spark, sf), "grade", config=config, key="o_orderkey")
    return save_report(result.report.table(spark), new_path(spark, "report"))


# planted rules --------------------------------------------------------------------------------------
def _planted(spark, sf, rule):
    return models.assemble(_lines(spark, sf, rule), ["l_discount", "l_tax"], ["line_key", "label"])


def _planted_query(name, task, rule, params=None):
    def run(spark, sf):
        data = _planted(spark, sf, rule).persist()
        try:
            model = models.train(name, data, ["l_discount", "l_tax"], task, params)
            return model.predict(data).groupBy("label", F.round("prediction", 6).alias("prediction")).agg(F.count("*").alias("n"))
        finally:
            data.unpersist()
    sql = f"select cast({rule} as double) as label, cast({rule} as double) as prediction, count(*) as n from lineitem group by 1"
    query(f"planted_{name}_{task}", sql)(run)


for _name in ("decision_tree", "random_forest", *models.BOOSTING):
    _planted_query(_name, "classification", PLANTED, BOOSTED if _name in models.BOOSTING else None)
_planted_query("decision_tree", "regression", LEVEL)


# A class inside a circle of the two columns' grid: no straight line parts it from the rest. Rows near the circle are left out.
RING = "(l_discount * 100 - 5) * (l_discount * 100 - 5) + (l_tax * 100 - 4) * (l_tax * 100 - 4)"


@query("planted_kernel_svm", f"""
    select cast({RING} < 8 as int)::double as label, cast({RING} < 8 as int)::double as prediction, count(*) as n from lineitem
    where {RING} < 6.5 or {RING} > 14.5 group by 1""")
def planted_kernel_svm(spark, sf):
    rows = _lines(spark, sf, f"cast({RING} < 8 as int)").filter(f"{RING} < 6.5 or {RING} > 14.5")
    rows = rows.withColumns({c: F.col(c) * 100 for c in ("l_discount", "l_tax")})
    data = models.assemble(rows, ["l_discount", "l_tax"], ["line_key", "label"])
    model = models.train("svm", data, ["l_discount", "l_tax"], params={"kernel": "rbf", "C": 10.0})
    return model.predict(data).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("planted_tube_regression", "select true as within_tube, count(*) as n from lineitem")
def planted_tube_regression(spark, sf):
    """A line of the columns plus noise no wider than the tube: the machine finds a line with all rows inside it."""
    noise = "0.04 * (cast(round(l_extendedprice * 100) as bigint) % 3 - 1)"
    data = _planted(spark, sf, f"3 * l_discount * 10 - 2 * l_tax * 10 + {noise}")
    rows = data.select("line_key", "label", array_to_vector(F.transform(vector_to_array("features"), lambda x: x * 10)).alias("features"))
    model = models.train("svm", rows, ["l_discount", "l_tax"], "regression", {"kernel": "linear", "epsilon": 0.05, "C": 100.0})
    said = model.predict(rows)
    return said.groupBy((F.abs(F.col("prediction") - F.col("label")) <= 0.052).alias("within_tube")).agg(F.count("*").alias("n"))


# Two groups of discounts with a wide gap between them: the last merge must be the one across the gap.
@query("planted_agglomerative", "select case when l_discount > 0.05 then 1 else 0 end as cluster, count(*) as n from lineitem group by 1")
def planted_agglomerative(spark, sf):
    data = _lines(spark, sf, "0").withColumn("l_discount", F.expr("l_discount * 100 + case when l_discount > 0.05 then 40 else 0 end"))
    rows = models.assemble(data, ["l_discount"], ["line_key"])
    model = models.train("hierarchical", rows, ["l_discount"], "clustering", {"n_clusters": 2})
    return model.predict(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query("planted_roundtrip", f"select count(*) as n_rows, cast(0 as bigint) as differing, sum({PLANTED}) as predicted_ones from lineitem")
def planted_roundtrip(spark, sf):
    """A saved and reloaded tree predicts as before, and as the rule says."""
    data, path = _planted(spark, sf, PLANTED), new_path(spark, "model")
    model = models.train("decision_tree", data, ["l_discount", "l_tax"])
    save_model(model, spark, path)
    again = load_model(spark, path).predict(model.predict(data).select("line_key", "label", "features", F.col("prediction").alias("before")))
    return again.agg(F.count("*").alias("n_rows"), F.count_if(F.col("before") != F.col("prediction")).alias("differing"), F.sum(F.col("prediction").cast("long")).alias("predicted_ones"))


@query("planted_importance", "select 'l_discount' as feature, 1.0 as importance union all select 'l_tax', 0.0")
def planted_importance(spark, sf):
    """Only one column decides: a tree gives it all the importance."""
    data = _planted(spark, sf, "case when l_discount > 0.05 then 1 else 0 end")
    model = models.train("decision_tree", data, ["l_discount", "l_tax"])
    return spark.createDataFrame([(f, float(v)) for f, v in models.importances(model)], "feature string, importance double")


@query("planted_cross_validation", "select 'fold' || i as item, 1.0 as value from range(5) t(i) union all select 'mean', 1.0 union all select 'std', 0.0")
def planted_cross_validation(spark, sf):
    cv = tuning.cross_validate("decision_tree", _planted(spark, sf, PLANTED), ["l_discount", "l_tax"], "line_key", method="stratified")
    rows = [(f"fold{i}", float(s)) for i, s in enumerate(cv.scores)] + [("mean", float(cv.mean)), ("std", float(cv.std))]
    return spark.createDataFrame(rows, "item string, value double")


@query("planted_tuning", "select cast(max_depth as bigint) as max_depth, max_depth >= 2 as perfect from (values (1), (2), (4)) t(max_depth)")
def planted_tuning(spark, sf):
    """Grid search: the rule needs two levels, so depth 1 must score below 1 and the others exactly 1."""
    found = tuning.tune("decision_tree", _planted(spark, sf, PLANTED), ["l_discount", "l_tax"], "line_key", method="grid", space={"max_depth": [1, 2, 4]})
    return spark.createDataFrame([(p["max_depth"], s == 1.0) for p, s in found.trials], "max_depth long, perfect boolean")
