"""Splits, folds, metrics and rule-based findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import metrics, rules, split

from .registry import over, query, table, view

HASH = "md5('42:' || o_orderkey)"


def _part_sql(partition, val=False, rel="orders", label=None):
    label = f", {label}" if label else ""
    n = f"count(*) over ({partition})"
    test = f"ceil({n} * 0.2 - 1e-9)"
    cases = f"when rn <= {test.replace(n, 'n')} then 'test'"
    if val:
        cases += " when rn <= ceil(n * 0.2 - 1e-9) + ceil((n - ceil(n * 0.2 - 1e-9)) * 0.125 - 1e-9) then 'val'"
    return f"""select o_orderkey{label}, case {cases} else 'train' end as part from (
        select *, row_number() over ({partition} order by {HASH}) as rn, {n} as n from {rel})"""


@query("split_random", _part_sql(""))
def split_random(spark, sf):
    return split.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("split_stratified", _part_sql("partition by o_orderstatus", label="o_orderstatus"))
def split_stratified(spark, sf):
    return split.split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "stratified", "o_orderstatus")


@query("split_stratified_fallback", over("orders_rare", _part_sql("", rel="orders_rare", label="status")))
def split_stratified_fallback(spark, sf):
    return split.split(view(spark, sf, "orders_rare").select("o_orderkey", "status"), "o_orderkey", "stratified", "status")


@query("split_three_way", _part_sql("", val=True))
def split_three_way(spark, sf):
    return split.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", val_size=0.1)


@query("split_report", f"select part, count(*) as n from ({_part_sql('partition by o_orderstatus', val=True)}) group by 1")
def split_report(spark, sf):
    return split.split_report(split.split(table(spark, sf, "orders"), "o_orderkey", "stratified", "o_orderstatus", val_size=0.1))


@query("split_time", """
    select o_orderkey, case when rn > n - floor(n * 0.2) then 'test' else 'train' end as part from (
      select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders)""")
def split_time(spark, sf):
    return split.split_by_time(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("folds_time", """
    with p as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders),
         f as (select p.*, fold, n - 5 * (n // 6) + fold * (n // 6) as first_test, n // 6 as block from p cross join (select unnest(range(5))::int as fold))
    select o_orderkey, fold, case when pos < first_test then 'train' else 'test' end as role from f where pos < first_test + block""")
def folds_time(spark, sf):
    return split.time_folds(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _fold_sql(partition):
    return f"""select o_orderkey, (case when rn <= ceil(n * 1 / 5) then 0 when rn <= ceil(n * 2 / 5) then 1 when rn <= ceil(n * 3 / 5) then 2
        when rn <= ceil(n * 4 / 5) then 3 else 4 end)::int as fold from (
        select o_orderkey, row_number() over ({partition} order by {HASH}) as rn, count(*) over ({partition}) as n from orders)"""


@query("folds_kfold", _fold_sql(""))
def folds_kfold(spark, sf):
    return split.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("folds_stratified", _fold_sql("partition by o_orderstatus"))
def folds_stratified(spark, sf):
    return split.kfold(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", label="o_orderstatus").drop("o_orderstatus")


# metrics --------------------------------------------------------------------------------------------
@query("metric_accuracy", over("pred_rule", "select count(*) as n, round(avg((label = prediction)::int), 4) as accuracy from pred_rule"))
def metric_accuracy(spark, sf):
    return metrics.accuracy(view(spark, sf, "pred_rule"))


def class_sql(rel):
    """Per model and class: precision, recall, f1, support, hits."""
    return f"""
        cl as (select model, label as class from {rel} union select model, prediction from {rel}),
        pc as (select cl.model, cl.class, count(*) filter (r.label = cl.class) as support, count(*) filter (r.prediction = cl.class) as predicted,
                      count(*) filter (r.label = cl.class and r.prediction = cl.class) as hit
               from cl join {rel} r on r.model = cl.model group by 1, 2),
        pm as (select *, case when predicted = 0 then 0 else hit / predicted end as p, case when support = 0 then 0 else hit / support end as r,
                      case when predicted + support = 0 then 0 else 2 * hit / (predicted + support) end as f from pc)"""


def weighted_sql(rel):
    return f"""{class_sql(rel)}, sc as (
        select model, round(sum(hit) / sum(support), 4) as accuracy, round(sum(p * support) / sum(support), 4) as precision,
               round(sum(r * support) / sum(support), 4) as recall, round(sum(f * support) / sum(support), 4) as f1 from pm group by 1)"""


@query("metric_weighted_prf", over("flag_scores", f"""
    with one as (select 'm' as model, label, prediction from flag_scores), {weighted_sql('one')} select accuracy, precision, recall, f1 from sc"""))
def metric_weighted_prf(spark, sf):
    return metrics.weighted_prf(view(spark, sf, "flag_scores"))


@query("metric_confusion", over("flag_scores", """
    with c as (select label as c from flag_scores union select prediction from flag_scores)
    select a.c as label, b.c as prediction, count(f.label) as n from c a cross join c b left join flag_scores f on f.label = a.c and f.prediction = b.c group by 1, 2"""))
def metric_confusion(spark, sf):
    return metrics.confusion(view(spark, sf, "flag_scores"))


@query("metric_class_report", over("flag_scores", f"""
    with one as (select 'm' as model, label, prediction from flag_scores), {class_sql('one')}
    select class, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1, support from pm
    union all select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support)::bigint from pm
    union all select 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), sum(support)::bigint from pm
    union all select 'accuracy', round(sum(hit) / sum(support), 4), round(sum(hit) / sum(support), 4), round(sum(hit) / sum(support), 4), sum(support)::bigint from pm"""))
def metric_class_report(spark, sf):
    return metrics.class_report(view(spark, sf, "flag_scores"))


def _auc_sql(rel, positive, score):
    """Mann-Whitney U from average ranks."""
    return f"""(select (sum(case when pos then rk end) - sum(pos::int) * (sum(pos::int) + 1) / 2) / (sum(pos::int) * (count(*) - sum(pos::int))) from (
        select {positive} as pos, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2 as rk from {rel}))"""


@query("metric_auc_binary", over("pred_rule", f"select round({_auc_sql('pred_rule', 'label = 1', 'score')}, 4) as roc_auc"))
def metric_auc_binary(spark, sf):
    return metrics.auc_binary(view(spark, sf, "pred_rule"))


@query("metric_auc_ovr", over("flag_scores", "select round(" + " + ".join(
    f"{_auc_sql('flag_scores', chr(39).join(['label = ', k, '']), s)} * (select count(*) filter (label = '{k}') / count(*) from flag_scores)"
    for k, s in (("A", "score_a"), ("N", "score_n"), ("R", "score_r"))) + ", 4) as roc_auc"))
def metric_auc_ovr(spark, sf):
    return metrics.auc_one_vs_rest(view(spark, sf, "flag_scores"), {"A": "score_a", "N": "score_n", "R": "score_r"})


@query("metric_regression", over("rule_regressors", """
    select model, round(avg((label - prediction) ** 2), 4) as mse, round(sqrt(avg((label - prediction) ** 2)), 4) as rmse, round(avg(abs(label - prediction)), 4) as mae,
           round(1 - avg((label - prediction) ** 2) / var_pop(label), 4) as r2 from rule_regressors group by 1"""))
def metric_regression(spark, sf):
    return metrics.regression_scores(view(spark, sf, "rule_regressors"), groups=["model"])


def _rule_scores(spark, sf):
    return metrics.weighted_prf(view(spark, sf, "rule_models"), groups=["model"])


SCORES = over("rule_models", f"with {weighted_sql('rule_models')} ")


@query("metric_many", SCORES + "select * from sc")
def metric_many(spark, sf):
    return _rule_scores(spark, sf)


@query("rank_models", SCORES + "select *, row_number() over (order by f1 desc, model)::int as rank from sc")
def rank_models(spark, sf):
    return metrics.rank_models(_rule_scores(spark, sf), "f1")


@query("compare_models", SCORES + "select model, accuracy, f1, row_number() over (order by f1 desc, model)::int as rank from sc")
def compare_models(spark, sf):
    return metrics.compare_models(metrics.rank_models(_rule_scores(spark, sf), "f1"), ["accuracy", "f1"])


@query("flags_overfit", SCORES + """
    select model, 'near_perfect_accuracy' as flag, round(accuracy, 4) as value from sc where accuracy >= 0.99
    union all select model, 'accuracy_f1_gap', round(abs(accuracy - f1), 4) from sc where abs(accuracy - f1) > 0.15 and accuracy > 0""")
def flags_overfit(spark, sf):
    return rules.overfit_flags(_rule_scores(spark, sf))


@query("suggestions", SCORES + """
    select 'tuning' as topic, 'search the hyperparameters of the best model' as advice
    union all select 'imbalance', 'rebalance unequal classes' union all select 'features', 'create polynomial or interaction features'
    union all select 'diversity', 'compare more kinds of models' where (select count(*) from sc) <= 2
    union all select 'stacking', 'combine the best models' where (select count(*) from sc) >= 3
    union all select 'cross_validation', 'estimate the scores with folds'""")
def suggestions(spark, sf):
    return rules.suggestions(_rule_scores(spark, sf), ["cleaning", "training", "evaluation"])


@query("winner_margin", over("rule_regressors", """
    with r as (select model, round(1 - avg((label - prediction) ** 2) / var_pop(label), 4) as r2 from rule_regressors group by 1),
         o as (select *, row_number() over (order by r2 desc, model) as rn from r)
    select a.model as winner, a.r2 as score, b.model as runner_up, round(a.r2 - b.r2, 4) as margin,
           round(round(a.r2 - b.r2, 4) / greatest(abs(b.r2), 0.0001) * 100, 1) as margin_pct,
           round(a.r2 - (select avg(r2) from o where rn > 1), 4) as lead_over_others
    from o a join o b on a.rn = 1 and b.rn = 2"""))
def winner_margin(spark, sf):
    return rules.winner_margin(metrics.regression_scores(view(spark, sf, "rule_regressors"), groups=["model"]), "r2")


@query("actual_vs_predicted", """
    select p_retailprice as label, 900.0e0 + p_size as prediction, (select least(min(p_retailprice), min(900.0e0 + p_size)) from part) as line_start,
           (select greatest(max(p_retailprice), max(900.0e0 + p_size)) from part) as line_end from part""")
def actual_vs_predicted(spark, sf):
    scored = table(spark, sf, "part").select(F.col("p_retailprice").alias("label"), (F.lit(900.0) + F.col("p_size")).alias("prediction"))
    return rules.actual_vs_predicted(scored)
