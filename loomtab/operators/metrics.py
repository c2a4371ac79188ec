"""Metrics over a (label, prediction, score) table, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col
from ..functions.ordering import running_total

DIGITS = 4


def as_class(c: Column) -> Column:
    """Float predictions are rounded half to even before they are compared as classes."""
    return F.rint(c.cast("double")).cast("long")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (as_class(col(label)) == as_class(col(prediction))).cast("double")
    return df.agg(F.count("*").alias("n"), F.round(F.avg(hit), DIGITS).alias("accuracy"))


def cell_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    """(label, prediction, n): the one pass over the data that the class metrics share."""
    by = [col(g) for g in groups]
    return df.groupBy(*by, col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every class against every class, empty cells included, in long form."""
    cells = cell_counts(df, label, prediction)
    names = cells.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    classes = names.agg(F.sort_array(F.collect_set("c")).alias("cs"))
    # classes x classes zero cells from the class list itself, then added to the counts
    zero = classes.select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("prediction"), F.lit(0).cast("long").alias("n"))
    return cells.unionByName(zero).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def per_class(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 and support of every class seen as label or prediction."""
    by = [col(g) for g in groups]
    n = F.col("n")
    long = cells.select(*by, F.inline(F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), n).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), n.alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )))
    sums = long.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("predicted")), zero)
    r = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), zero)
    f = F.coalesce(F.try_divide(F.col("hit") * 2.0, F.col("predicted") + F.col("support")), zero)
    return sums.select(*by, "class", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support", "hit")


def weighted_scores(classes: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Support-weighted averages and accuracy of a per-class table."""
    by = [col(g) for g in groups]
    total = F.sum("support").cast("double")

    def weighted(c: str) -> Column:
        return F.round(F.sum(F.col(c) * F.col("support")) / total, DIGITS).alias(c)

    return classes.groupBy(*by).agg(
        F.round(F.sum("hit") / total, DIGITS).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def weighted_prf(df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    return weighted_scores(per_class(cell_counts(df, label, prediction, groups), groups), groups)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then macro avg, weighted avg and accuracy."""
    classes = per_class(cell_counts(df, label, prediction))
    shown = classes.select(F.col("class").cast("string").alias("class"), *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")
    total = F.sum("support")

    def row(name: str, mean) -> DataFrame:
        return classes.agg(*[F.round(mean(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(
            F.lit(name).alias("class"), "precision", "recall", "f1", "support")

    macro = row("macro avg", lambda c: F.avg(c))
    weighted = row("weighted avg", lambda c: F.sum(F.col(c) * F.col("support")) / total)
    acc = row("accuracy", lambda c: F.sum("hit") / total)
    return shown.unionByName(macro).unionByName(weighted).unionByName(acc)


def auc_table(df: DataFrame, groups: Sequence[str], positive: str, score: str) -> DataFrame:
    """Rank-sum AUC per group, ties counted half.

    Rows are first merged per score. Few distinct scores are ordered in one window per group; many are
    ordered by range partitions with offsets.
    """
    by = [col(g) for g in groups]
    merged = df.groupBy(*by, col(score).cast("double").alias("s")).agg(
        F.sum(col(positive).cast("long")).alias("p"), F.count("*").alias("n")).withColumn("q", F.col("n") - F.col("p"))
    if merged.limit(ORDERED_SCORES + 1).count() <= ORDERED_SCORES:
        before = W.partitionBy(*by).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
        ranked = merged.withColumn("below", F.coalesce(F.sum("q").over(before), F.lit(0)))
    else:
        ranked = running_total(merged, ["s"], {"below": "q"}, list(groups))
    area = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0))
    pairs = F.sum("p").cast("double") * F.sum("q")
    return ranked.groupBy(*by).agg(F.try_divide(area, pairs).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("n"))


ORDERED_SCORES = 100_000


def auc_binary(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    marked = df.select((col(label) == 1).cast("int").alias("pos"), col(score).alias("score"))
    return auc_table(marked, [], "pos", "score").select(F.round("auc", DIGITS).alias("roc_auc"))


def auc_one_vs_rest(df: DataFrame, scores: dict[object, str], label: str = "label") -> DataFrame:
    """Prevalence-weighted mean of the per-class AUCs; missing when a class never or always occurs."""
    entries = [F.struct(F.lit(str(k)).alias("class"), (col(label) == F.lit(k)).cast("int").alias("pos"), col(c).cast("double").alias("score")) for k, c in scores.items()]
    long = df.select(F.inline(F.array(*entries)))
    table = auc_table(long, ["class"], "pos", "score")
    weight = F.sum("positives").cast("double")
    value = F.when(F.count("auc") == F.count("*"), F.sum(F.col("auc") * F.col("positives")) / weight)
    return table.agg(F.round(value, DIGITS).alias("roc_auc"))


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    sums = df.groupBy(*[col(g) for g in groups]).agg(
        F.avg(e * e).alias("__mse"), F.avg(F.abs(e)).alias("__mae"), F.var_pop(y).alias("__var"))
    return sums.select(
        *[col(g) for g in groups],
        F.round("__mse", DIGITS).alias("mse"), F.round(F.sqrt("__mse"), DIGITS).alias("rmse"), F.round("__mae", DIGITS).alias("mae"),
        F.round(F.lit(1.0) - F.try_divide(F.col("__mse"), F.col("__var")), DIGITS).alias("r2"))


def rank_models(scores: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """rank 1 is the best; ties in name order. One row per model."""
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last(metric), name)))


def compare_models(ranked: DataFrame, metrics: Sequence[str], name: str = "model") -> DataFrame:
    return ranked.select(name, *metrics, "rank").orderBy("rank")
