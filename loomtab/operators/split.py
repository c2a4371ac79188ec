"""Train / validation / test parts and folds by the shuffled order of a unique key.

Membership depends only on (seed, key): not on partitioning, file layout or engine. A part is a comparison
with a cut value, so a table of any size is split without being shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, null_safe_join, shuffle_key
from ..functions.ordering import hash_cuts, row_index

SEED = 42
FEW_CLASSES = 10_000


def _label_parts(df: DataFrame, cuts: DataFrame, key: str, seed: int, within: Sequence[str], few: bool, names: Sequence[str], last: str, column: str) -> DataFrame:
    h = shuffle_key(seed, col(key))
    if within:
        joined = null_safe_join(df, F.broadcast(cuts) if few else cuts, within)
        bounds = [F.col(f"cut_{i}") for i in range(len(names))]
    else:
        row = cuts.first()
        joined, bounds = df, [F.lit(row[f"cut_{i}"]) for i in range(len(names))]
    part = F.lit(last)
    for name, bound in reversed(list(zip(names, bounds))):
        part = F.when(h <= bound, name).otherwise(part)
    return joined.withColumn(column, part).drop(*(c for c in cuts.columns if c not in within))


def _sizes(n: Column, test_size: float, val_size: float) -> list[Column]:
    """test = ceil(n * test); val = ceil(rest * val / (1 - test)), as the usual two-step split."""
    # a hair less before rounding up: n * 0.2 may come out just above a whole number
    test = F.ceil(n * F.lit(test_size) - F.lit(1e-9))
    if val_size <= 0:
        return [test]
    val = F.ceil((n - test) * F.lit(val_size / (1 - test_size)) - F.lit(1e-9))
    return [test, test + val]


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """(number of classes, rows of the smallest one)"""
    row = df.groupBy(col(label)).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    return row["k"], row["n"] or 0


def split(df: DataFrame, key: str, method: str = "random", label: str | None = None, test_size: float = 0.2, val_size: float = 0.0, seed: int = SEED, column: str = "part") -> DataFrame:
    """Add ``part``: train, val or test. A class with fewer than two rows turns stratified into random."""
    within: list[str] = []
    few = True
    if method == "stratified" and label:
        classes, smallest = class_sizes(df, label)
        within, few = ([label] if smallest >= 2 else []), classes <= FEW_CLASSES
    elif method not in ("random", "stratified"):
        raise ValueError(f"unknown split method: {method}")
    names = ["test"] if val_size <= 0 else ["test", "val"]
    cuts = hash_cuts(df, key, seed, lambda n: _sizes(n, test_size, val_size), within, few)
    return _label_parts(df, cuts, key, seed, within, few, names, "train", column)


def split_by_time(df: DataFrame, order: Sequence[str], test_size: float = 0.2, column: str = "part") -> DataFrame:
    """The last int(n * test) rows of the order are test."""
    placed = row_index(df, order, name="__pos")
    n = placed.count()
    first_test = n - int(n * test_size)
    return placed.withColumn(column, F.when(F.col("__pos") >= first_test, "test").otherwise("train")).drop("__pos")


def time_folds(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Expanding-window folds as (row, fold, role): each fold tests one block and trains on all rows before it."""
    placed = row_index(df, order, name="__pos")
    n = placed.count()
    block = n // (k + 1)
    start = n - k * block
    roles = F.array(*[
        F.struct(
            F.lit(f).alias("fold"),
            F.when(F.col("__pos") < start + f * block, "train").when(F.col("__pos") < start + (f + 1) * block, "test").alias("role"),
        ) for f in range(k)
    ])
    return placed.withColumn("__f", F.explode(roles)).filter(F.col("__f.role").isNotNull()).select(
        *[col(c) for c in df.columns], "__f.fold", "__f.role")


def kfold(df: DataFrame, key: str, k: int = 5, label: str | None = None, seed: int = SEED, column: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1: equal blocks of the shuffled order, inside each class if a label is given."""
    within = [label] if label else []
    few = not label or class_sizes(df, label)[0] <= FEW_CLASSES
    cuts = hash_cuts(df, key, seed, lambda n: [F.ceil(n * F.lit(i) / F.lit(k)) for i in range(1, k)], within, few)
    names = [str(i) for i in range(k - 1)]
    out = _label_parts(df, cuts, key, seed, within, few, names, str(k - 1), column)
    return out.withColumn(column, F.col(column).cast("int"))


def split_report(parts: DataFrame, column: str = "part") -> DataFrame:
    return parts.groupBy(column).agg(F.count("*").alias("n"))
