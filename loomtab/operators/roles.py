"""What a column is for: task detection, label preparation, date column search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, is_integer, is_numeric, is_temporal, text_columns

MAX_CLASS_VALUES = 20


def task_of(dtype: T.DataType, n_distinct: int) -> str:
    if n_distinct == 0 or isinstance(dtype, (T.StringType, T.BooleanType)):
        return "classification"
    if is_integer(dtype) and n_distinct <= MAX_CLASS_VALUES:
        return "classification"
    return "regression"


def task_per_column(df: DataFrame) -> DataFrame:
    """The task each column would give as a target, from one aggregate."""
    from .profile import distinct_counts  # noqa: PLC0415

    wide = distinct_counts(df, df.columns)
    rows = []
    for i, f in enumerate(df.schema):
        n = F.col(f"d{i}")
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            task = F.lit("classification")
        elif is_integer(f.dataType):
            task = F.when(n <= MAX_CLASS_VALUES, "classification").otherwise("regression")
        else:
            task = F.when(n == 0, "classification").otherwise("regression")
        rows.append(F.struct(F.lit(f.name).alias("column"), n.alias("n_distinct"), task.alias("task")))
    return wide.select(F.inline(F.array(*rows)))


MAX_CLASSES = 10_000


def detect_task(df: DataFrame, target: str) -> str:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    dtype = df.schema[target].dataType
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "classification"
    if not is_integer(dtype):
        return "classification" if df.filter(col(target).isNotNull()).isEmpty() else "regression"
    # 21 distinct values settle the question; no need to count them all
    seen = df.select(col(target)).filter(col(target).isNotNull()).distinct().limit(MAX_CLASS_VALUES + 1).count()
    return task_of(dtype, seen)


def prepare_label(df: DataFrame, target: str, task: str, name: str = "label") -> tuple[DataFrame, list[str] | None]:
    """Add a double label. Classes are numbered in sorted order unless they already are the numbers 0, 1, 2 and so on.

    Returns the table and the sorted class names (None if the target is the label already). Rows without a target are
    kept with a missing label. More than ``MAX_CLASSES`` classes are an error.
    """
    dtype = df.schema[target].dataType
    if task == "regression":
        return df.withColumn(name, col(target).cast("double")), None
    if isinstance(dtype, T.BooleanType):
        return df.withColumn(name, col(target).cast("int").cast("double")), None
    seen = df.select(col(target).cast("string").alias("c")).filter("c is not null").distinct().limit(MAX_CLASSES + 1)
    found = [r["c"] for r in seen.collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
    numeric = is_numeric(dtype)
    classes = sorted(found, key=float) if numeric else sorted(found)
    if numeric and [float(c) for c in classes] == list(range(len(classes))):
        return df.withColumn(name, col(target).cast("double")), None
    return df.withColumn(name, label_index(target, classes)), classes


def label_index(target: str, classes: list[str]):
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1
    return F.when(position >= 0, position.cast("double"))


def find_datetime_column(df: DataFrame) -> str | None:
    """First date column, else the first text column with values that all parse; one pass over all text columns."""
    for f in df.schema:
        if is_temporal(f.dataType):
            return f.name
    names = text_columns(df)
    if not names:
        return None
    row = df.agg(*[f.alias(f"{t}{i}") for i, c in enumerate(names) for t, f in (("n", F.count(col(c))), ("ok", F.count(F.try_to_timestamp(col(c)))))]).first()
    return next((c for i, c in enumerate(names) if row[f"n{i}"] and row[f"n{i}"] == row[f"ok{i}"]), None)
