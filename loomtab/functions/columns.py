"""Column roles resolved from the schema alone, and small column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Pandas-style type names shown in previews.
TYPE_LABELS = {
    "byte": "int64",
    "short": "int64",
    "integer": "int64",
    "long": "int64",
    "float": "float64",
    "double": "float64",
    "string": "object",
    "boolean": "bool",
    "date": "datetime64",
    "timestamp": "datetime64",
    "timestamp_ntz": "datetime64",
}


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def type_label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return "float64"
    return TYPE_LABELS.get(dtype.typeName(), "object")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def other_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if not is_numeric(f.dataType) and f.name not in skip]


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make missing one concept: NaN in a floating column becomes NULL."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floating}) if floating else df


def missing(c: Column) -> Column:
    return c.isNull()


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent, 0 when the whole is empty."""
    ratio = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return F.round(F.coalesce(ratio, F.lit(0.0)), digits)


def shuffle_key(seed: int | str, *keys: Column) -> Column:
    """Stable pseudo-random order of rows: the same on every engine and every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def unit_interval(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the keys."""
    return F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which missing keys match each other; keeps the left key columns."""
    renamed = right.select(*[col(c).alias(f"__r_{c}") if c in on else col(c) for c in right.columns])
    condition = None
    for c in on:
        test = col(c).eqNullSafe(col(f"__r_{c}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def to_long(df: DataFrame, exprs: dict[str, Sequence[Column]], names: Sequence[str], label: str = "column") -> DataFrame:
    """Turn one wide row of statistics into one row per column (a projection, no shuffle)."""
    rows = [
        F.struct(F.lit(c).alias(label), *[e.alias(n) for e, n in zip(values, names)])
        for c, values in exprs.items()
    ]
    return df.select(F.inline(F.array(*rows)))
