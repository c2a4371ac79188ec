"""New columns: products, date parts, rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col, numeric_columns
from ..functions.ordering import row_index
from ..functions.staging import materialise
from .roles import find_datetime_column

POLY_COLUMNS, POLY_NEW, INTERACTION_COLUMNS, ROLLING_COLUMNS = 10, 50, 8, 5
WINDOWS = (3, 5, 10)
TIME_PARTS = ("hour", "dayofweek", "month", "day", "quarter", "is_weekend")
BUCKET_ROWS = 200_000


def _product(parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a * b, [col(p).cast("double") for p in parts])


def _power_name(parts: Sequence[str]) -> str:
    names = []
    for p in dict.fromkeys(parts):
        n = parts.count(p)
        names.append(p if n == 1 else f"{p}^{n}")
    return "_".join(names)


def polynomial_terms(columns: Sequence[str], degree: int = 2, interaction_only: bool = False, max_features: int | None = POLY_NEW) -> list[tuple[str, tuple[str, ...]]]:
    """Names and factors of the terms of degree 2 and more, in graded order."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [(_power_name(t), t) for d in range(2, degree + 1) for t in pick(columns, d)]
    return terms[:max_features]


def add_polynomial(df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2, interaction_only: bool = False, max_features: int | None = POLY_NEW, exclude: Sequence[str] = (), max_columns: int | None = POLY_COLUMNS) -> DataFrame:
    """Products of the named columns, all of them; without names, of the first ``max_columns`` numeric ones (None: all).

    ``max_features`` bounds the number of new columns (None: all terms).
    """
    columns = list(columns) if columns else numeric_columns(df, exclude)[:max_columns]
    if len(columns) < 2:
        return df
    terms = polynomial_terms(columns, degree, interaction_only, max_features)
    return df.select("*", *[_product(t).alias(n) for n, t in terms])


def add_interactions(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), max_columns: int | None = INTERACTION_COLUMNS) -> DataFrame:
    """Pairwise products of the named columns, all of them; without names, of the first ``max_columns`` numeric ones (None: all)."""
    columns = list(columns) if columns else numeric_columns(df, exclude)[:max_columns]
    return df.select("*", *[_product((a, b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def add_time_parts(df: DataFrame, column: str | None = None) -> DataFrame:
    """hour, dayofweek (Monday is 0), month, day, quarter, is_weekend; text that does not parse is missing."""
    column = column or find_datetime_column(df)
    if column is None:
        return df
    t = F.try_to_timestamp(col(column).cast("string")) if dict(df.dtypes)[column] == "string" else col(column)
    day = F.weekday(t)
    parts = {
        "hour": F.hour(t), "dayofweek": day, "month": F.month(t), "day": F.dayofmonth(t), "quarter": F.quarter(t),
        "is_weekend": F.when(day >= 5, 1).otherwise(0),
    }
    return df.select("*", *[parts[p].alias(f"{column}_{p}") for p in TIME_PARTS])


def _rolling_exprs(columns: Sequence[str], windows: Sequence[int], frame) -> list[Column]:
    out = []
    for c in columns:
        for w in windows:
            over = frame.rowsBetween(-(w - 1), 0)
            out += [F.avg(col(c)).over(over).alias(f"{c}_rolling_mean_{w}"), F.stddev_samp(col(c)).over(over).alias(f"{c}_rolling_std_{w}")]
    return out


def add_rolling(
    df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, windows: Sequence[int] = WINDOWS,
    within: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS, max_columns: int | None = ROLLING_COLUMNS,
) -> DataFrame:
    """Mean and standard deviation over the last w rows, optionally inside each group.

    All named columns are used; without names, the first ``max_columns`` numeric ones (None: all).

    Small groups are plain windows. Without groups, or when one group is larger than a bucket, rows get a
    distributed position, are cut into buckets, and the last rows of each bucket are copied into the next
    one, so no task ever holds a whole group.
    """
    columns = list(columns) if columns else numeric_columns(df, [*order, *within])[:max_columns]
    groups = [col(c) for c in within]
    largest = df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    windows = [w for w in windows if largest["all"] and largest["all"] >= w]
    if not windows or not columns:
        return df
    if within and largest["top"] <= bucket_rows:
        frame = W.partitionBy(*groups).orderBy(*[col(c) for c in order])
        return df.select("*", *_rolling_exprs(columns, windows, frame))
    bucket_rows = max(bucket_rows, max(windows))
    halo = max(windows) - 1
    placed = row_index(df, order, within, "__pos")
    home = F.floor(F.col("__pos") / bucket_rows)
    # a row near the end of its bucket also appears, marked, in the next one
    spill = F.col("__pos") % bucket_rows >= bucket_rows - halo
    copies = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("__home", home).withColumn("__bucket", F.explode(copies))
    frame = W.partitionBy(*groups, "__bucket").orderBy("__pos")
    rolled = spread.select("*", *_rolling_exprs(columns, windows, frame))
    return rolled.filter(F.col("__bucket") == F.col("__home")).drop("__pos", "__home", "__bucket")


@dataclass
class FeaturePlan:
    """Which columns to build and, after selection, which to keep."""

    time_column: str | None = None
    polynomial: list[str] = field(default_factory=list)
    degree: int = 2
    interactions: list[str] = field(default_factory=list)
    rolling: dict[str, Any] | None = None
    keep: list[str] | None = None
    facts: list[tuple[str, str, str, float]] = field(default_factory=list)

    def build(self, df: DataFrame) -> DataFrame:
        if self.polynomial:
            df = add_polynomial(df, self.polynomial, self.degree)
        if self.interactions:
            df = add_interactions(df, self.interactions)
        if self.rolling:
            df = add_rolling(df, **self.rolling)
        return df

    def select(self, df: DataFrame) -> DataFrame:
        return df if self.keep is None else df.select(*[col(c) for c in df.columns if c in set(self.keep)])

    def apply(self, df: DataFrame) -> DataFrame:
        return self.select(self.build(df))


def _first(plan: FeaturePlan, step: str, columns: list[str], limit: int | None) -> list[str]:
    """The first ``limit`` columns (None: all); what is left out becomes a fact of the report."""
    if limit is not None and len(columns) > limit:
        plan.facts.append(("left out", step, "columns", float(len(columns) - limit)))
    return columns[:limit]


def fit_feature_plan(df: DataFrame, config: dict[str, Any] | None, target: str | None, task: str, exclude: Sequence[str] = ()) -> FeaturePlan:
    """Creation settings, then selection fitted on the created columns. The target is never an input."""
    from .select import select_features  # noqa: PLC0415

    config = dict(config or {})
    skip = [c for c in (target, *exclude) if c]
    plan = FeaturePlan(degree=config.get("polynomial_degree", 2))
    numeric = numeric_columns(df, skip)
    if config.get("polynomial") and len(numeric) >= 2:
        plan.polynomial = _first(plan, "polynomial", numeric, config.get("polynomial_columns", POLY_COLUMNS))
        plan.facts.append(("created", "polynomial", f"degree {plan.degree}", float(len(polynomial_terms(plan.polynomial, plan.degree)))))
    if config.get("interactions"):
        # like every later step, interactions see the columns created before them
        before = numeric_columns(plan.build(df), skip) if plan.polynomial else numeric
        plan.interactions = _first(plan, "interactions", before, config.get("interaction_columns", INTERACTION_COLUMNS))
        n = len(plan.interactions)
        plan.facts.append(("created", "interactions", "pairs", float(n * (n - 1) // 2)))
    if config.get("aggregations"):
        if not config.get("order"):
            raise ValueError("rolling features need order columns")
        rolled = _first(plan, "aggregations", numeric, config.get("rolling_columns", ROLLING_COLUMNS))
        plan.rolling = {"order": config["order"], "within": config.get("within", ()), "columns": rolled}
        plan.facts.append(("created", "aggregations", "rolling", float(2 * len(WINDOWS) * len(rolled))))
    method = config.get("selection_method", config.get("selection"))
    if method and method != "none" and target and target in df.columns:
        built = plan.build(df)
        if plan.polynomial or plan.interactions or plan.rolling:
            built = materialise(built, "built")  # a selection reads them many times
        chosen = select_features(built, target, method, task, config.get("n_select"), exclude)
        if chosen is not None:
            numeric_all = set(numeric_columns(built))
            plan.keep = [c for c in built.columns if c in set(chosen) or c == target or c in set(exclude) or c not in numeric_all]
            plan.facts.append(("selected", method, "kept", float(len(chosen))))
    return plan


def engineer(df: DataFrame, config: dict[str, Any] | None = None, target: str | None = None, task: str = "classification") -> DataFrame:
    """Date parts first (so text dates are still text), then products, rolling statistics and selection."""
    config = dict(config or {})
    if config.get("time_features", True):
        df = add_time_parts(df)
    plan = fit_feature_plan(df, config, target, task)
    return plan.apply(df)
