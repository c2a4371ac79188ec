"""Missing values, duplicate rows and outliers. Fitting is aggregates; applying is column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import col, count_when, numeric_columns, to_long
from ..functions.quantiles import medians, outlier_fences
from .profile import modes, numbers_long

STRATEGIES = ("auto", "mean", "median", "mode")


# missing values ------------------------------------------------------------------------------------
def strategy_for(strategy: str, numeric: bool) -> str:
    """mean and median only make sense for numbers; text always takes the most frequent value."""
    if not numeric:
        return "mode"
    return "mean" if strategy == "auto" else strategy


def fit_fill_values(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None) -> dict[str, dict[str, Any]]:
    """{column: {strategy, count, value}} for the columns that have something to fill."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    columns = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    holes = {c: counted["n"] - counted[f"f{i}"] for i, c in enumerate(columns)}
    holes = {c: n for c, n in holes.items() if n}
    numeric = set(numeric_columns(df))
    plan = {c: strategy_for(strategy, c in numeric) for c in holes}
    values: dict[str, Any] = {}
    means = [c for c, s in plan.items() if s == "mean"]
    if means:
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(means)]).first()
        values.update({c: row[f"m{i}"] for i, c in enumerate(means)})
    mids = [c for c, s in plan.items() if s == "median"]
    if mids:
        values.update(medians(df, mids))
    often = [c for c, s in plan.items() if s == "mode"]
    if often:
        values.update({c: v for c, (v, _) in modes(df, often).items()})
    return {c: {"strategy": plan[c], "count": holes[c], "value": values[c]} for c in holes if values.get(c) is not None}


def apply_fill_values(df: DataFrame, fills: dict[str, dict[str, Any]]) -> DataFrame:
    """A filled integer column becomes double when the fill value is not whole."""
    filled = {}
    for c, f in fills.items():
        if c not in df.columns:
            continue
        kind = df.schema[c].dataType
        value = F.lit(f["value"])
        if isinstance(kind, T.NumericType):
            whole = f["strategy"] == "mode" or float(f["value"]).is_integer()
            filled[c] = F.coalesce(col(c), value.cast(kind)) if whole else F.coalesce(col(c).cast("double"), value)
        else:
            filled[c] = F.coalesce(col(c), value.cast(kind))
    return df.withColumns(filled) if filled else df


def impute(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None) -> DataFrame:
    if strategy == "drop":
        return df.na.drop(subset=list(columns or df.columns))
    return apply_fill_values(df, fit_fill_values(df, strategy, columns))


def impute_report(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """What would be filled: strategy, count and value per column."""
    rows = []
    for c, f in fit_fill_values(df, strategy, columns).items():
        shown = f"{f['value']:.{digits}f}" if f["strategy"] in ("mean", "median") else str(f["value"])
        rows.append((c, f["strategy"], f["count"], shown))
    return df.sparkSession.createDataFrame(rows, "column string, strategy string, n_filled long, fill_value string")


# duplicates ----------------------------------------------------------------------------------------
def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()) -> DataFrame:
    """Whole-row copies, or one row per key in an explicit order.

    The rank is trimmed to one row per key and task before the shuffle, so a key with very many copies
    does not travel to one task.
    """
    if subset is None:
        return df.dropDuplicates()
    if not order:
        raise ValueError("keeping the first or last row of a key needs an order")
    sort = [col(c).asc() if keep == "first" else col(c).desc() for c in order]
    rank = F.row_number().over(W.partitionBy(*[col(c) for c in subset]).orderBy(*sort))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


# outliers ------------------------------------------------------------------------------------------
def zscore_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 3.0, sample_std: bool = False) -> dict[str, tuple[float, float]]:
    spread = F.stddev_samp if sample_std else F.stddev_pop
    stats = numbers_long(df, columns).groupBy("column").agg(F.avg("x").alias("m"), spread("x").alias("s")).collect()
    return {r["column"]: (r["m"] - threshold * r["s"], r["m"] + threshold * r["s"]) for r in stats if r["s"] is not None}


def outlier_bounds(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, threshold: float | None = None) -> dict[str, tuple[float, float]]:
    columns = list(columns or numeric_columns(df))
    if not columns:
        return {}
    if method == "iqr":
        return outlier_fences(df, columns)
    if method == "zscore":
        return zscore_bounds(df, columns, threshold or 3.0)
    raise ValueError(f"unknown outlier method: {method}")


def outside(c: str, bounds: tuple[float, float]) -> Column:
    return (col(c) < F.lit(bounds[0])) | (col(c) > F.lit(bounds[1]))


def count_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not bounds:
        return {}
    row = df.agg(*[count_when(outside(c, b)).alias(f"o{i}") for i, (c, b) in enumerate(bounds.items())]).first()
    return {c: row[f"o{i}"] for i, c in enumerate(bounds)}


def outlier_report(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, threshold: float | None = None, digits: int = 4) -> DataFrame:
    bounds = outlier_bounds(df, method, columns, threshold)
    wide = df.agg(*[count_when(outside(c, b)).alias(f"o{i}") for i, (c, b) in enumerate(bounds.items())])
    exprs = {c: [F.col(f"o{i}"), F.round(F.lit(b[0]), digits), F.round(F.lit(b[1]), digits)] for i, (c, b) in enumerate(bounds.items())}
    return to_long(wide, exprs, ["outliers", "lower_bound", "upper_bound"])


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    clipped = {
        c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(low)), F.lit(high)))
        for c, (low, high) in bounds.items() if c in df.columns
    }
    return df.withColumns(clipped) if clipped else df


def null_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    blanked = {c: F.when(~outside(c, b), col(c)) for c, b in bounds.items() if c in df.columns}
    return df.withColumns(blanked) if blanked else df


def remove_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside all bounds; a missing value counts as outside, as in a plain comparison."""
    for c, (low, high) in bounds.items():
        df = df.filter(col(c).between(F.lit(low), F.lit(high)))
    return df


def handle_outliers(
    df: DataFrame, method: str = "iqr", action: str = "clip", columns: Sequence[str] | None = None,
    threshold: float | None = None, compat: bool = False,
) -> DataFrame:
    """clip, nan or remove. Only columns that have an outlier are touched.

    ``compat`` recomputes z-score bounds column after column on the rows that are left when removing, and
    takes the sample standard deviation for the bounds of the z-score method.
    """
    columns = list(columns or numeric_columns(df))
    if method == "isolation_forest":
        from .isolation import handle_isolated  # noqa: PLC0415
        return handle_isolated(df, action, columns, contamination=threshold or 0.05)
    bounds = outlier_bounds(df, method, columns, threshold)
    hits = count_outliers(df, bounds)
    touched = {c: b for c, b in bounds.items() if hits[c]}
    if compat and method == "zscore":
        if action == "remove":
            for c in touched:
                df = remove_outliers(df, zscore_bounds(df, [c], threshold or 3.0, sample_std=True))
            return df
        touched = zscore_bounds(df, list(touched), threshold or 3.0, sample_std=True) if touched else {}
    actions = {"clip": clip_outliers, "nan": null_outliers, "remove": remove_outliers}
    if action not in actions:
        raise ValueError(f"unknown outlier action: {action}")
    return actions[action](df, touched)


# composed ------------------------------------------------------------------------------------------
@dataclass
class CleanPlan:
    """Fitted cleaning: bounds and fill values. ``apply`` never changes the number of rows."""

    action: str = "clip"
    method: str = "none"
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, dict[str, Any]] = field(default_factory=dict)
    facts: list[tuple[str, str, str, float]] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.bounds and self.action in ("clip", "nan"):
            df = (clip_outliers if self.action == "clip" else null_outliers)(df, self.bounds)
        return apply_fill_values(df, self.fills)


def clean_settings(config: dict[str, Any] | None) -> dict[str, Any]:
    """Defaults, with the planner's alternative key names accepted."""
    config = dict(config or {})
    return {
        "remove_duplicates": config.get("remove_duplicates", True),
        "outlier_method": config.get("outlier_method", config.get("outliers", "iqr")) or "none",
        "outlier_action": config.get("outlier_action", "clip"),
        "imputation": config.get("imputation", config.get("missing_values", "auto")) or "none",
    }


def fit_clean(df: DataFrame, config: dict[str, Any] | None = None, exclude: Sequence[str] = ()) -> tuple[DataFrame, CleanPlan]:
    """Deduplicate, treat outliers, fill. Returns the cleaned rows and the plan for other tables.

    ``exclude`` (the target) is never clipped or filled. Row-dropping choices act on the given rows only.
    """
    s = clean_settings(config)
    plan = CleanPlan(action=s["outlier_action"], method=s["outlier_method"])
    out = df
    if s["remove_duplicates"]:
        out = drop_duplicates(out)
    columns = numeric_columns(out, exclude)
    if s["outlier_method"] == "isolation_forest":
        out = handle_outliers(out, "isolation_forest", s["outlier_action"], columns)
    elif s["outlier_method"] != "none":
        bounds = outlier_bounds(out, s["outlier_method"], columns)
        hits = count_outliers(out, bounds)
        plan.bounds = {c: b for c, b in bounds.items() if hits[c]}
        plan.facts += [("outliers", c, f"{s['outlier_method']}/{s['outlier_action']}", float(hits[c])) for c in plan.bounds]
        out = remove_outliers(out, plan.bounds) if s["outlier_action"] == "remove" else plan.apply(out)
    fillable = [c for c in out.columns if c not in set(exclude)]
    if s["imputation"] == "drop":
        out = out.na.drop(subset=fillable)
    elif s["imputation"] == "knn":
        from .neighbors import knn_impute  # noqa: PLC0415
        out = knn_impute(out, numeric_columns(out, exclude))
        plan.fills = fit_fill_values(out, "auto", fillable)
        # rows that arrive later are filled with the means of the completed training rows
        row = out.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first() if columns else None
        late = {c: {"strategy": "mean", "count": 0, "value": row[f"m{i}"]} for i, c in enumerate(columns) if row[f"m{i}"] is not None}
        out = apply_fill_values(out, plan.fills)
        plan.fills = {**late, **plan.fills}
    elif s["imputation"] != "none":
        plan.fills = fit_fill_values(out, s["imputation"], fillable)
        out = apply_fill_values(out, plan.fills)
    plan.facts += [("missing_values", c, f["strategy"], float(f["count"])) for c, f in plan.fills.items()]
    return out, plan


def clean(df: DataFrame, config: dict[str, Any] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    return fit_clean(df, config, exclude)[0]
