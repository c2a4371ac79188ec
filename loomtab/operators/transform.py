"""Encoding, non-linear transforms and scaling. Every fitted state is small and applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, numeric_columns, text_columns
from ..functions.ordering import row_index
from ..functions.quantiles import exact_quantiles
from ..functions.staging import materialise
from .profile import filled_and_distinct, numbers_long

ONEHOT_MAX = 20
AUTO_ONEHOT_MAX = 10
DICTIONARY_ROWS = 50_000


def distinct_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """The exact number of distinct values of each column, all columns in one pass."""
    return dict(zip(columns, (kinds for _, kinds in filled_and_distinct(df, columns)[1]))) if columns else {}


# label encoding ------------------------------------------------------------------------------------
def label_dictionary(df: DataFrame, column: str, size: int) -> DataFrame:
    """(value, code) with codes in value order; a large dictionary is numbered and kept as a written table."""
    values = df.select(col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    if size <= DICTIONARY_ROWS:
        known = sorted(r["value"] for r in values.collect())
        return df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(known)], "value string, code double")
    return materialise(row_index(values, ["value"], name="code").withColumn("code", F.col("code").cast("double")), "labels")


def apply_label(df: DataFrame, column: str, dictionary: DataFrame, size: int) -> DataFrame:
    side = F.broadcast(dictionary) if size <= DICTIONARY_ROWS else dictionary
    names = [c if c != column else "__code" for c in df.columns]
    joined = df.join(side.select(F.col("value").alias("__value"), F.col("code").alias("__code")), col(column).cast("string") == F.col("__value"), "left")
    return joined.select(*[F.col("__code").alias(column) if n == "__code" else col(n) for n in names])


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or text_columns(df))
    sizes = distinct_sizes(df, columns)
    for c in columns:
        df = apply_label(df, c, label_dictionary(df, c, sizes[c]), sizes[c])
    return df


# one-hot encoding ----------------------------------------------------------------------------------
def onehot_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of columns already known to have few of them."""
    if not columns:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"v{i}"]) for i, c in enumerate(columns)}


def apply_onehot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """0/1 columns for all but the first category; a missing or unseen value is all zeros."""
    kept = [col(c) for c in df.columns if c not in categories]
    added = [
        F.when(col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}")
        for c, values in categories.items() for v in values[1:]
    ]
    return df.select(*kept, *added)


def onehot_encode(df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = ONEHOT_MAX) -> DataFrame:
    columns = list(columns or text_columns(df))
    sizes = distinct_sizes(df, columns)
    return apply_onehot(df, onehot_categories(df, [c for c in columns if sizes[c] <= max_categories]))


# target encoding -----------------------------------------------------------------------------------
def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.avg(col(target)).alias("code"))


def target_encode(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of the target per value. The join side is one row per value; its size picks the join."""
    for c in columns or text_columns(df, [target]):
        if c == target:
            continue
        df = _replace_by(df, c, target_means(df, c, target))
    return df


def _replace_by(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    side = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = df.join(side, col(column) == F.col("__value"), "left")
    return joined.select(*[F.col("__code").alias(column) if c == column else col(c) for c in df.columns])


# scaling -------------------------------------------------------------------------------------------
def fit_scaler(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """{column: (shift, divisor)}; a column without spread is only shifted."""
    columns = [c for c in (columns or numeric_columns(df)) if c not in set(exclude)]
    if not columns:
        return {}
    if method == "robust":
        q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
        pairs = {c: (v[1], v[2] - v[0]) for c, v in q.items() if v[1] is not None}
    else:
        rows = numbers_long(df, columns).groupBy("column").agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
        if method == "minmax":
            pairs = {r["column"]: (r["lo"], r["hi"] - r["lo"]) for r in rows if r["lo"] is not None}
        else:
            pairs = {r["column"]: (r["m"], r["s"]) for r in rows if r["m"] is not None}
    return {c: (pairs[c][0], pairs[c][1] or 1.0) for c in columns if c in pairs}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    scaled = {c: (col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in scaler.items() if c in df.columns}
    return df.withColumns(scaled) if scaled else df


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, method, columns, exclude))


# non-linear transforms -----------------------------------------------------------------------------
def log_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with no negative and no missing value."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return []
    row = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(columns) for e in (F.count(col(c)).alias(f"f{i}"), F.min(col(c)).alias(f"m{i}"))]).first()
    return [c for i, c in enumerate(columns) if row["n"] and row[f"f{i}"] == row["n"] and row[f"m{i}"] >= 0]


def apply_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(col(c).cast("double")) for c in columns}) if columns else df


def log_transform(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return apply_log(df, log_columns(df, columns))


def boxcox_expr(column: str, lam: float):
    x = col(column).cast("double")
    inner = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
    return F.when(x > 0, inner)


def fit_boxcox(df: DataFrame, columns: Sequence[str] | None = None, low: float = -2.0, high: float = 2.0, points: int = 17, passes: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda per strictly positive column.

    Each pass scores a grid of lambdas for all columns in one grouped aggregate and narrows around the best.
    Values are taken relative to the geometric mean, which leaves the maximum in place and keeps powers small.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        return {}
    x = F.col("x")
    stats = numbers_long(df, columns).filter(x.isNotNull()).groupBy("column").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.avg(F.when(x > 0, F.log(x))).alias("mlog"), F.max("x").alias("hi")).collect()
    center = {r["column"]: r["mlog"] for r in stats if r["n"] > 3 and r["lo"] > 0 and r["hi"] > r["lo"]}
    if not center:
        return {}
    spans = {c: (low, high) for c in center}
    best: dict[str, float] = {}
    for _ in range(passes):
        entries, grids = [], {}
        for c in center:
            a, b = spans[c]
            grids[c] = [a + (b - a) * i / (points - 1) for i in range(points)]
            u = F.log(col(c).cast("double")) - F.lit(center[c])
            entries.append(F.struct(F.lit(c).alias("column"), u.alias("u"), F.array(*[F.lit(g) for g in grids[c]]).alias("grid")))
        long = df.select(F.inline(F.array(*entries))).filter(F.col("u").isNotNull())
        long = long.select("column", "u", F.posexplode("grid").alias("i", "lam"))
        y = F.when(F.abs("lam") < 1e-12, F.col("u")).otherwise(F.expm1(F.col("lam") * F.col("u")) / F.nullif(F.col("lam"), F.lit(0.0)))
        scored = long.groupBy("column", "i").agg(F.var_pop(y).alias("v")).collect()
        # centred logs sum to zero, so the likelihood is largest where the variance is smallest
        for c in center:
            at = min((r["v"], r["i"]) for r in scored if r["column"] == c and r["v"])[1]
            step = (spans[c][1] - spans[c][0]) / (points - 1)
            best[c] = grids[c][at]
            spans[c] = (best[c] - step, best[c] + step)
    return best


def apply_boxcox(df: DataFrame, lambdas: dict[str, float]) -> DataFrame:
    return df.withColumns({c: boxcox_expr(c, lam) for c, lam in lambdas.items() if c in df.columns}) if lambdas else df


# composed ------------------------------------------------------------------------------------------
@dataclass
class TransformPlan:
    """Fitted encoding, non-linear step and scaling."""

    onehot: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, tuple[int, DataFrame]] = field(default_factory=dict)
    targets: dict[str, DataFrame] = field(default_factory=dict)
    logs: list[str] = field(default_factory=list)
    lambdas: dict[str, float] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    facts: list[tuple[str, str, str, float]] = field(default_factory=list)

    def encode(self, df: DataFrame) -> DataFrame:
        for c, codes in self.targets.items():
            df = _replace_by(df, c, codes)
        for c, (size, dictionary) in self.labels.items():
            df = apply_label(df, c, dictionary, size)
        return apply_onehot(df, self.onehot) if self.onehot else df

    def apply(self, df: DataFrame) -> DataFrame:
        return apply_scaler(apply_boxcox(apply_log(self.encode(df), self.logs), self.lambdas), self.scaler)


def fit_transform_plan(df: DataFrame, config: dict[str, Any] | None = None, target: str | None = None, exclude: Sequence[str] = ()) -> TransformPlan:
    """encoding auto | onehot | label | target | none, nonlinear log | boxcox, scaling standard | minmax | robust | none.

    The target and the excluded columns take no part in any stage.
    """
    return fit_transform(df, config, target, exclude)[0]


def fit_transform(df: DataFrame, config: dict[str, Any] | None = None, target: str | None = None, exclude: Sequence[str] = ()) -> tuple[TransformPlan, DataFrame]:
    """The plan, and ``df`` transformed by it. Codes are joined once and written, as the later fits read them again and again."""
    config = dict(config or {})
    encoding, scaling, nonlinear = config.get("encoding", "auto"), config.get("scaling", "standard"), config.get("nonlinear")
    skip = [c for c in (target, *exclude) if c]
    plan = TransformPlan()
    text = text_columns(df, skip)
    sizes = distinct_sizes(df, text) if text and encoding and encoding != "none" else {}
    if encoding == "auto":
        low = [c for c in text if sizes[c] <= AUTO_ONEHOT_MAX]
        plan.onehot = onehot_categories(df, low)
        plan.labels = {c: (sizes[c], label_dictionary(df, c, sizes[c])) for c in text if c not in set(low)}
    elif encoding == "label":
        plan.labels = {c: (sizes[c], label_dictionary(df, c, sizes[c])) for c in text}
    elif encoding == "onehot":
        plan.onehot = onehot_categories(df, [c for c in text if sizes[c] <= ONEHOT_MAX])
        plan.facts += [("encoding", c, "skipped", float(sizes[c])) for c in text if sizes[c] > ONEHOT_MAX]
    elif encoding == "target" and target:
        plan.targets = {c: materialise(target_means(df, c, target), "means") for c in text}
    plan.facts += [("encoding", c, "onehot", float(len(v))) for c, v in plan.onehot.items()]
    plan.facts += [("encoding", c, "label", float(s)) for c, (s, _) in plan.labels.items()]
    plan.facts += [("encoding", c, "target", float(sizes[c])) for c in plan.targets]
    encoded = plan.encode(df)
    if plan.targets or plan.labels:
        encoded = materialise(encoded, "encoded")
    numeric = numeric_columns(encoded, skip)
    if nonlinear == "log":
        plan.logs = log_columns(encoded, numeric)
        encoded = apply_log(encoded, plan.logs)
        plan.facts += [("nonlinear", c, "log", 1.0) for c in plan.logs]
    elif nonlinear == "boxcox":
        plan.lambdas = fit_boxcox(encoded, numeric)
        encoded = apply_boxcox(encoded, plan.lambdas)
        plan.facts += [("nonlinear", c, "boxcox", round(v, 4)) for c, v in plan.lambdas.items()]
    if scaling and scaling != "none":
        plan.scaler = fit_scaler(encoded, scaling, numeric)
        plan.facts += [("scaling", c, scaling, 1.0) for c in plan.scaler]
    return plan, apply_scaler(encoded, plan.scaler)


def transform(df: DataFrame, config: dict[str, Any] | None = None, target: str | None = None) -> DataFrame:
    return fit_transform(df, config, target)[1]

