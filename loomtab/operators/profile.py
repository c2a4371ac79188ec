"""Data profiling: each report is a small DataFrame built from one or two aggregates of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import (
    col, count_when, numeric_columns, percent, text_columns, to_long, type_label,
)
from ..functions.quantiles import exact_quantiles

PAIRS_PER_PASS = 50


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i:i + size] for i in range(0, len(items), size)]


# one row about the table ---------------------------------------------------------------------------
def _row_groups(df: DataFrame, *also: Column) -> DataFrame:
    """Identical rows together, by a 128-bit hash of the row with its missing cells marked: only hashes are shuffled."""
    gaps = F.concat(F.lit(""), *[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    cells = [col(c) for c in df.columns]
    keys = (F.xxhash64(F.lit(1), gaps, *cells).alias("__a"), F.xxhash64(F.lit(2), gaps, *cells[::-1]).alias("__b"))
    return df.select(*keys, *also).groupBy("__a", "__b")


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicates: identical rows are counted once and weighted."""
    nulls = sum((F.when(col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    grouped = _row_groups(df, nulls.alias("__nulls")).agg(F.count("*").alias("__n"), F.sum("__nulls").alias("__nulls"))
    cells = F.col("n_rows") * F.lit(len(df.columns))
    return grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("__nulls"), F.lit(0)).alias("total_missing"),
    ).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        "duplicates",
        "total_missing",
        percent(F.col("total_missing"), cells).alias("missing_pct"),
        F.lit(len(numeric_columns(df))).alias("numeric_cols"),
        F.lit(len(text_columns(df))).alias("categorical_cols"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group; missing equals missing."""
    return _row_groups(df).agg(F.count("*").alias("__n")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
    )


def dtype_summary(df: DataFrame) -> DataFrame:
    """How many columns and filled cells each type has."""
    filled = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(type_label(f.dataType)).alias("dtype"), F.col(f"n{i}").alias("filled"))
        for i, f in enumerate(df.schema)
    ]
    long = filled.select(F.inline(F.array(*rows)))
    return long.groupBy("dtype").agg(F.count("*").alias("n_columns"), F.sum("filled").alias("filled_cells"))


# one row per column --------------------------------------------------------------------------------
def filled_and_distinct(df: DataFrame, columns: Sequence[str]) -> tuple[int, list[tuple[int, int]]]:
    """The number of rows, and for each column its filled cells and its distinct values, exactly, in one pass.

    Every cell becomes a narrow row (column, 128-bit hash of the value); equal ones are merged in the tasks before
    anything is shuffled, so a column of few values costs a few rows per task whatever the size of the table.
    """
    none = F.struct(F.lit(-1).alias("c"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    cells = [F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("c"), F.xxhash64(col(c)).alias("a"), F.xxhash64(F.lit(i), col(c)).alias("b"))) for i, c in enumerate(columns)]
    merged = df.select(F.inline(F.array_compact(F.array(none, *cells)))).groupBy("c", "a", "b").agg(F.count("*").alias("n"))
    found = {r["c"]: (r["filled"], r["kinds"]) for r in merged.groupBy("c").agg(F.sum("n").alias("filled"), F.count("*").alias("kinds")).collect()}
    return found.get(-1, (0, 0))[0], [found.get(i, (0, 0)) for i in range(len(columns))]


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """One row with ``n_rows`` and, per column i, ``m{i}`` missing and ``d{i}`` distinct values."""
    if not approx:
        n_rows, found = filled_and_distinct(df, columns)
        numbers = {"n_rows": n_rows, **{f"{t}{i}": v for i, (filled, kinds) in enumerate(found) for t, v in (("m", n_rows - filled), ("d", kinds))}}
        return df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(name) for name, v in numbers.items()])
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"f{i}"), F.approx_count_distinct(col(c)).alias(f"d{i}")]
    wide = df.agg(*aggs)
    return wide.select("*", *[(F.col("n_rows") - F.col(f"f{i}")).alias(f"m{i}") for i in range(len(columns))])


def column_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Name, type, missing and distinct counts with their percentages."""
    wide = distinct_counts(df, df.columns, approx)
    kinds = {f.name: "numeric" if f.name in set(numeric_columns(df)) else "categorical" for f in df.schema}
    n = F.col("n_rows")
    exprs = {
        f.name: [
            F.lit(type_label(f.dataType)), F.lit(kinds[f.name]), F.col(f"m{i}"), percent(F.col(f"m{i}"), n),
            F.col(f"d{i}"), percent(F.col(f"d{i}"), n),
        ]
        for i, f in enumerate(df.schema)
    }
    return to_long(wide, exprs, ["dtype", "kind", "missing", "missing_pct", "n_distinct", "distinct_pct"])


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and share of every column, zeros included."""
    wide = df.agg(F.count("*").alias("n_rows"), *[F.count(col(c)).alias(f"f{i}") for i, c in enumerate(df.columns)])
    n = F.col("n_rows")
    exprs = {c: [n - F.col(f"f{i}"), percent(n - F.col(f"f{i}"), n)] for i, c in enumerate(df.columns)}
    return to_long(wide, exprs, ["missing", "missing_pct"])


def missing_report(df: DataFrame) -> DataFrame:
    """Only the affected columns, worst first."""
    return missing_summary(df).filter(F.col("missing") > 0).orderBy(F.desc("missing"), "column")


def sample_skewness(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def numbers_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x) rows. Grouped by column this keeps one short aggregate instead of hundreds of wide ones,
    and only one partial row per column and task is shuffled."""
    entries = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("x")) for c in columns]
    return df.select(F.inline(F.array(*entries)))


def lookup(values: dict[str, object], key: str = "column", kind: str = "double") -> Column:
    """A literal per column name, for use beside ``numbers_long``."""
    pairs = [F.lit(v) for c, x in values.items() for v in (c, x)]
    return F.try_element_at(F.create_map(*pairs), F.col(key)).cast(kind) if pairs else F.lit(None).cast(kind)


NUMERIC_STATS = ["min", "max", "mean", "median", "std", "skewness", "kurtosis", "zeros", "negatives", "outliers"]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Location, spread, shape and outlier count of each numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    known = {c: q for c, q in quartiles.items() if q[0] is not None}
    fences = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in known.items()}
    x, n, flat = F.col("x"), F.col("n"), F.col("sd") == 0
    entries = []
    for c in columns:
        v = col(c).cast("double")
        low, high = fences.get(c, (0.0, 0.0))
        entries.append(F.struct(F.lit(c).alias("column"), v.alias("x"), ((v < F.lit(low)) | (v > F.lit(high))).alias("out")))
    stats = df.select(F.inline(F.array(*entries))).groupBy("column").agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("avg"),
        F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
        count_when(x == 0).alias("zeros"), count_when(x < 0).alias("negatives"),
        count_when(F.col("out")).alias("outliers"),
    )
    skew = F.when(flat, 0.0).otherwise(sample_skewness(F.col("g1"), n))
    kurt = F.when(flat, 0.0).otherwise(sample_kurtosis(F.col("g2"), n))
    median = lookup({c: q[1] for c, q in known.items()})
    shown = [F.col("lo"), F.col("hi"), F.col("avg"), median, F.col("sd"), skew, kurt]
    return stats.select(
        "column", *[F.round(e, digits).alias(name) for e, name in zip(shown, NUMERIC_STATS)], "zeros", "negatives", "outliers"
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Fences and number of values outside them."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    aggs, exprs = [], {}
    for i, c in enumerate(columns):
        q1, q3 = quartiles[c]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs.append(count_when((col(c) < F.lit(low)) | (col(c) > F.lit(high))).alias(f"o{i}"))
        exprs[c] = [F.round(F.lit(low), digits), F.round(F.lit(high), digits), F.col(f"o{i}")]
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, lower_bound double, upper_bound double, outliers bigint")
    return to_long(df.agg(*aggs), exprs, ["lower_bound", "upper_bound", "outliers"])


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins; the last one is closed, a constant column is widened by half a unit each way."""
    columns = list(columns or numeric_columns(df))
    limits = df.agg(
        *[f(col(c).cast("double")).alias(f"{tag}{i}") for i, c in enumerate(columns) for f, tag in ((F.min, "a"), (F.max, "b"))]
    ).first()
    entries, zero_rows = [], []
    for i, c in enumerate(columns):
        low, high = limits[f"a{i}"], limits[f"b{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        place = F.least(F.floor((col(c).cast("double") - F.lit(low)) * bins / F.lit(high - low)), F.lit(bins - 1))
        entries.append(F.struct(F.lit(c).alias("column"), place.cast("int").alias("bin")))
        width = (high - low) / bins
        zero_rows += [(c, b, round(low + b * width, 4), round(low + (b + 1) * width, 4)) for b in range(bins)]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, bin int, left_edge double, right_edge double, n bigint")
    counted = (
        df.select(F.inline(F.array(*entries))).filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count("*").alias("n"))
    )
    edges = df.sparkSession.createDataFrame(zero_rows, "column string, bin int, left_edge double, right_edge double")
    # bins * columns rows on the left
    return (
        F.broadcast(edges).join(counted, ["column", "bin"], "left")
        .select("column", "bin", "left_edge", "right_edge", F.coalesce("n", F.lit(0)).alias("n"))
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for the non-missing values of several columns, in one shuffle."""
    entries = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Most frequent values with their share of the non-missing rows; ties in value order."""
    columns = list(columns or [c for c in df.columns if c not in set(numeric_columns(df))])
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    counts = value_counts(df, columns)
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= n)  # pre-trimmed before the shuffle
    filled = df.agg(*[F.count(col(c)).alias(f"f{i}") for i, c in enumerate(columns)])
    totals = to_long(filled, {c: [F.col(f"f{i}")] for i, c in enumerate(columns)}, ["filled"])
    return (
        top.join(F.broadcast(totals), "column")
        .select("column", "rank", "value", "n", percent(F.col("n"), F.col("filled")).alias("pct"))
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[object, int]]:
    """{column: (most frequent value, count)}; ties go to the smallest value of its own type."""
    numeric = [c for c in columns if c in set(numeric_columns(df))]
    text = [c for c in columns if c not in set(numeric)]
    found: dict[str, tuple[object, int]] = {}
    for group, kind in ((numeric, "double"), (text, "string")):
        if not group:
            continue
        entries = [F.struct(F.lit(c).alias("column"), col(c).cast(kind).alias("value")) for c in group]
        long = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
        for r in counts.withColumn("rank", rank).filter("rank = 1").collect():  # one row per column
            found[r["column"]] = (r["value"], r["n"])
    return found


def mode_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return top_values(df, columns, 1).select("column", F.col("value").alias("mode"), F.col("n").alias("mode_count"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share of each class; the second step sees one row per class."""
    counts = df.groupBy(col(label).alias("class")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select("class", "n", percent(F.col("n"), total).alias("pct"))


def feature_ranges(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """min, max, mean and median of each feature, for a what-if form."""
    columns = list(columns or numeric_columns(df))
    mid = exact_quantiles(df, {c: [0.5] for c in columns})
    wide = df.agg(*[
        f(col(c).cast("double")).alias(f"{tag}{i}")
        for i, c in enumerate(columns) for f, tag in ((F.min, "a"), (F.max, "b"), (F.avg, "m"))
    ])
    exprs = {
        c: [F.round(e, digits) for e in (F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"m{i}"), F.lit(mid[c][0]).cast("double"))]
        for i, c in enumerate(columns)
    }
    return to_long(wide, exprs, ["min", "max", "mean", "median"])


# pairs of columns ----------------------------------------------------------------------------------
def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, correlation) for i < j, each over the rows where both are present.

    Plain aggregates, ``PAIRS_PER_PASS`` at a time: a row stays one row.
    """
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, correlation double")
    out = None
    for part in chunks(pairs, PAIRS_PER_PASS):
        wide = df.agg(*[F.nanvl(F.corr(col(a).cast("double"), col(b).cast("double")), F.lit(None).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        one = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(part)])))
        out = one if out is None else out.unionByName(one)
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Every cell in long form; undefined is 0, the diagonal is 1 unless the column is constant."""
    columns = list(columns or numeric_columns(df))
    pairs = correlation_pairs(df, columns)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("col1"), F.col("col2"), F.col("correlation")),
        F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), F.col("correlation")),
    )))
    spread = df.agg(*[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    own = spread.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col1"), F.lit(c).alias("col2"), F.when(F.col(f"s{i}") > 0, 1.0).alias("correlation"))
        for i, c in enumerate(columns)
    ])))
    return both.unionByName(own).select("col1", "col2", F.round(F.coalesce("correlation", F.lit(0.0)), digits).alias("correlation"))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = 15, digits: int = 4) -> DataFrame:
    known = correlation_pairs(df, columns).filter(F.col("correlation").isNotNull())
    rounded = known.withColumn("correlation", F.round("correlation", digits))
    return rounded.withColumn("strength", F.abs("correlation")).orderBy(F.desc("strength"), "col1", "col2").limit(n)


# composed ------------------------------------------------------------------------------------------
def quality_alerts(df: DataFrame) -> DataFrame:
    """Rules over one row of statistics; a table without findings gives one success row."""
    numeric, text = numeric_columns(df), set(text_columns(df))
    repeated = duplicate_rows(df).first()["duplicates"]
    n_rows, found = filled_and_distinct(df, df.columns)
    counts = {"n_rows": n_rows, **{f"{t}{i}": v for i, (filled, kinds) in enumerate(found) for t, v in (("f", filled), ("d", kinds))}}
    aggs = []
    for i, c in enumerate(df.columns):
        if c in numeric:
            x = col(c).cast("double")
            aggs += [F.skewness(x).alias(f"g{i}"), F.stddev_samp(x).alias(f"s{i}")]
    shape = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    wide = shape.select("*", *[F.lit(v).cast("long").alias(name) for name, v in counts.items()])
    n = F.col("n_rows")

    def alert(test: Column, level: Column, category: str, name: str | None, message: Column) -> Column:
        return F.when(test, F.struct(
            level.alias("level"), F.lit(category).alias("category"),
            F.lit(name).cast("string").alias("column"), message.alias("message"),
        ))

    rules = [alert(
        F.lit(repeated > 0), F.lit("warning"), "duplicates", None,
        F.format_string("%d repeated rows, %.1f%% of all", F.lit(repeated), F.lit(repeated) * 100.0 / F.greatest(n, F.lit(1))),
    )]
    for i, c in enumerate(df.columns):
        share = F.try_divide((n - F.col(f"f{i}")) * 100.0, n)
        distinct = F.col(f"d{i}")
        rules.append(alert(
            share > 30, F.when(share > 70, "danger").otherwise("warning"), "missing", c,
            F.format_string('%s: %.1f%% of the cells are empty', F.lit(c), share),
        ))
        rules.append(alert(
            distinct <= 1, F.lit("danger"), "constant", c,
            F.format_string('%s: the same value in every row', F.lit(c)),
        ))
        if c in text:
            rules.append(alert(
                distinct > 50, F.lit("info"), "cardinality", c,
                F.format_string('%s: %d different texts', F.lit(c), distinct),
            ))
        if c in numeric:
            skew = F.abs(F.when(F.col(f"s{i}") > 0, sample_skewness(F.col(f"g{i}"), F.col(f"f{i}"))))
            rules.append(alert(
                skew > 3, F.lit("info"), "skewness", c,
                F.format_string('%s: lopsided, skewness %.2f', F.lit(c), skew),
            ))
    alerts = F.array_compact(F.array(*rules))
    clean = F.array(F.struct(
        F.lit("success").alias("level"), F.lit("quality").alias("category"), F.lit(None).cast("string").alias("column"),
        F.lit("nothing found").alias("message"),
    ))
    return wide.select(F.inline(F.when(F.size(alerts) > 0, alerts).otherwise(clean)))


def table_preview(df: DataFrame, digits: int = 4) -> DataFrame:
    """Per column: type, missing, distinct, and min / max / mean or the top value."""
    summary = column_summary(df).select("column", "dtype", "missing", "missing_pct", "n_distinct")
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in set(numeric)]
    stats = None
    if numeric:
        wide = df.agg(*[
            f(col(c).cast("double")).alias(f"{tag}{i}")
            for i, c in enumerate(numeric) for f, tag in ((F.min, "a"), (F.max, "b"), (F.avg, "m"))
        ])
        exprs = {c: [F.round(F.col(f"{t}{i}"), digits) for t in "abm"] for i, c in enumerate(numeric)}
        stats = to_long(wide, exprs, ["min", "max", "mean"]).withColumn("top", F.lit(None).cast("string"))
    if others:
        tops = mode_summary(df, others).select("column", F.col("mode").alias("top"))
        stats = tops if stats is None else stats.unionByName(tops, allowMissingColumns=True)
    return summary.join(F.broadcast(stats), "column", "left")  # one row per column on both sides
