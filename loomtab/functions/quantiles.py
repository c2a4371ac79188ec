"""Exact quantiles (linear interpolation) by counting, for tables of any size.

No task ever sorts or holds a column. A quantile is one or two order statistics; each is located by counting
values in buckets and narrowing to the bucket that holds the rank, for all columns in one
grouped aggregate per pass. Smooth columns take three passes, the most uneven ones eight.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col, count_when

BUCKETS = 1024
FEW_VALUES = 2000
COLUMNS_PER_JOB, INTERVALS_PER_JOB = 16, 64

Spot = tuple[str, int]


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """{column: [quantile for each probability]}; None for a column without values."""
    names = list(wanted)
    if not names:
        return {}
    if len(names) > COLUMNS_PER_JOB:
        out = {}
        for i in range(0, len(names), COLUMNS_PER_JOB):
            out.update(exact_quantiles(df, {c: wanted[c] for c in names[i:i + COLUMNS_PER_JOB]}))
        return out
    low_inf, high_inf = F.lit(float("-inf")), F.lit(float("inf"))
    aggs = []
    for i, c in enumerate(names):
        x = col(c).cast("double")
        finite = F.when((x > low_inf) & (x < high_inf), x)
        aggs += [F.count(x).alias(f"n{i}"), F.min(finite).alias(f"a{i}"), F.max(finite).alias(f"b{i}"),
                 count_when(x == low_inf).alias(f"l{i}"), count_when(x == high_inf).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(names)}
    known: dict[Spot, float] = {}
    spans: dict[Spot, tuple[float, float, int, int]] = {}
    for i, c in enumerate(names):
        below, above = row[f"l{i}"], row[f"h{i}"]
        for at in ((sizes[c] - 1) * p for p in wanted[c] if sizes[c]):
            for rank in (math.floor(at), math.ceil(at)):
                if rank < below:
                    known[(c, rank)] = float("-inf")
                elif rank >= sizes[c] - above:
                    known[(c, rank)] = float("inf")
                else:
                    spans[(c, rank)] = (row[f"a{i}"], row[f"b{i}"], below, sizes[c] - below - above)
    known.update(_narrow(df, spans))
    out: dict[str, list[float | None]] = {}
    for c in names:
        found: list[float | None] = []
        for p in wanted[c]:
            if not sizes[c]:
                found.append(None)
                continue
            at = (sizes[c] - 1) * p
            low, high = known[(c, math.floor(at))], known[(c, math.ceil(at))]
            found.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        out[c] = found
    return out


def _narrow(df: DataFrame, spans: dict[Spot, tuple[float, float, int, int]]) -> dict[Spot, float]:
    """``spans`` holds (low, high, rows below, rows inside) of the values that can have the rank."""
    done: dict[Spot, float] = {}
    while True:
        for s, (low, high, _, _) in list(spans.items()):
            if low == high:
                done[s] = low
                del spans[s]
        if not spans:
            return done
        intervals = sorted({(s[0], low, high, below, rows) for s, (low, high, below, rows) in spans.items()})
        for i in range(0, len(intervals), INTERVALS_PER_JOB):
            _count_inside(df, intervals[i:i + INTERVALS_PER_JOB], spans)


def _size_order(v: float) -> float:
    """Monotone in v and at most 2200 in absolute value: sign and binary order of magnitude."""
    return math.copysign(math.log2(abs(v)) + 1100.0, v) if v else 0.0


def _bucket(x: Column, low: float, high: float) -> Column:
    """Number of the bucket of x in [low, high]: equal widths between values of like size, else equal steps in the order
    of magnitude. Two such steps lead from any range to values of like size, whose 53 bits take six passes at most."""
    a, b = _size_order(low), _size_order(high)
    if b - a > 2:
        magnitude = F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100.0))
        part = (magnitude - F.lit(a)) / F.lit(b - a)
    else:
        part = (x - F.lit(low)) / F.lit(high - low)
    return F.greatest(F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("double")


def _count_inside(df: DataFrame, intervals: list[tuple[str, float, float, int, int]], spans: dict[Spot, tuple[float, float, int, int]]) -> None:
    """One pass over some intervals; moves the spots of each into the bucket that holds their rank."""
    entries, tests = [], []
    for k, (c, low, high, _, rows) in enumerate(intervals):
        x = col(c).cast("double")
        if rows <= FEW_VALUES:
            place = x  # few enough: every distinct value is its own bucket
        else:
            place = _bucket(x, low, high)
        tests.append((x >= F.lit(low)) & (x <= F.lit(high)))
        entries.append(F.struct(F.lit(k).alias("k"), F.when(tests[-1], place).alias("b"), x.alias("x")))
    # after the first pass few rows are inside any interval: drop the others before they are expanded
    near = df.filter(reduce(lambda a, b: a | b, tests))
    inside = near.select(F.inline(F.array(*entries))).filter(F.col("b").isNotNull())
    counted = inside.groupBy("k", "b").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    # at most BUCKETS (or FEW_VALUES) rows per interval
    tables: dict[int, list] = {}
    for r in counted.collect():
        tables.setdefault(r["k"], []).append((r["b"], r["n"], r["low"], r["high"]))
    for k, (c, low, high, below, _) in enumerate(intervals):
        upto = below
        for _, n, new_low, new_high in sorted(tables.get(k, [])):
            for s in [s for s, span in spans.items() if s[0] == c and span[:2] == (low, high) and upto <= s[1] < upto + n]:
                spans[s] = (new_low, new_high, upto, n)
            upto += n


def outlier_fences(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Tukey fences per column; columns without values are left out."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    fences = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None:
            fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fences


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in columns}).items()}
