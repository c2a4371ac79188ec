"""Ranks, running totals and cut points without a window over the whole table.

A DataFrame has no row order, so every positional operator names its order columns. Three forms:

* ``row_index``      positions for every row: range partitions plus per-partition offsets;
* ``running_total``  sums of all earlier rows, by the same layout;
* ``hash_cuts``      the key at given ranks of the shuffled order, found from bucket counts, so that a
                     split or a fold is a plain comparison and the table itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import col, null_safe_join, shuffle_key
from .staging import materialise

_PID, _LOC = "__pid", "__loc"


def _range_layout(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partitioned, sorted and written, with partition number and position in it.

    Ties and hot keys are split because the last order column is expected to be unique.
    """
    ordered = df.repartitionByRange(*[col(k) for k in keys]).sortWithinPartitions(*[col(k) for k in keys])
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    return materialise(ordered.select("*", pid.alias(_PID), local.alias(_LOC)), "ordered")


def row_index(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "row_index",
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` (inside each ``within`` group if given)."""
    staged = _range_layout(df, [*within, *order])
    groups = [col(c) for c in within]
    per_part = staged.groupBy(_PID, *groups).agg(F.min(_LOC).alias("__start"), F.count("*").alias("__n"))
    earlier = W.partitionBy(*groups).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        _PID, *groups, "__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    if not within:  # one row per range partition
        offsets = F.broadcast(offsets)
    joined = null_safe_join(staged, offsets, [_PID, *within])
    position = col(_LOC) - col("__start") + col("__before")
    return joined.withColumn(name, position.cast("long")).drop(_PID, _LOC, "__start", "__before")


def running_total(df: DataFrame, order: Sequence[str], totals: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """For each ``{new: source}`` add the sum of ``source`` over strictly earlier rows."""
    staged = _range_layout(df, [*within, *order])
    groups = [col(c) for c in within]
    inside = W.partitionBy(_PID, *groups).orderBy(_LOC).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*groups).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    sums = staged.groupBy(_PID, *groups).agg(*[F.sum(col(s)).alias(f"__sum_{n}") for n, s in totals.items()])
    offsets = sums.select(
        _PID, *groups,
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in totals],
    )
    if not within:
        offsets = F.broadcast(offsets)
    joined = null_safe_join(staged, offsets, [_PID, *within])
    added = {
        n: F.coalesce(F.sum(col(s)).over(inside), F.lit(0)) + col(f"__before_{n}") for n, s in totals.items()
    }
    return joined.withColumns(added).drop(_PID, _LOC, *[f"__before_{n}" for n in totals])


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    ranks: Callable[[Column], list[Column]],
    within: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Hash of the row at each requested 1-based rank of the shuffled order, per group.

    ``ranks`` gets the group size and returns the wanted ranks (0 = before every row). The result has one
    row per group with the columns ``n_rows, cut_0, cut_1, ...``. Only bucket counts and the rows of the
    buckets that hold a cut are shuffled: the hash is uniform, so a bucket is 1/65536 of its group.
    ``few_groups`` says that the caller has counted the groups and found them small enough to broadcast.
    """
    groups = [col(c) for c in within]
    hashed = df.select(*groups, shuffle_key(seed, col(key)).alias("__h"))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, 4))
    counts = hashed.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    ordered = W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumns({
        "__upto": F.sum("__n").over(ordered),
        "n_rows": F.sum("__n").over(W.partitionBy(*groups)),
    })
    wanted = ranks(F.col("n_rows"))
    slots = F.array(*[r.cast("long") for r in wanted])
    boundary = (
        counts.select(*groups, "__b", "__upto", "__n", "n_rows", F.posexplode(slots).alias("__i", "__r"))
        .filter((F.col("__r") <= F.col("__upto")) & (F.col("__r") > F.col("__upto") - F.col("__n")))
        .select(*groups, "__b", "__i", (F.col("__r") - F.col("__upto") + F.col("__n")).alias("__need"))
    )
    if few_groups or not within:  # one row per group and rank
        boundary = F.broadcast(boundary)
    near = null_safe_join(hashed, boundary, [*within, "__b"])
    rank = F.row_number().over(W.partitionBy(*groups, "__i").orderBy("__h"))
    hits = near.withColumn("__rn", rank).filter(F.col("__rn") == F.col("__need"))
    cuts = hits.groupBy(*groups).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__h"))).alias(f"cut_{i}") for i in range(len(wanted))]
    )
    sizes = counts.groupBy(*groups).agg(F.max("n_rows").alias("n_rows"))
    if not within:
        # two one-row tables: bring the numbers to the driver instead of joining on nothing
        row = cuts.first()
        found = [row[f"cut_{i}"] or "" for i in range(len(wanted))]
        return sizes.select("n_rows", *[F.lit(v).alias(f"cut_{i}") for i, v in enumerate(found)])
    out = null_safe_join(sizes, cuts, list(within), "left")
    return out.select(*groups, "n_rows", *[F.coalesce(f"cut_{i}", F.lit("")).alias(f"cut_{i}") for i in range(len(wanted))])
