"""Helpers shared by the text operators: small slices of Arrow batches, words, keys, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtab.functions.staging import materialise

SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(names: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns of any name as c0, c1 and so on, which clash with nothing an operator adds, and back again."""
    return ([F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(names)], [F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def slices(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in a slice hold about ``limit`` bytes; one row at least.

    Python objects made from a slice are a few times its bytes, so this bounds a task's memory by the limit
    or by the longest text, whatever the batch size of the session.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes, dtype=np.int64) + 64 * np.arange(1, len(sizes) + 1), 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from the flat values and the number of them in each row."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` by prefix doubling. Every 0 counts as its own smallest symbol, earlier first."""
    n = len(text)
    zeros = int((text == 0).sum())
    rank = text.astype(np.int64) + zeros
    rank[text == 0] = np.arange(zeros)
    order = np.argsort(rank, kind="stable")
    step = 1
    sorted_rank = rank[order]
    new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
    rank[order] = new
    while n and new[-1] < n - 1:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        step *= 2
    return order


def text_key(text: Column) -> Column:
    """128 bits of a text: equal for equal texts, so copies share it."""
    return F.unhex(F.md5(text))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches over the undirected edges (a, b).

    Alternating large-star and small-star steps until nothing changes; the number of rounds grows with the
    logarithm of a component's size. Each round is a written table, so a lost executor costs one round at most.
    A hub's neighbours are never gathered: both steps are a minimum per node (partial sums first) joined back,
    where a hot node is left to the runtime split of skewed joins. ``nodes`` may be empty; edges may repeat, may
    have a = b, and may name nodes that ``nodes`` lacks (those give no row).
    """
    links = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    links = materialise(links, "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        small = materialise(small.filter("u <> v").distinct(), "small")
        same = small.count() == links.count() and small.exceptAll(links).isEmpty()
        links = small
        if same:
            break
    found = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("node")).join(found, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
