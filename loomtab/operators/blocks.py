"""Sums over the rows of a numeric table, for machines that are fitted by many passes over it.

The rows are written once as blocks of plain numbers, so a pass reads memory and multiplies matrices. What a pass needs beside
the rows, such as features that are wider than they are, is made from a block and forgotten with it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import materialise

ROWS = 256  # of a block, at most: so few that what is made from it stays in the processor's memory
PIECE = 1 << 13  # numbers of a sum that are added up together


def blocks(df: DataFrame) -> DataFrame:
    """(data binary) as a written table: label and features of up to ``ROWS`` rows, one row after another, as doubles."""

    def pack(batches):
        for batch in batches:
            if batch.column("label").null_count:
                raise ValueError("a row without a label cannot be learned from")
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                both = np.column_stack([batch.column("label").to_numpy(), x])
                yield pa.RecordBatch.from_arrays([pa.array([both[i : i + ROWS].tobytes() for i in range(0, len(both), ROWS)], pa.binary())], ["data"])

    rows = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    return materialise(rows.mapInArrow(pack, "data binary"), "blocks")


def total(rows: DataFrame, dims: int, of: Callable[[Any, np.ndarray, np.ndarray], np.ndarray], state: Any, size: int) -> np.ndarray:
    """The sum over all blocks of ``of(state, features, labels)``, a vector of ``size``: made per task, then piece by piece,
    so the driver gets the sum, or a part per task where it is one piece."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(state)

    def add(batches):
        sums = np.zeros(size)
        for batch in batches:
            for data in batch.column("data"):
                block = np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(-1, dims + 1)
                sums += of(sent.value, block[:, 1:], block[:, 0])
        parts = range(0, size, PIECE)
        yield pa.RecordBatch.from_arrays([pa.array([i // PIECE for i in parts], pa.int32()), pa.array([sums[i : i + PIECE].tobytes() for i in parts], pa.binary())], ["piece", "sums"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                own = np.frombuffer(data, dtype=np.float64)
                held[piece] = held[piece] + own if piece in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "sums"])

    found = rows.mapInArrow(add, "piece int, sums binary")
    if size > PIECE:
        found = found.repartition(min(-(-size // PIECE), context.defaultParallelism), "piece").mapInArrow(merge, "piece int, sums binary")
    out = np.zeros(size)
    for r in found.collect():
        own = np.frombuffer(r["sums"], dtype=np.float64)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(own)] += own
    sent.destroy()
    return out
