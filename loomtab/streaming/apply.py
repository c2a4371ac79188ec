"""Fitted steps on a stream: they are column expressions and broadcast-size lookups, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.automl import KEY, RunResult


def score_stream(result: RunResult, stream: DataFrame, key: str) -> DataFrame:
    """Predictions for the rows of a streaming table with a whole-number key. Steps that need a whole-table
    order (rolling features) are refused by Spark on a stream."""
    keyed = stream.withColumnRenamed(key, KEY)
    return result.predict(keyed).select(KEY, "prediction")
