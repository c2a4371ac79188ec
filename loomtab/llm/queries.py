"""Queries of the text operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fill_middle, hnsw, jaccard, language, lexical, lm, packing, projected, shard, substrings, token_counts
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": lambda spark, sf: jaccard.digest(table(spark, sf, "documents")),
    "op2_chat_formatting": lambda spark, sf: chat.digest(table(spark, sf, "conversations")),
    "op3_sharding": lambda spark, sf: shard.digest(table(spark, sf, "documents")),
    "op4_lm_scoring": lambda spark, sf: lm.digest(table(spark, sf, "documents")),
    "op5_token_counts": lambda spark, sf: token_counts.digest(table(spark, sf, "documents")),
    "op6_language_id": lambda spark, sf: language.digest(table(spark, sf, "documents")),
    "op7_decontamination": lambda spark, sf: decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op8_packing": lambda spark, sf: packing.digest(table(spark, sf, "documents")),
    "op9_embedding_dedup": lambda spark, sf: hnsw.digest(table(spark, sf, "embeddings")),
    "op10_substring_dedup": lambda spark, sf: substrings.digest(table(spark, sf, "documents")),
    "op11_lexical_search": lambda spark, sf: lexical.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op12_neighbours": lambda spark, sf: projected.digest(table(spark, sf, "embeddings")),
    "op13_fill_middle": lambda spark, sf: fill_middle.digest(table(spark, sf, "documents")),
}

ORACLE: dict[str, str] = {
    "op1_jaccard_join": jaccard.SQL,
    "op2_chat_formatting": chat.SQL,
    "op3_sharding": shard.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_embedding_dedup": hnsw.SQL,
    "op10_substring_dedup": substrings.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_neighbours": projected.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
