"""A corpus pipeline: language, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; stages are written as Parquet in the
checkpoint folder and read again. All but the last return the columns of ``documents``; columns beyond those pass through the
first two stages and end with the third, whatever their names.

Every stage takes nulls in any column, repeated rows, texts of any length and empty tables; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtab.functions.staging import materialise
from loomtab.llm import decontaminate, jaccard, language, packing, substrings
from loomtab.llm.common import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay: those without letters (null and empty texts too), or that no language
    explains, go. Null labels teach nothing; repeated rows are judged alike; of equal proportions the first name wins."""
    return language.identified(docs, language.fit_on_fold(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a 5-word Jaccard similarity of 0.8 or more stays: the smallest id. Texts without a word
    and documents without an id are their own group unless their texts meet; rows that repeat the id that stays all stay."""
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that also start elsewhere are taken out; a document that loses all its words goes.

    A text that loses words is its kept words joined by one space, and ``n_chars`` its new length. Repeated rows are each
    other's repeats. A null text has nothing to lose and stays.
    """
    found = substrings.remove_repeats(docs).filter("n_removed = 0 or n_words > n_removed")
    cut = F.col("n_removed") > 0
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover a twentieth of the words or more go; others stay as they
    are, repeated rows alike. A null text has no words, an empty benchmark no windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents with their places in sequences of 2048. A null text is an empty one, repeated rows are
    packed each, pieces of equal length in the order they come."""
    return packing.digest(docs)


STAGES = [
    ("language", keep_languages),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]

# Language mixtures and tokenizer ids are not expressible in SQL: tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
