"""Tables whose own columns have the names that operators use inside, and keys that are null in a whole batch."""
import pytest
from pyspark.sql import functions as F

from loomtab.llm import chat, decontaminate, jaccard, language, packing, shard

NAMES = ["__text", "__k", "__c", "__key", "__items", "__spans", "__all", "__n_words", "__stratum", "__order", "__rank", "__n", "__at", "__shard", "__pid", "__TEXT_", "c0", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of document {i // 2} and a few more of them", "en" if i % 3 else "de", "web") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def check(found, n=12):
    rows = found.collect()
    assert len(rows) == n
    for r in rows:
        assert all(r[name] == f"{name}-{r.doc_id}" for name in NAMES)
    return rows


def test_operators_keep_columns_of_any_name(spark, docs):
    check(language.predict(docs, language.fit(docs)))
    check(language.identified(docs, language.fit(docs)))
    check(packing.pieces(docs))
    benchmark = spark.createDataFrame([("x", "words of document 3 and")], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in check(decontaminate.find_spans(docs, benchmark))}
    assert found == {i: 5 if i // 2 == 3 else 0 for i in range(12)}
    check(decontaminate.decontaminate(docs, benchmark), 10)
    assert [r.doc_id for r in sorted(check(jaccard.one_of_each(docs), 6))] == [0, 2, 4, 6, 8, 10]
    placed = check(shard.interleave(docs, 4))
    assert sorted((r.shard, r.slot) for r in placed) == [(s, k) for s in range(4) for k in range(3)]


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_chat_keys_that_are_null(spark, kind):
    rows = [(None, k, role, f"text {k}") for k, role in enumerate(["user", "assistant", "user"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", F.col("conv_id").cast("string").cast(kind))
    formatted = chat.format_turns(df)
    (r,) = chat.conversation_digests(formatted).collect()
    assert r.conv_id is None and r.n_turns == 3 and r.loss_chars == len("text 1")
    if kind == "long":
        got = {r.conv_id: r.n_turns for r in chat.digest(df).collect()}
        assert got == {None: 3, -1: 2}
