"""The pipeline's stages, each against what its own input says."""
import numpy as np

import corpus_pipeline as C
from loomtab.llm import decontaminate, packing
from tests.llm.test_jaccard import brute as near
from tests.llm.test_substrings import brute as repeats


def test_stages(spark, small):
    docs = C.table(spark, small, "documents")
    extra = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    junk = docs.limit(2).selectExpr("doc_id + 200000 as doc_id", "'12 34 !!' as text", "lang", "source", "n_chars")
    docs = docs.union(extra).union(junk)
    seen = {}
    for name, stage in C.STAGES:
        before = docs.collect() if name != "packing" else None
        docs = C.materialise(stage(spark, docs, small), "test-" + name)
        if name == "packing":
            break
        assert tuple(docs.columns) == C.COLUMNS
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
    before, after = seen["language"]
    assert {r.doc_id for r in before} - set(after) >= {r.doc_id for r in before if r.doc_id >= 100_000} and len(after) >= len(before) - 8
    before, after = seen["near_copies"]
    assert set(after) == {c for *_, c in near([(r.doc_id, r.text) for r in before])}
    before, after = seen["repeated_passages"]
    for r, (n, gone, _) in zip(before, repeats([r.text for r in before], 35)):
        assert (r.doc_id in after) == (gone == 0 or n > gone)
        if not gone:
            assert after[r.doc_id] == r
    before, after = seen["benchmark"]
    judged = decontaminate.find_spans(spark.createDataFrame(before, docs.sparkSession.read.parquet(f"{small}/documents.parquet").schema), C.table(spark, small, "benchmark"))
    assert set(after) == {r.doc_id for r in judged.collect() if not r.contaminated}
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(after)
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= packing.CAPACITY and len(fill) <= np.ceil(packed.length.sum() / packing.CAPACITY) * 1.05 + 1


def test_odd_tables(spark, small):
    """Nulls in every column, repeated rows, ties, a very long text, extra columns and an empty table."""
    words = "the cat sat on the mat and looked at all of the birds in the garden ".split()
    say = lambda k: " ".join(words[(i * k + i // 7) % len(words)] + (str(i % k) if i % 5 == 0 else "") for i in range(120))
    rows = [(i, say(i + 3), "en" if i % 2 else "de", "web", 7) for i in range(6)]
    rows += [(1, say(4), "en", "web", 7), (1, say(4), "en", "web", 7)]  # repeated rows
    rows += [(50, None, "en", "web", None), (51, "", None, None, 0), (52, " ", "de", "web", 1), (None, say(40), "en", None, None)]
    rows += [(60, say(60), None, "web", 1), (61, say(60), None, "web", 1), (70, " ".join(f"{w}{i}" for i, w in enumerate(words * 4000)), "en", "web", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.selectExpr("*", "'x' as __text", "'y' as n_words", "'z' as class_id", "1 as spans", "2 as score")
    for docs in (wide, wide.limit(0)):
        full = not docs.isEmpty()
        for name, stage in C.STAGES:
            docs = C.materialise(stage(spark, docs, small), "odd-" + name)
            kept = {r.doc_id for r in docs.collect()}
            if name != "packing":
                assert set(docs.columns) >= set(C.COLUMNS) and (name in ("language", "near_copies") or tuple(docs.columns) == C.COLUMNS)
            if full:
                assert not kept & {50, 51, 52} and (name == "language" or 61 not in kept)
            else:
                assert not kept
