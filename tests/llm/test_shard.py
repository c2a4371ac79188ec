"""Stratified interleaving: the row law, gapless slots, the mixture in every shard, odd inputs."""
import zlib
from collections import Counter

from loomtab.llm.shard import digest, interleave, write_shards


def test_law_and_mixture(spark):
    rows = [(i, f"t{i}" if i % 7 else None, "hot" if i % 3 == 0 else f"s{i % 11}", 5, 5) for i in range(1000)]
    rows += [(None, "x", None, 1, 1), (None, "x", None, 1, 1), (5, "", "s1", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot long")
    got = interleave(df, 8).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in ("hot", "s1", None):
        each = Counter(r.shard for r in got if r.source == source)
        if source == "hot":
            assert max(each.values()) - min(each.get(s, 0) for s in range(8)) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in interleave(df.repartition(5), 8).collect() if r.doc_id is not None and r.doc_id != 5}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id is not None and r.doc_id != 5}
    other = {(r.doc_id, r.shard) for r in interleave(df, 8, seed=1).collect()}
    assert other != {(r.doc_id, r.shard) for r in got}


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(1, "é", "a"), (2, None, "a"), (3, "", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in digest(df).collect()}
    assert [got[i].size for i in (1, 2, 3)] == [10, 8, 8]
    assert got[1].text_crc32 == zlib.crc32("é".encode()) and got[2].text_crc32 == got[3].text_crc32 == 0
    assert all(r.law == "rows" and r.grown_shard is None for r in got.values())
    assert digest(df.limit(0)).count() == 0


def test_whole_rows_written(spark, tmp_path):
    df = spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text", "id % 3 as source", "id * 2 as extra")
    write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.extra) for r in back.collect()) == [(i, str(i), 2 * i) for i in range(50)]


def test_ties_and_long_texts(spark):
    """Rows with equal keys are each placed once, whatever ties; a very long text is one row like any other."""
    long = "word " * 400_000
    rows = [(i // 50, long if i == 0 else "t", "a" if i % 2 else "b") for i in range(200)]
    got = digest(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert Counter(r.doc_id for r in got) == {k: 50 for k in range(4)}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {(r.shard, r.slot) for r in got} == {(s, k) for s in sizes for k in range(sizes[s])}
    assert max(r.size for r in got) == len(long) + 8
