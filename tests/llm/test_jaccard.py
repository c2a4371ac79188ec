"""Jaccard join against brute force, with large groups cut into tiles, and odd inputs."""
import random

import numpy as np
from pyspark.sql import functions as F

from loomtab.llm import jaccard as J
from loomtab.llm.common import components


def shingles(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in link[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        same = [rows[j][0] for j in range(n) if sets[j] == sets[i] and sets[i]] or [rows[i][0]]
        out.append((rows[i][0], min(same), len(link[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def vary(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"z{rng.randint(0, 9999)}"
    return " ".join(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 40, 120, 300]))] for _ in range(40)]
    texts = [None, "", "  ", "one two", "one two", "one  two", "a b c d e"]
    for w in base:
        texts += [" ".join(w)] + [vary(rng, w, rng.choice([0, 1, 1, 2, 4])) for _ in range(rng.randint(0, 4))]
    texts += [vary(rng, base[2][:] + base[3], 1) for _ in range(60)]  # a large group
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_links int").repartition(4)
    want = brute(rows)
    assert sorted(map(tuple, J.jaccard_join(df).collect())) == want
    monkeypatch.setattr(J, "TILE", 8)
    assert sorted(map(tuple, J.jaccard_join(df).collect())) == want
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for s in (0.5, 0.8, 0.95):
        n = 1000
        both = rng.integers(0, 1 << 63, int(n * s), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, int(n * (1 - s) / 2), dtype=np.uint64)]) for _ in range(2))
        agree = np.mean([np.mean(J.minhash(a ^ np.uint64(k)) == J.minhash(b ^ np.uint64(k))) for k in range(8)])
        assert abs(agree - s) < 0.04


def test_prefixes_are_shortened_by_what_is_measured(spark):
    assert J.chosen_depth({}, 0.8, J.RECALL) == J.forest_depth(0.8, J.RECALL)
    close = {(8, 0.99): 5000}
    assert J.chosen_depth(close, 0.8, J.RECALL) == J.forest_depth(0.8, J.WORST) == 7
    assert J.chosen_depth({**close, (4, 0.99): 2}, 0.8, J.RECALL) == 4  # signatures that agree too little count, not only the formula
    assert J.chosen_depth({(8, 0.8): 5000}, 0.8, J.RECALL) < 7  # luck in the sample does not count
    assert J.chosen_depth({(0, 0.9): 1}, 0.8, J.RECALL) == 1
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(80)] for _ in range(25)]
    texts = [vary(rng, w, k) for w in base for k in (0, 0, 1, 2)] + ["one two", "one two", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("tkey", J.text_key(F.col("text")))
    own = [t.encode() for t in texts if t][:60]
    sample = spark.sparkContext.broadcast(J.Sample(own, 5, 0.8))
    signed = J._signatures(docs.filter("text is not null"), 5, sample)
    sets = [shingles(t) for t in texts]
    for r in signed.collect():
        want = {i: len(a & sets[r.id]) / len(a | sets[r.id]) for i, a in enumerate(shingles(t.decode()) for t in own) if len(a & sets[r.id]) >= 0.8 * len(a | sets[r.id])}
        assert dict(zip(r.near, r.like)).keys() == want.keys() and all(abs(want[i] - s) < 1e-9 for i, s in zip(r.near, r.like))
    found = J.measured_prefixes(signed, sample)
    classes = {frozenset(s) for s in sets if s}
    pairs = [(a, b) for a in map(shingles, (t.decode() for t in own)) for b in classes if a != b and len(a & b) >= 0.8 * len(a | b)]
    assert sum(found.values()) == len(pairs) > 0 and all(p > 0 for p, _ in found)


def test_empty_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "q"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_links) for r in J.jaccard_join(df).collect()))
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 0), (True, 0, 0)]
    assert J.jaccard_join(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(120_000))
    pair = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_join(pair).collect())) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 0, 3)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7), (3, 1), (1, 3)]
    label = {n: n for n in range(300)}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.createDataFrame([(n,) for n in range(300)], "node long")
    got = components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label
    none = spark.createDataFrame([], "a long, b long")
    assert {r.node: r.component for r in components(nodes, none).collect()} == {n: n for n in range(300)}
