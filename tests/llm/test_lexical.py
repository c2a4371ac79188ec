"""Ranked search against a plain version; when accumulators stop; odd tables."""
import math
import random
import re
from collections import Counter

import numpy as np

from loomtab.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_version(docs, items, k):
    docs = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, w in docs:
            tf, score = Counter(w), 0
            m = 50 + (50 * len(w) * n) // max(total, 1)
            for t in own & tf.keys():
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def table(rng, n):
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(5000)] + ["É1", "é", "漢字"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(n // 3)]  # a third are copies: ties
    docs += [(5, docs[5][1]), (7, "another text with the id of seven, w1 w2"), (None, docs[5][1]), (90001, None), (90002, ""), (90003, "., -")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(20)]
    items += [(0, "W1, É1-w1; w3"), (50, None), (51, "nowhere"), (52, docs[5][1]), (None, "w4 w5")]
    return docs, items


def run(spark, docs, items, k, parts=3):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int").repartition(parts)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    return sorted(map(tuple, L.search(d, i, k).collect()), key=repr)


def test_against_plain_version(spark, monkeypatch):
    docs, items = table(random.Random(1), 240)
    assert run(spark, docs, items, 50) == plain_version(docs, items, 50)
    assert run(spark, docs, items, 4, 1) == plain_version(docs, items, 4)
    monkeypatch.setattr(L, "BLOCK_TERMS", 40)  # several blocks of items
    assert run(spark, docs, items, 9, 2) == plain_version(docs, items, 9)


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(0)
    n, size = 4000, 30
    df = np.sort(rng.integers(5, n, size))
    doc = [np.sort(rng.permutation(n)[:d]) for d in df]
    t = np.repeat(np.arange(size), df)
    order = np.argsort(np.concatenate(doc), kind="stable")
    flat, lengths = t[order], np.bincount(np.concatenate(doc), minlength=n)
    counts = rng.integers(1, 5, len(flat))
    length = lengths + rng.integers(1, 50, n)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    part = L.Portion(length, lengths, flat, counts, weight, n, int(length.sum()))
    want = np.zeros(n, np.int64)
    np.add.at(want, part.doc, part.add)
    for k in (1, 10, 100):
        at, score = part.best(np.arange(size), k, 0)
        kth = np.sort(want)[-k]
        assert set(at) == set(np.flatnonzero(want >= kth)) and (score == want[at]).all()
        assert 0 < np.count_nonzero(part.score) < np.count_nonzero(want)  # some never got an accumulator
    assert not len(part.best(np.arange(size), 5, int(want.max()) * 10)[0]) and not part.score.any()


def test_portions_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 7)
    assert [w for part in L.terms_of("Ab c1-É déjà  xyzxyzxyzxyz q".encode()) for w in part] == [w.encode() for w in terms("Ab c1-É déjà  xyzxyzxyzxyz q")]
    monkeypatch.undo()
    docs = [(i, f"a{i % 3} " * 300_000 + "end") for i in range(4)] + [(9, "a1"), (10, "end " * 5)]
    items = [(1, "a1 end"), (2, "a0")]
    assert run(spark, docs, items, 3) == plain_version(docs, items, 3)
    monkeypatch.setattr(L, "PORTION_ROWS", 7)
    monkeypatch.setattr(L, "PORTION_POSTINGS", 20)
    docs, items = table(random.Random(2), 60)
    assert run(spark, docs, items, 5, 1) == plain_version(docs, items, 5)  # bounds hold in this process only; results are alike


def test_portions_keep_all_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "PORTION_ROWS", 7)
    monkeypatch.setattr(L, "PORTION_POSTINGS", 20)
    rng = random.Random(3)
    rows = [(i, [1] * rng.choice([0, 1, 5, 19, 20, 21, 50])) for i in range(100)]
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in rows[a : a + 13]], "terms": [r[1] for r in rows[a : a + 13]]}) for a in range(0, 100, 13)]
    parts = [pa.Table.from_batches(p) for p in L._portions(batches)]
    assert [k for p in parts for k in p.column("key").to_pylist()] == list(range(100))
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(map(len, p.column("terms").to_pylist())) <= 20) for p in parts)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert run(spark, [], items, 5) == [] and run(spark, docs, [], 5) == []
    assert run(spark, [(1, None)], items, 5) == []
    text_keys = spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string")
    found = L.search(text_keys, spark.createDataFrame([("i", "x")], "item_id string, text string")).collect()
    assert [tuple(r)[:3] for r in found] in ([("i", 1, "a"), ("i", 2, "b")], [])  # a term in every document may weigh 0
