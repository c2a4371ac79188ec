"""FM-index search against plain counting, and contamination against brute force."""
import hashlib
import random

import numpy as np
import pytest

from loomtab.llm import decontaminate as D


def brute(docs, items, width=13):
    windows = {}
    for name, text in items:
        w = D.words_of(text.encode() if text is not None else None)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name or "")
    out = []
    for text in docs:
        w = D.words_of(text.encode() if text is not None else None)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        text = rng.integers(0, 4, n).astype(np.int32)
        text = np.concatenate([[0], text, [0]]).astype(np.int32)
        index = D.FMIndex(text)
        for size in (1, 2, 5):
            windows = rng.integers(1, 6, (40, size)).astype(np.int32)
            low, high = index.search(windows)
            for w, a, b in zip(windows, low, high):
                want = [i for i in range(len(text) - size + 1) if np.array_equal(text[i : i + size], w)]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_against_brute_force(spark, monkeypatch, blocks):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("ab cd ef gh ij kl é2 the OF".split()) + rng.choice(["", ".", ", "]) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([0, 1, 3, 12, 13, 14, 40]) if k else 20)) for k in range(30)]
    items = [i for i in items if len(D.words_of(i[1].encode())) != 1] + [("zz", None), (None, say(15)), ("i3", say(30))]
    docs = [None, "", "...", say(5)] + [say(rng.randint(1, 60)) + " " + (rng.choice(items)[1] or "").upper() + " X " + say(rng.randint(0, 300)) for _ in range(40)]
    docs += [docs[9], docs[9], " ".join(["ab cd"] * 5000)]
    if blocks > 1:
        monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(docs)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in D.digest(df, bench).collect()}
    for i, (n, hit, names) in enumerate(brute(docs, items)):
        assert (got[i].n_words, got[i].n_hit, got[i].items_sha256) == (n, hit, names), i
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    assert D.digest(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.digest(df, bench.limit(0)).collect())
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not r.contaminated for r in got.values())


def test_cut_spans(spark):
    item = " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"Start, {item.upper()}; end é."), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.cut_spans(D.find_spans(df, spark.createDataFrame([("a", item)], "item_id string, text string"))).collect()}
    assert got == {1: "Start, ; end é.", 2: "nothing here", 3: None}
