"""Repeated windows against brute force: small alphabets, hot passages, many blocks, odd inputs."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomtab.llm import substrings as S


def brute(texts, width):
    words = [[w for w in (t or "").encode().split()] for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for p in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("frequent,block", [(S.FREQUENT, S.BLOCK_WORDS), (3, 60)])
@pytest.mark.parametrize("width", [12, 35])
def test_against_brute_force(spark, monkeypatch, frequent, block, width):
    rng = random.Random(width + block)
    word = lambda: rng.choice(["a", "b", "é", "x1", "the", "of."]) if rng.random() < 0.3 else f"w{rng.randint(0, 400)}"
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rng.choice([width - 1, width, width + 1, 60, 90])) for _ in range(8)]
    texts = [None, "", " \n ", say(width - 1), "a " * 200, "a " * 120, say(400)]
    for _ in range(60):
        parts = [say(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), say(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    texts += [texts[9], texts[9], texts[6], passages[3] + " " + passages[3]]
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "BLOCK_WORDS", block)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: r for r in S.remove_repeats(df, width=width, sha=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, width)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == want, (i, texts[i])
        assert got[i].key == "k"


def test_factors_decide(monkeypatch):
    """Starts by factors equal the starts of all long matches, from few looks at the matches."""
    rng = random.Random(9)
    for k in range(60):
        width = rng.choice([3, 5, 12])
        say = lambda n: [f"{rng.randint(0, rng.choice([2, 6, 300]))}" for _ in range(n)]
        shared = [say(rng.randint(1, 3 * width)) for _ in range(4)]
        segments = list({" ".join(say(rng.randint(0, 20)) + rng.choice(shared) + rng.choice(shared) + say(rng.randint(1, 20))).encode() for _ in range(25)})
        words = [x.split() for x in segments]
        count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
        want = [[i for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1] for w in words]
        got = [[i for a, b in own for i in range(a, b)] for own in S.parse_block(segments, width)]
        assert got == want
    seen = []
    duplicate_starts = S._duplicate_starts

    def watched(longest, begin, sizes, width):
        class Counting(np.ndarray):
            def __getitem__(self, i):
                seen.append(np.size(i) if isinstance(i, np.ndarray) else 0)
                return np.asarray(self)[i]
        return duplicate_starts(longest.view(Counting), begin, sizes, width)

    monkeypatch.setattr(S, "_duplicate_starts", watched)
    text = [" ".join(f"{rng.randint(0, 60)}" for _ in range(400)).encode() for _ in range(50)]
    assert not any(S.parse_block(text, 35))
    assert sum(seen) < 1.5 * 2 * 50 * 400 and len(seen) > 0  # the factors only: no start was worth a check


@pytest.mark.parametrize("key", ["text", "words", "segment", "n", "first", "route", "windows", "c0"])
def test_clashing_names_and_long_texts(spark, key):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "x"), (2, long[1000:] + " end", "y"), (3, None, "z")], f"doc_id long, body string, {key} string")
    got = {r.doc_id: (r[key], r.n_words, r.n_removed) for r in S.remove_repeats(df, text="body").collect()}
    total, rest = len(long.split()), len(long[1000:].split())
    assert got[1][::2] == ("x", rest - 1 if not long[999].isspace() else rest) and got[1][1] == total
    assert got[2] == ("y", rest + 1, rest - 1 if not long[999].isspace() else rest) and got[3] == ("z", 0, 0)


def test_texts_and_empty(spark):
    p = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"one  two\n{p} end"), (2, f"{p}"), (3, "left  alone"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in S.remove_repeats(df).collect()}
    assert got == {1: "one two end", 2: "", 3: "left  alone", None: None}
    assert S.remove_repeats(df.limit(0)).count() == 0
    assert S.remove_repeats(df.select("text")).columns == ["n_words", "n_removed", "kept"]
