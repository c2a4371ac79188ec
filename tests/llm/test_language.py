"""Language mixtures: held-out accuracy, mixed texts, a plain EM beside the vectorised one, odd inputs."""
import math

import numpy as np
from pyspark.sql import functions as F

from loomtab.llm import language as L


def brute_words(text):
    out, now = [], []
    for c in text + "\n":
        if c.isalpha():
            now.append(c)
        elif now:
            out.append("".join(now))
            now = []
    return out


def test_words_and_owners():
    texts = ["Ab cé", None, "", "12 !", "x", "日本 y1z"]
    found = L.words(texts)
    want = [(i, len(w)) for i, t in enumerate(texts) for w in brute_words(t or "")]
    sizes = np.diff(found.start, append=len(found.grams))
    assert list(zip(found.owner.tolist(), sizes.tolist())) == want
    assert np.array_equal(L.words(["AB cÉ"]).grams, L.words(["ab cé"]).grams)


def test_held_out_accuracy_and_result_shape(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = L.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_against_plain_em(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit_on_fold(docs)
    one = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    a, b = sorted(one)[:2]
    text = " ".join(one[a].split()[:300] + one[b].split()[:100])
    share, n = L.mixtures([text, one[a], ""], model, 4.0)
    i, j = model.names.index(a), model.names.index(b)
    assert share[0, i] > share[0, j] > 0.1 and abs(share[0].sum() - 1) < 1e-9
    assert share[1].argmax() == i and n[2] == 0 and share[2].sum() == 0
    # plain EM over the chosen set
    chosen = np.flatnonzero(share[0])
    found = L.words([text])
    like = []
    for w, s in enumerate(found.start):
        e = found.start[w + 1] if w + 1 < len(found.start) else len(found.grams)
        logs = [float(sum(model.table[k, g] for g in found.grams[s:e])) for k in range(len(model.names))]
        like.append([math.exp(x - max(logs)) + 1e-4 for x in logs])
    p = {k: 1 / len(chosen) for k in chosen}
    for _ in range(200):
        total = dict.fromkeys(chosen, 0.0)
        for w in like:
            s = sum(p[k] * w[k] for k in chosen)
            for k in chosen:
                total[k] += p[k] * w[k] / s
        p = {k: v / len(like) for k, v in total.items()}
    assert all(abs(p[k] - share[0, k]) < 0.02 for k in chosen)


def test_odd_inputs(spark):
    rows = [(0, None, "a", "x"), (1, "", "a", "x"), (2, "123 !?", "b", "x"), (3, "hello world", "a", "x"), (3, "hello world", "a", "x"),
            (None, "bonjour monde", None, "x"), (5, "hello " * 40_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.predict(df, L.fit(df)).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "a", "a", "a", "a"]
    assert all(r.score == 0 and r.languages == {} for r in got[:3])
    assert L.identified(df, L.fit(df)).columns == df.columns
    empty = df.limit(0)
    assert L.digest(empty).count() == 0
    assert {r.lang_pred for r in L.predict(df, L.fit(empty)).collect()} == {"und"}


def test_few_words_of_a_second_language_in_a_long_text():
    one, two = "the quick brown fox jumps over lazy dogs ", "größe über straße wüßten mädchen schön zwölf können "
    counts = np.stack([np.bincount(L.words([t * 50]).grams, minlength=1 << L.BITS) + 0.5 for t in (one, two)])
    model = L.Model(["one", "two"], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    for long, few in ((2_475, 25), (250, 3)):  # repeats of eight words: 1 % of a text
        share, n = L.mixtures([one * long + two * few, one * long], model, 4.0)
        assert n[0] == 8 * (long + few) and abs(share[0, 1] - few / (long + few)) < 0.002, share
        assert share[1].tolist() == [1.0, 0.0]
