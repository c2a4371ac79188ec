"""Language identification as multilingual mixture inference.

Model: hashed letter trigrams of words (edges of words included), one smoothed distribution per language, counted over
all labelled training rows. A document is a bag of words; each word comes from one of a set of languages. Expectation
maximisation estimates the proportions of a set; sets grow by one language at a time, as long as the log likelihood
gains more than a penalty that grows with the logarithm of the number of words. The prediction is the language with
the largest proportion, its score that proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, slices

BITS = 16
MAX_LANGUAGES = 256  # bound of the model: 256 languages x 65 536 buckets
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-case code point for letters, 0 for everything else."""
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


@dataclass
class Words:
    """Hashed trigrams of the words of some texts. ``start``: first trigram of each word; ``owner``: text of each word."""

    grams: np.ndarray
    start: np.ndarray
    owner: np.ndarray


def words(texts: list[str | None]) -> Words:
    joined = np.frombuffer("\n".join(["", *[t or "" for t in texts], ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _letters()[joined]
    at = np.flatnonzero(low)
    mixed = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    grams = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32)
    start = np.flatnonzero(low[at - 1] == 0)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    return Words(grams, start, np.searchsorted(ends, at[start] - 1, "right"))


def count_trigrams(df: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bucket, n) over all rows with a text and a label; sums are made in each task first."""
    slim = df.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{label}`").cast("string").alias("l")).filter("t is not null and l is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t"):
            labels = batch.column("l").to_pylist()
            found = words(batch.column("t").to_pylist())
            names = sorted(set(labels))
            number = np.array([names.index(x) for x in labels])
            per_gram = np.repeat(number[found.owner], np.diff(found.start, append=len(found.grams)))
            both = np.bincount(per_gram * (1 << BITS) + found.grams, minlength=len(names) << BITS).reshape(len(names), -1)
            for i, name in enumerate(names):
                sums[name] = sums[name] + both[i] if name in sums else both[i]
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, total in sums.items():
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own.astype(np.int32)), pa.array(total[own])], ["label", "bucket", "n"])

    return slim.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # log probability, languages x buckets


def fit(df: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> Model:
    """All rows with a text and a label. No such rows: a model without languages, which predicts ``und`` only."""
    rows = count_trigrams(df, text, label).collect()  # at most MAX_LANGUAGES x 65 536
    names = sorted({r.label for r in rows})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((len(names), 1 << BITS), smoothing)
    at = {n: i for i, n in enumerate(names)}
    for r in rows:
        counts[at[r.label], r.bucket] += r.n
    return Model(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if names else counts)


SETTLED = 0.01  # EM ends when no proportions can raise the log likelihood by more


def _best_shares(ratio: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, gain) of each text: the share of one more language that gains most while the others keep their proportions.
    ``ratio``: likelihood of each word by that language over the one so far. The gain is concave: its slope is halved."""
    low, high = np.zeros(len(size)), np.ones(len(size))
    for _ in range(20):
        t = (low + high) / 2
        up = np.add.reduceat((ratio - 1) / (1 + np.repeat(t, size) * (ratio - 1)), first) > 0
        low, high = np.where(up, t, low), np.where(up, high, t)
    t = (low + high) / 2
    return t, np.add.reduceat(np.log1p(np.repeat(t, size) * (ratio - 1)), first)


def mixtures(texts: list[str | None], model: Model, penalty: float, floor: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [texts, languages], number of words). Rows of texts without a letter are 0."""
    n_languages, d = len(model.names), len(texts)
    share = np.zeros((d, n_languages), dtype=np.float64)
    found = words(texts)
    n = np.bincount(found.owner, minlength=d) if len(found.owner) else np.zeros(d, dtype=np.int64)
    if not n_languages or not len(found.owner):
        return share, n
    log = np.stack([np.add.reduceat(row[found.grams], found.start) for row in model.table], axis=1)
    # relative likelihood of each word; the floor is the chance of a word that fits no language
    like = np.exp(log - log.max(axis=1, keepdims=True)) + np.float32(floor)
    docs = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n[docs])[:-1]])
    share[docs, np.add.reduceat(np.log(like), first, axis=0).argmax(axis=1)] = 1.0
    active, pick = docs, np.arange(len(like))
    for _ in range(n_languages - 1):
        own = like[pick]
        size = n[active]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        now = share[active]
        old = np.einsum("ij,ij->i", own, np.repeat(now, size, axis=0))
        # the log likelihood is concave in the proportions, so its slopes bound what a language can gain
        slope = np.add.reduceat(own / old[:, None], first, axis=0) - size[:, None]
        slope[now > 0] = -np.inf
        need = penalty * np.log(size + 1)
        useful = (slope > need[:, None]).any(axis=1)
        keep = np.repeat(useful, size)
        active, pick, now, size, old, slope, need = active[useful], pick[keep], now[useful], size[useful], old[keep], slope[useful], need[useful]
        if not len(active):
            break
        own = own[keep]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        # of the languages that may gain enough the one that gains most
        best, at, new = np.full(len(active), -np.inf), np.zeros(len(active)), np.zeros(len(active), dtype=np.int64)
        for j in range(n_languages):
            some = np.flatnonzero(slope[:, j] > need)
            if not len(some):
                continue
            words_ = np.repeat(slope[:, j] > need, size)
            t, gain = _best_shares(own[words_, j] / old[words_], np.concatenate([[0], np.cumsum(size[some])[:-1]]), size[some])
            more = gain > best[some]
            best[some[more]], at[some[more]], new[some[more]] = gain[more], t[more], j
        before = np.add.reduceat(np.log(old), first)
        now = now * (1 - at)[:, None]
        now[np.arange(len(active)), new] = at
        better = np.zeros(len(active), dtype=bool)
        live, part, n_words = np.arange(len(active)), own, size
        while len(live):
            start = np.concatenate([[0], np.cumsum(n_words)[:-1]])
            mix = np.einsum("ij,ij->i", part, np.repeat(now[live], n_words, axis=0))
            pull = np.add.reduceat(part / mix[:, None], start, axis=0)
            left = np.where(now[live] > 0, pull, -np.inf).max(axis=1) - n_words  # bounds what is still to gain
            gain = np.add.reduceat(np.log(mix), start) - before[live]
            better[live] = gain > need[live]
            go = (left > SETTLED) & (gain + left > need[live])
            now[live[go]] *= pull[go] / n_words[go][:, None]
            part, live, n_words = part[np.repeat(go, n_words)], live[go], n_words[go]
        share[active[better]] = now[better]
        pick, active = pick[np.repeat(better, size)], active[better]
        if not len(active):
            break
    return share, n


def predict(df: DataFrame, model: Model, text: str = "text", penalty: float = 4.0) -> DataFrame:
    """``df`` plus lang_pred string, score double, languages map<string,double> (the chosen set with proportions).

    Only the text is looked at, as a whole. Null texts and texts without a letter are ``und`` with score 0 and no
    languages; so is everything when the model knows no language. Equal proportions: the first language by name.
    Rows are independent; columns with the names of the results are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "languages")]
    there, back = numbered(kept)
    source = df.select(*there, F.col(f"`{text}`").cast("string").alias("text"))
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields)
    sent = df.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, (1 << 23) // max(4, len(model.names)))

    def guess(batches):
        model = sent.value
        for batch in slices(batches, "text", limit):
            share, _ = mixtures(batch.column("text").to_pylist(), model, penalty)
            share = np.round(share, 6)
            top = share.argmax(axis=1) if model.names else np.zeros(len(share), dtype=int)
            some = share.sum(axis=1) > 0
            names = [model.names[t] if s else "und" for t, s in zip(top, some)]
            scores = [float(share[i, t]) if s else 0.0 for i, (t, s) in enumerate(zip(top, some))]
            sets = [[(model.names[j], float(row[j])) for j in np.flatnonzero(row)] for row in share]
            arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "lang_pred", "score", "languages"])

    found = source.mapInArrow(guess, columns + "lang_pred string, score double, languages map<string,double>")
    return found.select(*back, "lang_pred", "score", "languages")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit_on_fold(documents: DataFrame) -> Model:
    return fit(documents.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns, and the chosen languages as JSON."""
    found = predict(documents.select("doc_id", "text"), fit_on_fold(documents))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def identified(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents that have a language: neither ``und`` nor a mixture without any share of ``least``."""
    found = predict(documents, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[F.col(f"`{c}`") for c in documents.columns])
