"""Ranked lexical search, term at a time with a limited set of accumulators.

Terms are runs of ASCII letters and digits (A-Z lowered) and everything above ASCII. Items are searched in blocks of
bounded size, so that a block's terms can be broadcast. Per block, one pass over the documents keeps for each of them its
length and the frequencies of the block's terms; counts over all documents follow from that table. Each task then
inverts its documents in portions of bounded size and works through an item's terms from the rarest (in the whole
corpus) to the most frequent. Every posting adds its exact contribution to its document's accumulator. As soon as the largest
contributions that the remaining terms can make, taken together, are below the k-th best score there is (of this portion's
partial scores, or of the task's earlier portions), no document without an accumulator can be in the answer: none is
created from then on, and the remaining terms only update those that exist. A task returns k rows per item, so
hot terms and copies of documents never meet in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from loomtab.functions.staging import materialise

from .common import ragged, raw, slices

BEST = 50
BLOCK_TERMS = 200_000  # distinct terms of items, summed over the items of a block
PORTION_ROWS, PORTION_POSTINGS = 1 << 15, 1 << 21  # documents and postings inverted at a time
CHUNK = 1 << 20  # bytes of a text that are split at a time

# Letters and digits as they are (A-Z lowered), bytes of other characters as they are, anything else a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists that each take a bounded part of it."""
    if not text:
        return
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms array<binary>): the distinct terms of each item id, of all rows that name it."""
    slim = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def split(batches):
        for batch in slices(batches, "text"):
            own = [set().union(*terms_of(t)) for t in raw(batch.column("text"))]
            terms = pa.array([sorted(x) for x in own], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), terms], ["item", "terms"])

    pairs = slim.mapInArrow(split, f"item {slim.schema['item'].dataType.simpleString()}, terms array<binary>")
    return pairs.select("item", F.explode("terms").alias("t")).groupBy("item").agg(F.collect_set("t").alias("terms"))


def _vectors(documents: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """(key, n, terms, counts) per document: its number of terms, and the block's terms in it with their frequencies."""
    slim = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches):
        get = vocabulary.value.get
        for batch in slices(batches, "text"):
            sizes, lengths, terms, counts = [], [], [], []
            for t in raw(batch.column("text")):
                own, n = Counter(), 0
                for words in terms_of(t):
                    n += len(words)
                    own.update(map(get, words))
                own.pop(None, None)
                sizes.append(n)
                lengths.append(len(own))
                terms.extend(own.keys())
                counts.extend(own.values())
            arrays = [pa.array(sizes, pa.int64()), *(ragged(np.array(x, dtype=np.int32), np.array(lengths)) for x in (terms, counts))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], ["key", "n", "terms", "counts"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(count, f"key {kind}, n bigint, terms array<int>, counts array<int>")


def _corpus_counts(vectors: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the number of documents of each of the block's terms."""

    def add(batches):
        total, some = np.zeros(size + 2, np.int64), False
        for batch in batches:
            some = True
            n = batch.column("n").to_numpy()
            total[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            total[size] += np.count_nonzero(n)
            total[size + 1] += n.sum()
        if some:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["t", "n"])

    found = np.zeros(size + 2, np.int64)
    for r in vectors.mapInArrow(add, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect():
        found[r.t] = r.n
    return int(found[size]), int(found[size + 1]), found[:size]


class Portion:
    """Inverted lists of some documents: for each term its documents, their exact contributions and the largest of these."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, documents: int, total: int) -> None:
        m = 50 + (50 * n * documents) // max(total, 1)
        doc = np.repeat(np.arange(len(n)), lengths)
        tf = counts.astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.doc = doc[order]
        self.add = (weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])))[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weight)))])
        self.bound = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            self.bound[some] = np.maximum.reduceat(self.add, self.start[some])
        self.score = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, and their scores: all with at least the k-th score and ``least``.

        ``terms`` come rarest first. Documents that cannot reach ``least`` are left out.
        """
        terms = terms[self.bound[terms] > 0]
        rest = np.concatenate([np.cumsum(self.bound[terms][::-1])[::-1], [0]]).tolist()
        score, alive = self.score, None
        score.fill(0)
        for j, t in enumerate(terms.tolist()):
            if alive is None and (rest[j] < least or (j and np.count_nonzero(score > rest[j]) >= k)):
                alive = np.flatnonzero(score)
            doc, add = (x[self.start[t] : self.start[t + 1]] for x in (self.doc, self.add))
            if alive is None:
                score[doc] += add
            elif 8 * len(alive) < len(doc):
                at = np.searchsorted(doc, alive)
                at[at == len(doc)] = 0
                hit = doc[at] == alive
                score[alive[hit]] += add[at[hit]]
            else:
                old = score[doc] > 0
                score[doc[old]] += add[old]
        found = np.flatnonzero(score) if alive is None else alive
        value = score[found]
        if len(found) > k:
            least = max(least, int(np.partition(value, len(value) - k)[len(value) - k]))
        good = value >= max(least, 1)
        return found[good], value[good]


def _portions(batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut and gathered up to the bounds of a portion; one document at least."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        size = pc.list_value_length(batch.column("terms")).to_numpy()
        upto, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            stop = min(int(np.searchsorted(upto, base + PORTION_POSTINGS - postings, "right")), start + PORTION_ROWS - rows, batch.num_rows)
            if stop <= start and rows:
                yield held
                held, rows, postings = [], 0, 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            rows, postings, start = rows + stop - start, postings + int(upto[stop - 1] - base), stop
    if held:
        yield held


def _searcher(queries, k: int) -> Callable:
    def search(batches):
        terms_of_items, weight, documents, total = queries.value
        best: list[list[tuple]] = [[] for _ in terms_of_items]
        kind = None
        for held in _portions(batches):
            part = pa.Table.from_batches(held).combine_chunks()
            keys = part.column("key").combine_chunks() if part.num_rows else part.column("key")
            kind = keys.type
            place = np.empty(part.num_rows, np.int64)  # position by key, nulls last
            place[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(part.num_rows)
            lists = [part.column(c).combine_chunks() for c in ("terms", "counts")]
            index = Portion(part.column("n").to_numpy(), pc.list_value_length(lists[0]).to_numpy(), *(x.flatten().to_numpy() for x in lists), weight, documents, total)
            for own, terms in zip(best, terms_of_items):
                at, score = index.best(terms, k, -own[-1][0] if len(own) == k else 0)
                if len(at) > k:
                    chosen = np.lexsort((place[at], -score))[:k]
                    at, score = at[chosen], score[chosen]
                if len(at):
                    names = keys.take(pa.array(at)).to_pylist()
                    own.extend((-s, name is None, name) for s, name in zip(score.tolist(), names))
                    own.sort(key=lambda x: x if not x[1] else x[:2])
                    del own[k:]
        rows = [(i, name, -s) for i, own in enumerate(best) for s, _, name in own]
        if rows:
            i, names, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(names, kind), pa.array(scores, pa.int64())], ["i", "key", "score"])

    return search


def search(documents: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank int, key, score long): the k documents of highest score for each item, best first, scores above 0 only.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))) and a document's score the sum of weight * (10^9 tf div (1000 tf +
    20 m)) over the item's distinct terms, m = 50 + (50 n N div L). Equal scores stand in the order of the key (null last).
    A null or empty text has no terms; it neither counts nor is found. An item without terms, or none of whose
    terms occur, gives no rows. Rows with the same item id (null too) are one item with all their terms; repeated
    documents each count and are each found. Empty tables give no rows. Other columns are not read. Names that are equal
    in both tables do not matter.

    Per block of items: one pass over the texts, a written table of the block's terms in each document, one pass over it
    for counts and one for scores. Shuffled are counts per term and k rows per item and task.
    """
    spark = documents.sparkSession
    asked = materialise(_item_terms(items, item, item_text), "item-terms")
    pairs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = int(pairs // BLOCK_TERMS) + 1
    item_kind, key_kind = asked.schema["item"].dataType.simpleString(), documents.select(f"`{key}`").schema[0].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(blocks)) == b)
        rows = own.collect()
        words = sorted({bytes(t) for r in rows for t in r.terms})
        vocabulary = {w: i for i, w in enumerate(words)}
        vectors = materialise(_vectors(documents, key, text, spark.sparkContext.broadcast(vocabulary)), "vectors")
        n, total, df = _corpus_counts(vectors, len(words))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        sorted_terms = []
        for r in rows:
            ids = np.array(sorted(vocabulary[bytes(t)] for t in r.terms), dtype=np.int64)
            ids = ids[(df[ids] > 0) & (weight[ids] > 0)]
            sorted_terms.append(ids[np.argsort(df[ids], kind="stable")])
        queries = spark.sparkContext.broadcast((sorted_terms, weight, n, total))
        found = vectors.mapInArrow(_searcher(queries, k), f"i int, key {key_kind}, score bigint")
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"i int, item {item_kind}")
        found = found.join(F.broadcast(names), "i").select("item", "key", "score")
        out = found if out is None else out.union(found)
    first = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: the 50 best documents of each benchmark item."""
    return search(documents, benchmark)


SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null),
item as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark where text is not null),
corpus as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from doc where len(w) > 0),
posting as (select r, t, count(*) as tf from (select r, unnest(w) as t from doc) group by r, t),
weight as (
  select t, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from posting, corpus group by t),
scored as (
  select item.item_id, p.r, cast(sum(weight.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(doc.w) * n_docs) // n_terms)))) as bigint) as score
  from item join posting p on item.t = p.t join weight on weight.t = p.t join doc on doc.r = p.r, corpus group by item.item_id, p.r)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored join doc on scored.r = doc.r where score > 0 qualify rank <= 50"""
