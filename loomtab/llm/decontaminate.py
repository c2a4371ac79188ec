"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters and digits (`[0-9a-z]` and everything above ASCII) after lower-casing A-Z. A window is
13 consecutive words of an item; an item of fewer words is one window. Each task cuts its documents into shards
of bounded size, indexes a shard's words (suffix array, Burrows-Wheeler text in a wavelet tree, sampled suffix
positions) and searches all windows backwards at once. Occurrences become word spans; overlapping spans merge.

Words that no window contains can never be inside an occurrence: they become one separator, and stretches
between separators that are shorter than the shortest window are left out of the index. This is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import numbered, ragged, raw, slices, suffix_order

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD_WORDS = 1 << 20  # words in one index
BLOCK_BYTES = 8 << 20  # text of the items searched at a time
SAMPLE = 16  # every 16th suffix position is kept


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Windows:
    """The distinct windows of a block of items, by length, and the items that own each of them, all as arrays.

    ``groups``: (windows, first, owners) per length; the owners of window w are ``owners[first[w] : first[w + 1]]``, numbers
    of ``names`` in ascending order.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], width: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        parts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32) for _, text in items]
        owner = np.array([number[name] for name, _ in items], dtype=np.int32)
        length = np.array([len(p) for p in parts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        size = np.minimum(length, width)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            count = length[own] - n + 1
            start = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows = np.lib.stride_tricks.sliding_window_view(flat, n)[start]
            by = np.repeat(owner[own], count)
            order = np.lexsort((by, *rows.T[::-1]))
            rows, by = rows[order], by[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            once = new | np.concatenate([[True], by[1:] != by[:-1]])  # a window that an item has twice is one of its own
            first = np.concatenate([np.flatnonzero(new[once]), [once.sum()]])
            self.groups.append((rows[new], first, by[once]))
        self.shortest = min((g.shape[1] for g, *_ in self.groups), default=0)


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector with running counts per bit of the symbols, high bit first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ones = bits, [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(np.int32)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(upto), upto
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b) & 1 == 1
            count = self.ones[level]
            low = np.where(one, self.zeros[level] + count[low], low - count[low])
            high = np.where(one, self.zeros[level] + count[high], high - count[high])
        return high - low


class FMIndex:
    """Backward search and location of word sequences in stretches of words parted by 0."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_order(text)
        self.last = text[order - 1] if len(text) else text  # text ends with 0, so the first suffix wraps to a separator
        self.largest = int(text.max(initial=0))
        self.tree = WaveletTree(self.last, max(1, self.largest.bit_length()))
        counts = np.bincount(text, minlength=self.largest + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # kept positions: every SAMPLE-th, and starts of stretches, so that a walk never crosses a separator
        keep = (order % SAMPLE == 0) | (self.last == 0)
        self.kept_upto = np.concatenate([[0], np.cumsum(keep)])
        self.kept, self.position = keep, order[keep]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all windows of one length (0 < symbol <= largest in the text)."""
        low = np.zeros(len(windows), dtype=np.int64)
        high = np.full(len(windows), len(self.last), dtype=np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[:, j].astype(np.int64)
            known = c <= self.largest
            c = np.where(known, c, 0)
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
            high = np.where(known, high, low)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step to the left until a kept position."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.kept[at])
        while len(todo):
            c = self.last[at[todo]].astype(np.int64)
            at[todo] = self.first[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.kept[at[todo]]]
        return self.position[self.kept_upto[at]] + steps


def search_shard(docs: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, set[int]]]:
    """For each document (word ids, 0: unknown): which words are hit, and the numbers of the items found."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    hit = np.zeros(len(flat) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in docs]
    owner = np.repeat(np.arange(len(docs)), sizes)
    # stretches of known words within one document
    known = flat > 0
    begins = known & np.concatenate([[True], ~known[:-1] | (owner[1:] != owner[:-1])]) if len(flat) else known
    run = np.cumsum(begins) * known
    keep = known & (np.bincount(run)[run] >= windows.shortest) if len(flat) else known
    where = np.flatnonzero(keep)
    if len(where):
        gap = np.concatenate([[True], run[where][1:] != run[where][:-1]])
        at = np.arange(len(where)) + np.cumsum(gap)
        text = np.zeros(at[-1] + 2, dtype=np.int32)
        back = np.zeros(len(text), dtype=np.int64)
        text[at], back[at] = flat[where], where
        index = FMIndex(text)
        for group, first, owners in windows.groups:
            low, high = index.search(group)
            found = np.flatnonzero(high > low)
            n = (high - low)[found]
            if not len(found):
                continue
            rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            begin = back[index.locate(rows)]
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + group.shape[1], -1)
            for d, w in {*zip(owner[begin].tolist(), np.repeat(found, n).tolist())}:
                items[d].update(owners[first[w] : first[w + 1]].tolist())
    covered = np.cumsum(hit)[:-1] > 0
    return [(covered[starts[i] : starts[i + 1]], items[i]) for i in range(len(docs))]


def _shards(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SHARD_WORDS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _finder(block, text_column: str):
    """Batches of documents to batches with n_words, spans and items added."""

    def find(batches):
        windows = block.value
        get = windows.vocabulary.get
        for batch in slices(batches, text_column, 4 << 20):
            ids = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int32) for t in raw(batch.column(text_column))]
            found = [x for a, b in _shards([len(d) for d in ids]) for x in search_shard(ids[a:b], windows)]
            edges = [np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]]))) for c, _ in found]
            counts = np.array([len(e) // 2 for e in edges])
            flat = np.concatenate(edges).astype(np.int64) if edges else np.zeros(0, np.int64)
            names = [[windows.names[k] for k in sorted(i)] for _, i in found]
            spans = [ragged(flat[k::2], counts) for k in (0, 1)]
            arrays = [*batch.columns, pa.array([len(d) for d in ids], pa.int64()), *spans, pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__n_words", "__from", "__to", "__items"])

    return find


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of bounded text size: the number of blocks follows from the measured total."""
    slim = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")
    # An item counted twice is the same item; its windows are those of all its texts.
    total = slim.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = int(total // BLOCK_BYTES) + 1
    for b in range(blocks):
        part = slim if blocks == 1 else slim.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield [(r.i if r.i is not None else "", r.t.encode()) for r in part.collect()]


def find_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", width: int = 13) -> DataFrame:
    """``documents`` plus ``n_words`` long, ``spans`` array<struct<start,end>> (word positions, end exclusive,
    merged and in order), ``n_hit`` long, ``items`` array<string> (sorted) and ``contaminated`` boolean.

    Contaminated: at least one word is hit and 20 * n_hit >= n_words. A null or empty text has no words and no
    hits; so has every document when the benchmark is empty. Null item texts are skipped, a null item id counts
    as the empty name. Repeated documents are judged alike. Columns with the names of the results are replaced.

    One pass over the documents per block of ``BLOCK_BYTES`` of items, without a shuffle; a block is broadcast.
    """
    results = ("n_words", "spans", "n_hit", "items", "contaminated")
    names = [c for c in documents.columns if c not in results]
    there, back = numbered(names)
    body = f"c{names.index(text)}"
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    now = documents.select(*there, none.alias("__spans"), F.expr("cast(array() as array<string>)").alias("__all"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields)
    schema = f"{fields}, __n_words bigint, __from array<bigint>, __to array<bigint>, __items array<string>"
    for items in _item_blocks(benchmark, item, item_text):
        block = documents.sparkSession.sparkContext.broadcast(Windows(items, width))
        found = now.mapInArrow(_finder(block, body), schema).withColumns({
            "__spans": F.concat("__spans", F.arrays_zip(F.col("__from").alias("start"), F.col("__to").alias("end"))),
            "__all": F.array_union("__all", "__items"),
        })
        now = found.select(*[f"c{i}" for i in range(len(names))], "__spans", "__all")
    # merge spans that meet, across blocks too
    merged = F.expr("""aggregate(array_sort(__spans), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= s.start
             then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, s.end) as end)))
             else concat(acc, array(s)) end)""")
    out = found.select(*back, F.col("__n_words").alias("n_words"), merged.alias("spans"), F.array_sort("__all").alias("items"))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents that are not contaminated, with their own columns and whole texts."""
    found = find_spans(documents, benchmark, text, **settings)
    return found.filter(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in documents.columns])


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``find_spans`` with the hit words taken out of ``text``; the words around a cut keep their bytes."""

    def cut(batches):
        for batch in slices(batches, text):
            spans, out = batch.column("spans").to_pylist(), []
            for t, own in zip(raw(batch.column(text)), spans):
                if t is None or not own:
                    out.append(None if t is None else t.decode())
                    continue
                at = [m.span() for m in WORD.finditer(t.lower())]
                parts, last = [], 0
                for s in own:
                    parts.append(t[last : at[s["start"]][0]])
                    last = at[s["end"] - 1][1]
                out.append(b"".join([*parts, t[last:]]).decode())
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, text, pa.array(out, pa.string()))

    return found.mapInArrow(cut, found.schema)


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = find_spans(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with item as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
win as (
  select distinct item, least(13, len(w)) as size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from item where len(w) > 0)),
doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
grams as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from win))),
hits as (select doc_id, i, size, item from grams join win using (size, g)),
words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)) group by doc_id),
items as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as names from hits group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(words.n, 0) > 0 and 20 * coalesce(words.n, 0) >= len(w) as contaminated
from doc left join words on doc.doc_id = words.doc_id left join items on doc.doc_id = items.doc_id"""
