"""Exact substring deduplication by relative Lempel-Ziv parsing.

A window of ``width`` words is a duplicate if its words also start anywhere else. Parsing every document against every
block of the corpus would cost the square of the corpus, so blocks are formed such that all equal windows meet in
one, and a document is parsed only against the blocks that can hold a copy of a part of it:

1. Anchors. Each window selects its least hashed run of ``GRAM`` words (the last one on a tie). The choice depends on the
   window's words alone, so equal windows have equal anchors. Neighbouring windows mostly share one.
2. Anchors that occur once cannot hold duplicates and are dropped. For the others the segment of text that their windows
   cover goes to the reference block of the anchor. A frequent anchor is dealt by whole windows instead.
3. A block is a suffix-sorted reference of its distinct segments. Each segment is parsed greedily into the longest factors
   that occur elsewhere in the block. A factor of at least ``width`` words is a duplicate span. A duplicate window that a
   factor's end cuts in two must end inside the next factor, because that is the longest match from there on; so only
   the starts from which a window fits into two neighbouring factors are checked, and between short factors there are
   none. Words are compared, not hashes.
4. Duplicate windows of a segment hold for every occurrence of the segment; their spans go back to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtab.functions.staging import materialise

from .common import raw, slices, suffix_order, text_key
from .hashing import run_hashes, word_hashes

WIDTH = 35
GRAM = 10
FREQUENT = 2_000  # occurrences from which an anchor's windows are dealt singly
BLOCK_WORDS = 300_000


def anchors(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, number of windows) of each run of windows that share an anchor."""
    gram = min(GRAM, width)
    none = np.zeros(0, np.int64)
    hashed, owner = word_hashes(texts)
    if len(hashed) < width:
        return none, none, none, none
    n = len(hashed) - gram + 1
    grams = run_hashes(hashed, gram)
    mask = np.uint64((1 << 28) - 1)
    least = (grams & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    span, have = width - gram + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    window = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
    chosen = (mask - (least[window] & mask)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else none
    first = window[new]
    doc_start = np.searchsorted(owner, owner[first], "left")
    return owner[first], grams[chosen[new]].view(np.int64), first - doc_start, np.diff(new, append=len(chosen))


def _duplicate_starts(longest: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Which positions start a window that also starts elsewhere; ``longest``: the longest match elsewhere by position.

    All segments are parsed side by side, one factor of each at a time: inside a factor the starts up to ``width`` before its
    end; across its end those from which a window reaches no further than the end of the next factor, if they match.
    """
    span = np.zeros(len(longest) + 1, dtype=np.int64)
    at, stop = begin[sizes > 0], (begin + sizes)[sizes > 0]
    maybe = []
    while len(at):
        factor = longest[at]
        long = factor >= width
        np.add.at(span, at[long], 1)
        np.add.at(span, at[long] + factor[long] - width + 1, -1)
        end = at + np.maximum(factor, 1)
        inside = end < stop
        low = np.maximum(at + 1, end - width + 1)[inside]
        high = np.minimum(end - 1, end + longest[end] - width)[inside]  # last start whose window ends in the next factor
        some = np.flatnonzero(high >= low)
        if len(some):
            n = high[some] - low[some] + 1
            maybe.append(np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        at, stop = end[inside], stop[inside]
    found = np.cumsum(span)[: len(longest) - 1] > 0
    if maybe:
        cut = np.concatenate(maybe)
        found[cut[longest[cut] >= width]] = True
    return found


def parse_block(segments: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment the ranges [from, to) of window starts that occur elsewhere in the block."""
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number) + 1) for w in s.split()] for s in segments]
    sizes = np.array([len(i) for i in ids])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    for b, own in zip(begin, ids):
        text[b : b + len(own)] = own
    order = suffix_order(text)
    # longest common prefix of neighbours in suffix order; separators match nothing
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int64)
    alive = np.arange(len(a))
    k = 0
    while len(alive):
        x, y = text[np.minimum(a[alive] + k, len(text) - 1)], text[np.minimum(b[alive] + k, len(text) - 1)]
        alive = alive[(x == y) & (x > 0)]
        common[alive] += 1
        k += 1
    longest = np.zeros(len(text) + 1, dtype=np.int64)  # match elsewhere, by position
    longest[order] = np.maximum(np.concatenate([[0], common]), np.concatenate([common, [0]]))
    repeated = _duplicate_starts(longest, begin, sizes, width)
    out = []
    for b, n in zip(begin, sizes):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated[b : b + n].view(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def _digest16(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _finish(text: bytes, windows: list[tuple[int, int]], width: int, sha: bool) -> tuple[int, int, str]:
    """(words, removed words, kept text or its SHA-256)."""
    own = text.split()
    if windows:
        hit = np.zeros(len(own) + 1, dtype=np.int64)
        pairs = np.array(windows)
        np.add.at(hit, pairs[:, 0], 1)
        np.add.at(hit, pairs[:, 1] + width - 1, -1)
        kept = [w for w, h in zip(own, np.cumsum(hit).tolist()) if not h]
    else:
        kept = own
    if sha:
        return len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
    return len(own), len(own) - len(kept), (b" ".join(kept) if len(kept) < len(own) else text).decode()


def remove_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, sha: bool = False) -> DataFrame:
    """``df`` without the text column, plus n_words long, n_removed long and kept string.

    Every word covered by a window of ``width`` words that also starts anywhere else (same document included) is removed;
    windows are judged on the input. ``kept``: the kept words joined by one space, or the text unchanged if nothing
    is removed; with ``sha`` the hex SHA-256 of the kept words joined by one space, in both cases.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A null text
    has no words and stays null (with ``sha``: the digest of nothing); so do texts shorter than a window keep all.
    Repeated rows are each other's copies. An empty table gives no rows. Result columns replace columns of the same
    name. No group is gathered by a key that the data can make hot: anchor counts are summed in the tasks first,
    segments are sent once per task, frequent anchors are dealt by window.
    """
    kept = [c for c in df.columns if c not in (text, "n_words", "n_removed", "kept")]
    names = [f"k{i}" for i in range(len(kept))]
    docs = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("key", text_key(F.col("text")))

    def mark(batches):
        for batch in slices(batches, "text"):
            doc, anchor, first, n = anchors(raw(batch.column("text")), width)
            key = batch.column("key").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([key, pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "anchor", "first", "n"])

    marks = materialise(docs.select("key", "text").filter("text is not null").mapInArrow(mark, "key binary, anchor bigint, first int, n int"), "anchors")
    shared = marks.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1")
    # written before it is joined: only joins of plain shuffles are split where a key is hot
    shared = materialise(shared.select("anchor", (F.col("times") > FREQUENT).alias("frequent")), "shared")
    suspects = marks.join(shared, "anchor").groupBy("key").agg(F.collect_set(F.struct("first", "n", "anchor", "frequent")).alias("runs"))
    suspects = materialise(suspects, "suspects")

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    lead = f"{plain}, " if names else ""
    mixed = f"{lead}text string, key binary, n_words bigint, result string, route bigint, segment binary, first int, n int, words binary"

    def split(batches):
        """Rows of three kinds: finished documents (n_words), documents with suspect runs (text), segments (segment)."""
        seen: set[bytes] = set()
        for batch in slices(batches, "text", 1 << 20):
            done, open_, rows = ([], [], []), [], ([], [], [], [], [], [])
            keys, runs = batch.column("key").to_pylist(), batch.column("runs").to_pylist()
            for i, (t, own) in enumerate(zip(raw(batch.column("text")), runs)):
                if not own:
                    total, _, result = _finish(t or b"", [], width, sha)
                    done[0].append(i)
                    done[1].append(total)
                    done[2].append(None if t is None and not sha else result)
                    continue
                open_.append(i)
                w = t.split()
                for run in own:
                    pieces = [(run["first"], run["n"])] if not run["frequent"] else [(run["first"] + j, 1) for j in range(run["n"])]
                    for first, n in pieces:
                        content = b" ".join(w[first : first + n + width - 1])
                        name = _digest16(content)
                        new = name not in seen
                        if new:
                            if len(seen) >= 500_000:
                                seen.clear()
                            seen.add(name)
                        route = int.from_bytes(name[:8], "little", signed=True) if run["frequent"] else run["anchor"]
                        for column, value in zip(rows, (keys[i], route, name, first, n, content if new else None)):
                            column.append(value)
            own = batch.select(names) if names else None
            blank = lambda n, kind: pa.nulls(n, kind)
            texts = batch.column("text").cast(pa.string())

            def emit(take, columns):
                n = len(columns["_n"])
                head = list(own.take(pa.array(take, pa.int64())).columns) if own is not None and take is not None else [blank(n, f.type) for f in (own.schema if own is not None else [])]
                order = (("text", pa.string()), ("key", pa.binary()), ("n_words", pa.int64()), ("result", pa.string()), ("route", pa.int64()),
                         ("segment", pa.binary()), ("first", pa.int32()), ("n", pa.int32()), ("words", pa.binary()))
                tail = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else blank(n, k) for c, k in order]
                return pa.RecordBatch.from_arrays([*head, *tail], [*names, *[c for c, _ in order]])

            if done[0]:
                yield emit(done[0], {"_n": done[0], "n_words": done[1], "result": done[2]})
            if open_:
                at = pa.array(open_, pa.int64())
                yield emit(open_, {"_n": open_, "text": texts.take(at), "key": pa.array([keys[i] for i in open_], pa.binary())})
                yield emit(None, {"_n": rows[0], **dict(zip(("key", "route", "segment", "first", "n", "words"), rows))})

    staged = materialise(docs.join(suspects, "key", "left").select(*names, "text", "key", "runs").mapInArrow(split, mixed), "segments")

    def parse(batches):
        now: dict[bytes, bytes] = {}
        words, last = 0, None

        def close():
            found = [(s, r) for s, r in zip(now, parse_block(list(now.values()), width)) if r]
            flat = [(s, a, b) for s, own in found for a, b in own]
            columns = list(zip(*flat)) if flat else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32()))], ["segment", "a", "b"])

        for batch in slices(batches, "words", 1 << 18):
            for route, name, content in zip(*(batch.column(c).to_pylist() for c in ("route", "segment", "words"))):
                if words > BLOCK_WORDS and route != last:
                    yield close()
                    now, words = {}, 0
                if name not in now:
                    now[name] = content
                    words += content.count(b" ") + 1
                last = route
        if now:
            yield close()

    pieces = staged.filter("segment is not null")
    reference = pieces.filter("words is not null").select("route", "segment", "words")
    parsed = reference.repartition("route").sortWithinPartitions("route").mapInArrow(parse, "segment binary, a int, b int")
    often = pieces.groupBy("segment").agg(F.count("*").alias("times"), F.first("n").alias("n")).filter("times > 1")
    repeated = materialise(parsed.union(often.select("segment", F.lit(0).alias("a"), F.col("n").alias("b"))), "repeated")
    spans = pieces.select("segment", "key", "first").join(repeated, "segment").groupBy("key").agg(
        F.collect_set(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))).alias("windows"))
    spans = materialise(spans, "spans")

    def cut(batches):
        for batch in slices(batches, "text"):
            found = [_finish(t, [(s["a"], s["b"]) for s in own or []], width, sha) for t, own in zip(raw(batch.column("text")), batch.column("windows").to_pylist())]
            arrays = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *arrays] if names else arrays, [*names, "n_words", "n_removed", "kept"])

    opened = staged.filter("text is not null").select(*names, "text", "key").join(spans, "key", "left").select(*names, "text", "windows")
    finished = staged.filter("n_words is not null").select(*names, "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("result").alias("kept"))
    out = opened.mapInArrow(cut, f"{lead}n_words bigint, n_removed bigint, kept string").union(finished)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "n_words", "n_removed", "kept")


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(documents.select("doc_id", "text"), sha=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
with doc as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as g from (select r, w, unnest(range(1, len(w) - 33)) as i from doc)),
often as (select g from win group by g having count(*) > 1),
hit as (select r, list(distinct p) as ps from (select r, unnest(range(i, i + 35)) as p from win semi join often using (g)) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
       sha256(array_to_string(case when ps is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end, ' ')) as kept_sha256
from doc left join hit on doc.r = hit.r"""
