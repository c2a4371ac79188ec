"""Packing token sequences: best fit, then a swap-based local search that empties bins.

Documents become token pieces (`pieces`); pieces are dealt to blocks of bounded size, each packed in one task
(`pack_lengths`). The local search works on bins that are not full. It makes only changes that raise the sum of
squared fills: a piece moves into a fuller bin, one piece changes places with one, or two with one, so that the
fuller bin gets fuller. Bins that lose their last piece are gone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import numbered, slices
from .tokens import Id, encoder, tokenizer_path

CAPACITY = 2048
END = 0  # id that closes a document
BLOCK = 16_384  # pieces packed together


def pieces(documents: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``documents`` without the text, plus piece, start, length and ids (little-endian 32-bit binary), a row per piece.

    A document is the ids of its whole text and then ``END``; null counts as empty and gives the end alone. Only
    documents over ``capacity`` are cut: the first piece takes the remainder, all others are full. The ids are
    the library's own by default: a control string of the vocabulary inside a text is its one id.
    """
    path = path or tokenizer_path()
    kept = [c for c in documents.columns if c not in (text, "piece", "start", "length", "ids")]
    there, back = numbered(kept)
    source = documents.select(*there, F.col(f"`{text}`").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def cut(batches):
        encode = encoder(path, control=True).encode
        end = np.array([END], dtype=Id).tobytes()
        for batch in slices(batches, "text"):
            rows, out = [], ([], [], [], [])
            for i, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    n = (total - 1) % capacity + 1 if at == 0 else capacity
                    rows.append(i)
                    for column, value in zip(out, (k, at, n, ids[4 * at : 4 * (at + n)])):
                        column.append(value)
                    at, k = at + n, k + 1
            own = batch.take(pa.array(rows, pa.int64())).drop_columns(["text"])
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, "piece", "start", "length", "ids"])

    found = source.mapInArrow(cut, fields + "piece int, start bigint, length bigint, ids binary")
    return found.select(*back, "piece", "start", "length", "ids")


def _best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin with room. Room is found in a bit set."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= n
        else:
            b, room = len(bins), capacity - n
            bins.append([i])
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search between underfull bins until a sweep changes nothing.

    Take a bin with room r (fuller bins first). The best change for it, from the bins that are no fuller, is the one that
    fills it most: a move adds a piece of at most r; a swap gives one piece a for one piece b with a < b <= a + r, or
    for two pieces of one bin with sum in the same range. Each raises the sum of squares, since the gaining bin was not
    the emptier. Pieces are found by length and pairs by sum, in bit sets: all of them are searched.
    """
    size = [int(x) for x in lengths]
    fill = [sum(size[i] for i in b) for b in bins]
    while True:
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (-fill[b], b))
        changed = False
        # pieces of underfull bins by length, most room last: a donor is the emptiest bin that has the length
        where: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        has = 0
        # pairs of underfull bins by sum; an entry counts while its bin has the version it was made from
        pairs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        paired, version = 0, [0] * len(bins)
        for b in under:
            for i in bins[b]:
                where[size[i]][i] = b
                has |= 1 << size[i]

        def list_pairs(b: int) -> None:
            """Two pieces of each pair of lengths in a bin."""
            nonlocal paired
            version[b] += 1
            first: dict[int, list[int]] = {}
            for i in bins[b]:
                if len(first.setdefault(size[i], [])) < 2:
                    first[size[i]].append(i)
            own = sorted(first)
            for k, m in enumerate(own):
                for n in own[k:]:
                    if m + n > capacity:
                        break
                    if m != n:
                        one, two = first[n][0], first[m][0]
                    elif len(first[m]) == 2:
                        one, two = first[m]
                    else:
                        continue
                    pairs[m + n].append((one, two, b, version[b]))
                    paired |= 1 << (m + n)

        def pair(most: int, least: int, b: int) -> tuple[int, int] | None:
            """Two pieces of one bin no fuller than b with the largest sum in [least, most]."""
            nonlocal paired
            at = paired & ((1 << (most + 1)) - 1)
            while at:
                n = at.bit_length() - 1
                if n < least:
                    return None
                own = pairs[n]
                while own and own[-1][3] != version[own[-1][2]]:
                    own.pop()
                if not own:
                    paired &= ~(1 << n)
                for one, two, home, made in reversed(own):
                    if made == version[home] and home != b and fill[home] <= fill[b]:
                        return one, two
                at &= ~(1 << n)
            return None

        for b in under:
            list_pairs(b)

        def drop(i: int) -> None:
            nonlocal has
            del where[size[i]][i]
            if not where[size[i]]:
                has &= ~(1 << size[i])

        def add(i: int, b: int) -> None:
            nonlocal has
            where[size[i]][i] = b
            has |= 1 << size[i]

        def donor(most: int, least: int, b: int) -> int:
            """The longest piece of length in [least, most] in a bin no fuller than b; -1 if none."""
            at = has & ((1 << (most + 1)) - 1)
            while at:
                n = at.bit_length() - 1
                if n < least:
                    return -1
                for i, own in reversed(where[n].items()):
                    if own != b and fill[own] <= fill[b]:
                        return i
                at &= ~(1 << n)
            return -1

        for b in under:
            while bins[b] and fill[b] < capacity:
                room, best = capacity - fill[b], None
                i = donor(room, 1, b)
                if i >= 0:
                    best = (size[i], [], [i])
                if best is None or best[0] < room:
                    for a in sorted({size[x]: x for x in bins[b]}.values(), key=lambda x: size[x]):
                        i = donor(min(capacity, size[a] + room), size[a] + 1 + (best[0] if best else 0), b)
                        if i >= 0:
                            best = (size[i] - size[a], [a], [i])
                            if best[0] == room:
                                break
                if best is None or best[0] < room:
                    for a in {size[x]: x for x in bins[b]}.values():
                        two = pair(min(capacity, size[a] + room), size[a] + 1 + (best[0] if best else 0), b)
                        if two:
                            best = (size[two[0]] + size[two[1]] - size[a], [a], list(two))
                            if best[0] == room:
                                break
                if best is None:
                    break
                gain, out, got = best
                home = where[size[got[0]]][got[0]]
                for i in got:
                    bins[home].remove(i)
                    bins[b].append(i)
                    drop(i)
                for i in out:
                    bins[b].remove(i)
                    bins[home].append(i)
                    drop(i)
                    add(i, home)
                fill[b] += gain
                fill[home] -= gain
                if fill[b] < capacity:
                    for i in got:
                        add(i, b)
                else:
                    for i in bins[b]:
                        where[size[i]].pop(i, None)
                        if not where[size[i]]:
                            has &= ~(1 << size[i])
                    version[b] += 1
                if fill[b] < capacity:
                    list_pairs(b)
                list_pairs(home)
                changed = True
        if not changed:
            return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. No length may exceed the capacity; bins are numbered from 0."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, own in enumerate(_improve(_best_fit(lengths, capacity), lengths, capacity)):
        own = np.array(sorted(own, key=lambda i: (-int(lengths[i]), i)))
        where[own] = b
        offset[own] = np.cumsum(lengths[own]) - lengths[own]
    return where, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, length: str = "length") -> DataFrame:
    """``parts`` (a row per piece with its length) plus ``sequence_id`` long and ``offset`` long.

    Pieces are dealt round-robin into blocks of about ``block`` rows (so no key can be hot) and each block is packed by one
    task; what a block wastes is about one bin in thousands. Repeated rows are packed each. Ties are broken by the
    order in the block. No rows: no rows. The result is written once, because a repeated task need not
    see its rows in the same order.
    """
    from loomtab.functions.staging import materialise

    staged = materialise(parts.drop("sequence_id", "offset"), "pieces")
    blocks = max(1, -(-staged.count() // block))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in staged.schema.fields)

    def place(batches):
        from pyspark import TaskContext

        own = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if own is None:
            return
        bins, offsets = pack_lengths(own.column(length).to_numpy(), capacity)
        number = bins + (TaskContext.get().partitionId() << 32)
        own = own.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))
        yield from own.to_batches()

    return materialise(staged.repartition(blocks).mapInArrow(place, fields + "sequence_id bigint, offset bigint"), "packed")


def pack_documents(documents: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids and places: the rows of the sequences to train on."""
    return pack(pieces(documents, text, path, capacity), capacity)


def digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns. The ids are digested before packing, so only lengths and places move."""
    cut = pieces(documents.select("doc_id", "text"), path=path)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim)
