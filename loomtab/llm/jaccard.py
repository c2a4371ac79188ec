"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Texts with equal shingle sets are one class. The join works on classes; a class' copies are membership.
2. A forest of ``TREES`` tries: each class has one label of ``DEPTH`` MinHash values per trie, and classes that share a
   prefix of a label meet. The pass that makes the labels also compares every row exactly with a bounded sample of
   documents; how long a prefix the true pairs share is the measured recall of each depth. From the longest on,
   the prefix is shortened until the recall that was measured, and the one expected at the measured
   similarities, reach the target. A level of a trie is matched as an equality of its prefixes, not by sorting the labels:
   a run of one prefix may be a third of all classes, and sorted it would be one task.
3. Where classes meet, agreement of their MinHash values bounds the similarity; pairs that may reach the threshold are united.
   Only a spanning forest of them is written, never the pairs.
4. Each group of united classes is verified exactly, all its pairs, on whole shingle sets in tiles of bounded size. A tile
   returns counts per class and a spanning forest of its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtab.functions.staging import materialise

from .common import components, free_name, raw, slices, text_key
from .hashing import run_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999  # over the sample's true pairs
WORST = 0.999  # at the threshold itself, whatever the sample holds
PART = 1 << 19  # shared shingles counted at a time
AUDIT, AUDIT_BYTES = 256, 200_000  # documents of the sample, and the longest text in it
TILE = 256  # classes per side of a tile
MARGIN = 5.0  # standard deviations of the estimated similarity that a pair may lie below the threshold

_PRIMES = np.random.default_rng(20_240_501).integers(1, 1 << 32, size=(2, TREES * DEPTH), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of n words; a shorter text is one run of all its words."""
    words, owner = word_hashes(texts)
    runs = run_hashes(words, n)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def minhash(hashes: np.ndarray) -> np.ndarray:
    """16 bits per function: the least of the hashes under it."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty(_PRIMES.shape[1], dtype=np.uint32)
    step = max(1, (1 << 15) // max(1, len(low)))
    for i in range(0, len(out), step):
        part = (low[None, :] ^ _PRIMES[0, i : i + step, None]) * _PRIMES[1, i : i + step, None]
        part ^= part >> np.uint32(15)
        out[i : i + step] = part.min(axis=1)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def forest_depth(threshold: float, recall: float) -> int:
    """The longest prefix whose matches reach the recall at the threshold."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


class Sample:
    """Shingle sets of the documents that all rows are compared with."""

    def __init__(self, texts: list[bytes], n: int, threshold: float) -> None:
        sets = [x for x in shingle_sets(texts, n) if len(x)]
        self.threshold, self.size = threshold, np.array([len(x) for x in sets], dtype=np.int64)
        self.names = [_name(x) for x in sets]
        self.labels = np.stack([minhash(x).reshape(TREES, DEPTH) for x in sets]) if sets else np.zeros((0, TREES, DEPTH), np.uint16)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]

    def partners(self, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each shingle set the sample's documents at the threshold or above, and the similarities."""
        size = np.array([len(x) for x in sets], dtype=np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        low = np.searchsorted(self.hashes, flat, "left")
        some = np.flatnonzero(low < len(self.hashes))
        some = some[self.hashes[low[some]] == flat[some]]
        low = low[some]
        n = np.searchsorted(self.hashes, flat[some], "right") - low
        met, place = np.unique(np.repeat(np.arange(len(sets)), size)[some], return_inverse=True)
        width, upto, shared = len(self.size), np.cumsum(n), 0
        for lo in range(0, int(upto[-1]) if len(upto) else 0, PART):  # common shingles, a bounded number at a time
            a, b = np.searchsorted(upto, [lo, lo + PART], "right")
            part = n[a:b]
            who = np.repeat(low[a:b] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            shared = shared + np.bincount(np.repeat(place[a:b], part) * width + self.owner[who], minlength=len(met) * width)
        pair = np.flatnonzero(shared)
        doc, own = met[pair // width] if len(met) else pair, pair % max(1, width)
        shared = shared[pair] if len(pair) else pair
        like = shared / (size[doc] + self.size[own] - shared)
        near = like >= self.threshold - 1e-9
        doc, own, like = doc[near], own[near], like[near]
        cuts = np.searchsorted(doc, np.arange(len(sets) + 1))
        return [(own[a:b], like[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def shared_prefix(self, labels: np.ndarray, own: int) -> int:
        """The longest prefix that some label has in common with the sample's document."""
        return int(np.cumprod(labels == self.labels[own], axis=1).sum(axis=1).max())


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, n: int, sample) -> DataFrame:
    """(id, tkey, class, labels, near, like): per row with a word the class of its shingle set, the MinHash values, and
    its true partners in the sample."""

    def sign(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw(batch.column("text")), n)
            rows = [i for i, own in enumerate(sets) if len(own)]
            sets = [sets[i] for i in rows]
            partners = sample.value.partners(sets)
            own = batch.select(["id", "tkey"]).take(pa.array(rows, pa.int64()))
            found = [pa.array([_name(x) for x in sets], pa.binary()), pa.array([minhash(x).tobytes() for x in sets], pa.binary()),
                     pa.array([p for p, _ in partners], pa.list_(pa.int32())), pa.array([s for _, s in partners], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *found], ["id", "tkey", "class", "labels", "near", "like"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, tkey binary, class binary, labels binary, near array<int>, like array<double>")


def measured_prefixes(signed: DataFrame, sample) -> dict[tuple[int, float], int]:
    """{(longest shared prefix, similarity in thousandths): true pairs} of the sample's documents with other classes."""

    def compare(batches):
        for batch in batches:
            rows = []
            for name, labels, near, like in zip(*(batch.column(c).to_pylist() for c in ("class", "labels", "near", "like"))):
                table = np.frombuffer(labels, np.uint16).reshape(TREES, DEPTH)
                rows += [(sample.value.shared_prefix(table, i), round(s, 3)) for i, s in zip(near, like) if sample.value.names[i] != name]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.float64()))], ["prefix", "s"])

    once = signed.filter("size(near) > 0").select("class", "labels", "near", "like").dropDuplicates(["class"])
    found = once.mapInArrow(compare, "prefix int, s double").groupBy("prefix", "s").agg(F.count("*").alias("n")).collect()
    return {(r.prefix, r.s): r.n for r in found}  # at most 9 x 201


def chosen_depth(pairs: dict[tuple[int, float], int], threshold: float, recall: float) -> int:
    """The longest prefix with enough recall, both as measured and as expected at the measured similarities."""
    total = sum(pairs.values())
    if not total:
        return forest_depth(threshold, recall)
    depth = forest_depth(threshold, min(recall, WORST))
    while depth > 1:
        met = sum(n for (prefix, _), n in pairs.items() if prefix >= depth) / total
        expected = sum(n * (1 - (1 - min(1.0, s) ** depth) ** TREES) for (_, s), n in pairs.items()) / total
        if met >= recall and expected >= recall:
            break
        depth -= 1
    return depth


def _may_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of b agree with the single row a in enough bytes for a similarity of the threshold."""
    k = a.shape[-1]
    least = threshold - MARGIN * (threshold * (1 - threshold) / k) ** 0.5
    return (a == b).sum(axis=1) >= least * k


def _forest(near, n: int) -> list[tuple[int, int]]:
    """Spanning forest of the graph given by ``near(i, candidates) -> mask``; reached ones are not asked again."""
    left, edges = np.arange(n), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            edges.extend((int(i), int(j)) for j in left[hit])
            stack.extend(left[hit].tolist())
            left = left[~hit]
    return edges


def _tiles(members: DataFrame, group: str, key: str) -> DataFrame:
    """``members`` with a ``tile`` column: all pairs inside a group meet in some tile, no tile has over 2 x TILE rows.

    Groups up to that size are one tile. Larger groups are cut into blocks by a hash of the key, rows are sent to one
    tile per pair of blocks; a row's copies grow with the group's size over TILE, as verifying all its pairs needs.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("__n")).filter("__n > 1")
    sized = members.join(sizes, group)
    blocks = F.expr(f"case when __n <= {2 * TILE} then 1 else cast(ceil(__n / {TILE / 2}) as int) end")
    block = F.expr("cast(pmod(xxhash64(__key), __blocks) as int)")
    pairs = F.expr("""case when __blocks = 1 then array(0L) else transform(sequence(0, __blocks - 1),
        o -> cast(least(__block, o) as bigint) * __blocks + greatest(__block, o)) end""")
    return (
        sized.withColumn("__blocks", blocks).withColumn("__key", F.col(key)).withColumn("__block", block)
        .withColumn("tile", F.explode(pairs)).drop("__n", "__key")
    )


def _candidates(classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(a, b): a spanning forest, per meeting place, of the classes that may be similar."""

    def spread(batches):
        for batch in slices(batches, "labels", 1 << 19):
            labels = np.stack([np.frombuffer(x, np.uint16) for x in batch.column("labels").to_pylist()]).reshape(batch.num_rows, TREES, DEPTH)
            mixed = np.zeros(labels.shape[:2], dtype=np.uint64)
            for d in range(depth):
                mixed = (mixed ^ labels[:, :, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(64) + np.arange(TREES, dtype=np.uint64)
            rows = np.repeat(np.arange(batch.num_rows), TREES)
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(rows)), pa.array(mixed.ravel().view(np.int64))], ["class", "prefix"])

    slots = classes.select("class", "labels").mapInArrow(spread, "class binary, prefix bigint")
    busy = slots.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select("prefix")
    met = materialise(slots.join(busy, "prefix"), "met")
    # what the estimate needs: the low byte of every MinHash value
    def coarse(batches):
        for batch in slices(batches, "labels", 1 << 20):
            low = [np.frombuffer(x, np.uint8)[::2].tobytes() for x in batch.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(low, pa.binary())], ["class", "coarse"])

    low = classes.join(met.select("class").distinct(), "class", "left_semi").select("class", "labels").mapInArrow(coarse, "class binary, coarse binary")
    tiled = _tiles(met, "prefix", "class").select("prefix", "tile", "class")
    # classes that share several prefixes with the same company need to be looked at once only
    company = tiled.groupBy("prefix", "tile").agg(F.expr("bit_xor(xxhash64(class))").alias("x"), F.sum(F.expr("cast(hash(class) as bigint)")).alias("y"), F.count("*").alias("n"))
    once = company.groupBy("x", "y", "n").agg(F.min(F.struct("prefix", "tile")).alias("one")).select("one.prefix", "one.tile")
    work = tiled.join(once, ["prefix", "tile"]).join(low, "class")

    def unite(batches):
        last, names, values = None, [], []

        def close():
            table = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
            near = lambda i, others: _may_reach(table[i], table[others], threshold)
            edges = _forest(near, len(names))
            return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, "coarse", 1 << 20):
            for p, t, c, v in zip(*(batch.column(x).to_pylist() for x in ("prefix", "tile", "class", "coarse"))):
                if (p, t) != last:
                    if len(names) > 1:
                        yield close()
                    last, names, values = (p, t), [], []
                names.append(c)
                values.append(v)
        if len(names) > 1:
            yield close()

    dealt = work.repartition("prefix", "tile").sortWithinPartitions("prefix", "tile", "class")
    return dealt.mapInArrow(unite, "a binary, b binary").distinct()


def _verify(groups: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Rows (class, links, a, b): for each class and tile the number of linked documents, or a link of the tile's
    spanning forest."""
    tiled = _tiles(groups, "component", "class").join(texts, "class")
    own = tiled.select("component", "tile", "class", "copies", "text", "__blocks", "__block")

    def check(batches):
        last, names, copies, sets, blocks, side = None, [], [], [], 1, []

        def close():
            ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
            size = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
            for start in range(0, len(ids), 4096):  # incidence matrix in strips of shingles
                part = (flat >= start) & (flat < start + 4096)
                rows, place = np.unique(owner[part], return_inverse=True)
                strip = np.zeros((len(rows), min(4096, len(ids) - start)), dtype=np.float32)
                strip[place, flat[part] - start] = 1
                shared[np.ix_(rows, rows)] += strip @ strip.T
            union = size[:, None] + size[None, :] - shared
            linked = shared.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9
            np.fill_diagonal(linked, False)
            if last[1] // blocks != last[1] % blocks:  # a tile of two blocks: pairs inside a block have their own tile
                s = np.array(side)
                linked &= s[:, None] != s[None, :]
            count = (linked * np.array(copies)[None, :]).sum(axis=1)
            edges = _forest(lambda i, others: linked[i, others], len(names))
            out = [(names[i], int(count[i]), None, None) for i in np.flatnonzero(count)]
            out += [(None, None, names[i], names[j]) for i, j in edges]
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["class", "links", "a", "b"])

        for batch in slices(batches, "text", 1 << 20):
            found = shingle_sets(raw(batch.column("text")), n)
            own = [batch.column(f).to_pylist() for f in ("component", "tile", "class", "copies", "__blocks", "__block")]
            for g, t, c, m, k, b, x in zip(*own, found):
                if (g, t) != last:
                    if len(names) > 1:
                        yield close()
                    last, names, copies, sets, side = (g, t), [], [], [], []
                names.append(c)
                copies.append(m)
                sets.append(x)
                side.append(b)
                blocks = k
        if len(names) > 1:
            yield close()

    dealt = own.repartition("component", "tile").sortWithinPartitions("component", "tile", "class")
    return dealt.mapInArrow(check, "class binary, links bigint, a binary, b binary")


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
                 recall: float = RECALL) -> DataFrame:
    """(key, copies_id, n_links, class_id), one row per row of ``df``.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least the threshold (words:
    parted by ASCII white space, unchanged; a shorter text is one shingle). ``copies_id``: the smallest key with the same
    shingle set. ``n_links``: other rows linked directly, copies included. ``class_id``: the smallest key reachable by
    links, the row's own included. Null, empty and blank texts have no shingles: no links, both ids are their own key.
    ``key`` should identify rows; rows that repeat a key are counted as further copies. An empty table gives no rows.
    Other columns of ``df`` are not read.
    """
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("tkey", text_key(F.col("text")))
    # about AUDIT documents by hash, whatever the size of the table; the limit is for keys that repeat
    share = min(1.0, 1.5 * AUDIT / max(1, docs.count()))
    chosen = F.xxhash64("id") <= F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1)
    asked = docs.filter(chosen & F.octet_length("text").between(1, AUDIT_BYTES)).limit(AUDIT)
    sample = df.sparkSession.sparkContext.broadcast(Sample([r.text.encode() for r in asked.select("text").collect()], words, threshold))
    signed = materialise(_signatures(docs.filter("text is not null"), words, sample), "signed")
    classes = signed.groupBy("class").agg(F.min("id").alias("copies_id"), F.count("*").alias("copies"), F.min("labels").alias("labels"),
                                         F.min_by("tkey", F.struct(F.col("id").isNull(), "id", "tkey")).alias("tkey"))
    classes = materialise(classes, "classes")
    depth = chosen_depth(measured_prefixes(signed, sample), threshold, recall)
    found = materialise(_candidates(classes, depth, threshold), "pairs")
    ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    groups = materialise(components(ends, found).withColumnRenamed("node", "class"), "groups")
    one = groups.join(classes.select("class", "copies_id", "copies", F.col("tkey").alias("its_key")), "class")
    # the text of one row per class of a group
    at = (F.col("tkey") == F.col("its_key")) & F.col("id").eqNullSafe(F.col("copies_id"))
    texts = docs.join(one.select("copies_id", "class", "its_key"), at).dropDuplicates(["class"]).select("class", "text")
    verified = materialise(_verify(one.select("component", "class", "copies"), texts, threshold, words), "verified")
    counts = verified.filter("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    nodes = classes.select(F.col("copies_id").alias("node")).distinct()
    named = verified.filter("a is not null").select("a", "b")
    named = named.join(classes.select(F.col("class").alias("a"), F.col("copies_id").alias("x")), "a").join(
        classes.select(F.col("class").alias("b"), F.col("copies_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(nodes, named)
    rows = classes.join(counts, "class", "left").join(joined, F.col("copies_id") == F.col("node"), "left").select(
        "class", "copies_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("class_id"))
    with_words = signed.select("id", "class").join(rows, "class").select(F.col("id").alias(key), "copies_id", "n_links", "class_id")
    none = docs.filter(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return with_words.union(none.select(F.col("id").alias(key), F.col("id").alias("copies_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("class_id")))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` with one row per group of near copies: the one with the smallest key. Rows that repeat a key stay together."""
    found = jaccard_join(df, key, text, **settings).select(F.col(key).alias(own := free_name(df, "__k")), "class_id").distinct()
    keep = found.filter(F.col(own).eqNullSafe(F.col("class_id"))).select(own)
    return df.join(keep, F.col(f"`{key}`").eqNullSafe(F.col(own)), "left_semi")


def digest(documents: DataFrame) -> DataFrame:
    """A row per document: its class, its links and its group."""
    return jaccard_join(documents.select("doc_id", "text"))


SQL = r"""
with recursive doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
gram as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i : i + 4], ' '))) end) as g from doc)),
size as (select doc_id, count(*) as n from gram group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y, c = sx.n and c = sy.n as same from pairs join size sx on x = sx.doc_id join size sy on y = sy.doc_id where c >= 0.8e0 * (sx.n + sy.n - c) - 1e-9),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, link.y from reach join link on reach.b = link.x)
select d.doc_id, least(d.doc_id, (select min(y) from link where x = d.doc_id and same)) as copies_id,
       (select count(*) from link where x = d.doc_id) as n_links, (select min(b) from reach where a = d.doc_id) as class_id
from documents d"""
