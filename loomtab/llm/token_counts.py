"""Token counts per field or section by offset-mapped attribution.

A document is encoded once as a whole. Byte-level ids spell their bytes exactly, so the running sum of their byte
lengths maps every token to its place in the text; an interval join of token spans with section spans (both sorted,
so two binary searches per section) gives each section its tokens. Rules for a token that crosses a boundary:

* ``first``: to the section that holds its first character;
* ``last``: to the section that holds its last character;
* ``split``: in proportion to its characters in each section (counts are then fractions).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ragged, raw, slices
from .tokens import Id, encoder, tokenizer_path

RULES = ("first", "last", "split")
_SIZES: dict[str, np.ndarray] = {}


def token_sizes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary spells: one per character of its entry."""
    if path not in _SIZES:
        vocabulary = encoder(path).tokenizer.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for word, i in vocabulary.items():
            sizes[i] = len(word)
        _SIZES[path] = sizes
    return _SIZES[path]


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``ends``: exclusive end of each token; ``cuts``: section bounds from 0 to the text's end."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if rule == "first":
        return np.diff(np.searchsorted(starts, cuts[:-1], "left"), append=len(ends)).astype(np.float64)
    if rule == "last":  # the last character of a token lies before the section's end
        return np.diff(np.searchsorted(ends, cuts[1:], "right"), prepend=0).astype(np.float64)
    whole = np.searchsorted(ends, cuts, "right")  # tokens ended at or before each cut
    inside = np.minimum(whole, max(len(ends) - 1, 0))
    part = np.where(whole < len(ends), (cuts - starts[inside]) / np.maximum(ends[inside] - starts[inside], 1), 0.0) if len(ends) else 0.0
    return np.diff(whole + np.clip(part, 0.0, 1.0))


def count_tokens(df: DataFrame, fields: list[str], separator: str = "\n", inside: bool = False,
                 rule: str = "first", path: str | None = None) -> DataFrame:
    """``df`` plus ``n_tokens`` long and ``sections`` array<struct<field string, section int, start long, length long, tokens double>>.

    The fields are joined by the separator (one character) into one document, which is encoded once. Each field, its
    closing separator included, is a section; with ``inside`` a field is also cut after every separator in it. Sections
    are numbered from 0 in their field. ``start`` and ``length`` count bytes of the document; sections cover it
    without gaps, so the tokens of a row's sections sum to ``n_tokens``. A null field counts as empty, an empty last
    field as an empty section. Rows are independent: repeated rows give repeated results, no rows give none. Result
    columns replace columns of the same name.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or tokenizer_path()
    if len(separator.encode()) != 1:
        raise ValueError("the separator must be one ASCII character")
    parts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    sizes: Column = F.array(*[F.octet_length(p).cast("long") for p in parts])
    kept = df.drop("n_tokens", "sections")
    source = df.withColumns({"__doc": F.concat_ws(separator, *parts), "__sizes": sizes}).drop("n_tokens", "sections")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    names, mark = np.array(fields, dtype=object), ord(separator)

    def count(batches):
        encode, size_of = encoder(path).encode, token_sizes(path)
        for batch in slices(batches, "__doc"):
            texts = raw(batch.column("__doc"))
            found = encode([t.decode() for t in texts])
            total, n, flat = [], [], ([], [], [], [], [])
            for t, ids, own in zip(texts, found, batch.column("__sizes").to_pylist()):
                ends = np.cumsum(size_of[np.frombuffer(ids, dtype=Id)])
                bounds = np.concatenate([[0], np.cumsum(np.array(own) + 1)])
                bounds[-1] = len(t)
                cuts = bounds
                if inside:  # an empty field still is a section: its bounds stay, however many fall together
                    spots = np.flatnonzero(np.frombuffer(t, np.uint8) == mark) + 1
                    cuts = np.sort(np.concatenate([bounds, np.setdiff1d(spots, bounds)]))
                field = np.searchsorted(bounds[1:], cuts[:-1], "right")
                field = np.minimum(field, len(names) - 1)
                first = np.searchsorted(field, field, "left")
                total.append(len(ends))
                n.append(len(cuts) - 1)
                flat[0].extend(names[field])
                flat[1].append(np.arange(len(field)) - first)
                flat[2].append(cuts[:-1])
                flat[3].append(np.diff(cuts))
                flat[4].append(attribute(ends, cuts, rule))
            joined = [np.concatenate(f) if f else np.zeros(0) for f in flat[1:]]
            types = (np.int32, np.int64, np.int64, np.float64)
            lists = [ragged(np.array(flat[0], dtype=object), np.array(n)), *[ragged(v.astype(k), np.array(n)) for v, k in zip(joined, types)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int64()), *lists],
                                             [*batch.schema.names, "n_tokens", "__f", "__s", "__b", "__l", "__t"])

    schema = f"{columns}, n_tokens bigint, __f array<string>, __s array<int>, __b array<bigint>, __l array<bigint>, __t array<double>"
    sections = F.arrays_zip(F.col("__f").alias("field"), F.col("__s").alias("section"), F.col("__b").alias("start"),
                            F.col("__l").alias("length"), F.col("__t").alias("tokens"))
    out = source.mapInArrow(count, schema)
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "n_tokens", sections.alias("sections"))


def digest(documents: DataFrame) -> DataFrame:
    """A row per document rendered as source, language and text on lines of their own: tokens of the whole, of each
    field, and of every line of the text. A token across a line end counts where it starts."""
    found = count_tokens(documents.select("doc_id", "source", "lang", "text"), ["source", "lang", "text"], inside=True)
    of = {f: F.expr(f"cast(aggregate(filter(sections, s -> s.field = '{f}'), 0D, (a, s) -> a + s.tokens) as bigint)") for f in ("source", "lang", "text")}
    lines = F.expr("transform(filter(sections, s -> s.field = 'text'), s -> cast(s.tokens as bigint))")
    return found.select("doc_id", "n_tokens", *[c.alias(f"{f}_tokens") for f, c in of.items()], lines.alias("line_tokens"))
