"""Fill-in-middle transformation by counted quantifiers, in DataFrame functions only.

A text is n units (white space and the word after it, or white space at the end). Two cut points a <= b are drawn from
the key. One regular expression per row, ``(unit{a})(unit{b-a})(rest)``, matches the whole text once, and the replacement
string of that match puts prefix, middle and suffix in their new order behind their sentinels. The quantifiers are
possessive: the matcher then walks the units in a loop, neither recursing per unit nor going back, so a text of
millions of words needs no deeper stack than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The unit and the three sentinels.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first digits of the SHA-256 of ``seed:key`` (null key: ``seed:``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _one_pattern(before: str, middle: str) -> Column:
    """The row's own pattern; ``before`` and ``middle`` name the columns with the two counts."""
    return F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col(before), F.lit(rf"}}+)((?:{UNIT}){{"), F.col(middle), F.lit(r"}+)(.*)\z"))


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``documents`` with the text replaced by ``output``, plus n long, form string, prefix_chars and middle_chars long.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of those as suffix-prefix-middle, the others as
    prefix-suffix-middle; both are drawn from the key. Form ``plain`` leaves the text as it is: texts that are not
    drawn, are empty, or hold a sentinel themselves, so that every output can be undone (`restore`). A null text is an
    empty one. Rows with equal keys are cut by the same draws; a null key is a key of its own. Repeated rows and rows
    with the same text are each transformed; there are no ties. Other columns stay; columns that are named like a new one
    (output, n, form, prefix_chars, middle_chars) are replaced, all other names can be used. An empty table gives no rows.

    Each row is worked on alone: no shuffle, and memory for one text and its units.
    """
    new = ("output", "n", "form", "prefix_chars", "middle_chars")
    kept = [c for c in documents.columns if c != text and c not in new]
    own = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(True)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.select(own.alias("own"), body.alias("body"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"))
    counted = rows.select("*", F.regexp_count("body", F.lit(UNIT)).cast("long").alias("n"))
    h = [F.col("h")[i] for i in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE) | (h[2] % 100 >= rate)
    cut = counted.select(
        "own", "body", "n", F.least(one, two).alias("before"), F.abs(one - two).alias("middle"),
        F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = F.when(F.col("form") == "plain", F.col("body")).otherwise(F.regexp_replace("body", _one_pattern("before", "middle"), order))
    done = cut.select("own", "n", "form", made.alias("output"))
    # no part holds a sentinel, so the places of the sentinels are the lengths of the parts
    at = {s: F.expr(f"locate('{s}', output)") for s in (PREFIX, SUFFIX, MIDDLE)}
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - 4).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - 3)
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] - 2)
    return done.select(
        *[F.col("own").getField(c).alias(c) for c in kept], "output", "n", "form",
        prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"))


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from, by one match of its form's layout; null if either is null."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``: the transformed text, and the text rebuilt from it, as digests."""
    done = fill_in_middle(documents.select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
         sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select doc_id, body, u, cast(len(u) as bigint) as n, cast(('0x' || substr(h, 1, 8)) as bigint) as h1, cast(('0x' || substr(h, 9, 8)) as bigint) as h2,
         cast(('0x' || substr(h, 17, 8)) as bigint) as h3, cast(('0x' || substr(h, 25, 8)) as bigint) as h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when n = 0 or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m,
         coalesce(array_to_string(u[b + 1:n], ''), '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then body when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
       sha256(body) as restored_sha256
from parts"""
