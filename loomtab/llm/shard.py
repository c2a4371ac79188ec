"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each stratum (source) are put in a seeded order, row number i of n gets the fractional rank
(i + 0.5) / n, all rows are sorted by it, and the sorted list is cut into shards whose sizes differ by one
at most. Any stretch of the list holds every source in proportion, so every shard has the corpus' mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtab.functions.columns import col
from loomtab.functions.ordering import row_index

from .common import free_name, numbered

_ST, _H, _I, _N, _F = "__stratum", "__order", "__rank", "__n", "__fraction"


def seeded_order(key: Column, seed: int) -> Column:
    """Hex digest that orders rows at random but the same way in every run and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))))


def interleave(df: DataFrame, shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 0,
               keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all if None) plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    The ``rows`` law: shard sizes differ by one at most. A null stratum is a stratum of its own; a null key
    sorts as one fixed key; rows with equal keys (repeated rows too) are each placed once, in the order of
    key and remaining ties as the layout has them. An empty table gives no rows. Columns called shard or slot
    are replaced; other names cannot clash, since columns are numbered on the way. Keep few columns here and use ``write_shards`` for whole rows: the
    kept columns go through two range shuffles.

    Ranks are positions in range partitions plus the counts of the partitions before, so a source with a third
    of all rows is spread over many tasks.
    """
    kept = [c for c in (keep or df.columns) if c not in ("shard", "slot")]
    there, back = numbered(kept)
    slim = df.select(*there, col(stratum).cast("string").alias(_ST), col(key).alias("__key"),
                     seeded_order(col(key), seed).alias(_H))
    ranked = row_index(slim, [_H, "__key"], within=[_ST], name=_I)
    sizes = ranked.groupBy(_ST).agg(F.count("*").alias(_N))
    total = sizes.agg(F.coalesce(F.sum(_N), F.lit(0))).first()[0]
    placed = ranked.join(sizes.withColumnRenamed(_ST, "__s"), F.col(_ST).eqNullSafe(F.col("__s")))
    placed = placed.withColumn(_F, (F.col(_I) + F.lit(0.5)) / F.col(_N))
    listed = row_index(placed, [_F, _ST, _H, "__key"], name="__at")
    # floor(at * shards / total) with whole numbers; the first position of shard s is ceil(s * total / shards)
    shard = F.expr(f"(__at * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(__shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        listed.withColumn("__shard", shard)
        .withColumn("slot", F.col("__at") - first)
        .select(*back, F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def write_shards(df: DataFrame, path: str, shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 0) -> None:
    """Whole rows as parquet, one folder per shard, each file in slot order.

    ``key`` must identify a row. Large shards take several files: rows are laid out by range of (shard, slot).
    """
    where = interleave(df, shards, stratum, key, seed, keep=[key]).withColumnRenamed(key, own := free_name(df, "__k"))
    whole = df.drop("shard", "slot").join(where, col(key).eqNullSafe(F.col(own))).drop(own)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(documents: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """The contract's columns for ``documents``."""
    slim = documents.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = interleave(slim, shards, "source", "doc_id", seed, keep=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 of a text in SQL: one step per byte over the 256-entry table made from the polynomial 0xEDB88320.
CRC_SQL = """
crc_step as (select 0 as k, list(n order by n) as tab from range(256) t(n)
  union all select k + 1, list_transform(tab, lambda x: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) from crc_step where k < 8),
crc_table as (select tab from crc_step where k = 8)"""

SQL = """
with recursive (CRC)
, ranked as (
  select doc_id, source, text, hex(encode(coalesce(text, ''))) as bytes, md5('0:' || coalesce(cast(doc_id as varchar), '-')) as h,
         row_number() over (partition by source order by md5('0:' || coalesce(cast(doc_id as varchar), '-')), doc_id) - 1 as i,
         count(*) over (partition by source) as n
  from documents),
listed as (
  select *, row_number() over (order by (i + 0.5e0) / n, source nulls first, h, doc_id) - 1 as place, count(*) over () as total from ranked)
select doc_id, cast(coalesce(strlen(text), 0) + 8 as bigint) as size,
       cast(xor(list_reduce(
         list_prepend(cast(4294967295 as bigint), list_transform(range(1, strlen(coalesce(text, '')) + 1), lambda j:
           cast(('0x' || substr(bytes, cast(2 * j - 1 as bigint), 2)) as bigint))),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) as bigint) as text_crc32,
       'rows' as law, cast((place * 24) // total as integer) as shard,
       cast(place - (((place * 24) // total) * total + 23) // 24 as bigint) as slot, cast(null as integer) as grown_shard
from listed, crc_table""".replace("(CRC)", CRC_SQL)
