"""Putting several tables together: stacking, key joins, position joins and role routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.ordering import row_index

JOIN_KINDS = ("inner", "left", "right", "outer")
ROLES = ("train", "test", "supplement", "ignore")


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns meet by name and absent ones are missing."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _prepared(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    clash = (set(left.columns) & set(right.columns)) - {on}
    l_out = left.select(*[col(c).alias(f"{c}_x" if c in clash else c) for c in left.columns])
    r_out = right.select(
        *[col(c).alias("__key" if c == on else f"{c}_y" if c in clash else c) for c in right.columns]
    )
    return l_out, r_out


def join_on(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Key join in which missing keys match each other; clashing names get ``_x`` / ``_y``.

    The size of the sides picks broadcast or sort-merge, and a hot key is split at run time. The runtime
    split does not exist for full outer joins, so that one is a left join plus the unmatched right rows. Rows without a key
    are paired apart, as a product of both sides that is dealt to all tasks: as one key they would all be in one.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind: {how}")
    l_out, r_out = _prepared(left, right, on)
    key = "__key" if how == "right" else on
    names = [c for c in l_out.columns if c != on] + [c for c in r_out.columns if c != "__key"]
    wanted = [col(key).alias(on), *[col(c) for c in names]]
    l_keyed, r_keyed = l_out.filter(col(on).isNotNull()), r_out.filter(F.col("__key").isNotNull())
    match = col(on) == F.col("__key")
    out = l_keyed.join(r_keyed, match, "left" if how == "outer" else how).select(*wanted)
    if how == "outer":
        alone = r_keyed.join(l_keyed.select(col(on)).distinct(), match, "left_anti")
        out = out.unionByName(alone.withColumnRenamed("__key", on), allowMissingColumns=True)
    l_bare, r_bare = l_out.filter(col(on).isNull()), r_out.filter(F.col("__key").isNull())
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism
    out = out.unionByName(l_bare.repartition(parts).crossJoin(r_bare).select(*wanted))
    if how in ("left", "outer"):
        out = out.unionByName(l_bare.join(r_bare.select(F.lit(1)).limit(1), F.lit(True), "left_anti"), allowMissingColumns=True)
    if how in ("right", "outer"):
        alone = r_bare.join(l_bare.select(F.lit(1)).limit(1), F.lit(True), "left_anti")
        out = out.unionByName(alone.withColumnRenamed("__key", on), allowMissingColumns=True)
    return out


def join_chain(tables: Sequence[DataFrame], on: str, how: str = "inner") -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = join_on(out, t, on, how)
    return out


def merge_tables(tables: Sequence[DataFrame], method: str = "concat", on: str | None = None, how: str = "inner") -> DataFrame:
    if len(tables) < 2:
        raise ValueError("need at least two tables to merge")
    if method == "concat":
        return stack(tables)
    if method in ("join", "merge"):
        if not on:
            raise ValueError("a key column is needed to join tables")
        return join_chain(tables, on, how)
    raise ValueError(f"unknown merge method: {method}")


def zip_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Row i of one table beside row i of the other; both need an order and the same length."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"cannot place {b} rows beside {a}")
    clash = set(left.columns) & set(right.columns)
    r_named = right.select(*[col(c).alias(f"{c}_y" if c in clash else c) for c in right.columns])
    r_order = [f"{c}_y" if c in clash else c for c in right_order]
    l_indexed = row_index(left, left_order, name="__pos")
    r_indexed = row_index(r_named, r_order, name="__pos")
    return l_indexed.join(r_indexed, "__pos").drop("__pos")


def suggest_role(file_name: str) -> str:
    name = file_name.lower()
    if "test" in name:
        return "test"
    if any(word in name for word in ("rul", "meta", "label")):
        return "supplement"
    return "train"


@dataclass
class ConfiguredTables:
    train: DataFrame
    test: DataFrame | None


def route_by_role(roles: Mapping[str, str]) -> dict[str, list[str]]:
    routed: dict[str, list[str]] = {r: [] for r in ROLES}
    for name, role in roles.items():
        routed[role if role in ROLES else "ignore"].append(name)
    if not routed["train"]:
        raise ValueError("at least one table must have the train role")
    return routed


def add_supplement(
    base: DataFrame, extra: DataFrame, on: str | None, how: str = "inner",
    order: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """Join on the key if both sides have it, else place the columns side by side in a given order."""
    if on and on in base.columns and on in extra.columns:
        return join_on(base, extra, on, how)
    if order is None:
        raise ValueError("the key is not on both sides: give an order for both tables to place them side by side")
    return zip_columns(base, extra, *order)


def configure_tables(
    tables: Mapping[str, DataFrame],
    roles: Mapping[str, str],
    on: str | None = None,
    how: str = "inner",
    exclude: Sequence[str] = (),
    order: tuple[Sequence[str], Sequence[str]] | None = None,
) -> ConfiguredTables:
    """Stack the tables of each role, add the supplements to both and drop the excluded columns."""
    if not tables:
        raise ValueError("no tables loaded")
    routed = route_by_role({n: roles.get(n, "ignore") for n in tables})

    def assemble(names: list[str]) -> DataFrame:
        out = stack([tables[n] for n in names])
        for extra in routed["supplement"]:
            out = add_supplement(out, tables[extra], on, how, order)
        return out.drop(*exclude)

    test = assemble(routed["test"]) if routed["test"] else None
    return ConfiguredTables(assemble(routed["train"]), test)


def shared_columns(train: DataFrame, test: DataFrame) -> DataFrame:
    """The test table restricted to the columns it shares with train, in train order."""
    have = set(test.columns)
    return test.select(*[col(c) for c in train.columns if c in have])
