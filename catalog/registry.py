from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# The same text runs in both engines: tables with holes, copies, outliers or rare classes put in by rule.
VIEWS = {
    "customer_dirty": """
        select c_custkey, c_name, c_nationkey,
               case when c_custkey % 7 = 3 then null else c_acctbal end as c_acctbal,
               case when c_custkey % 11 = 5 then null else c_mktsegment end as c_mktsegment
        from customer
        union all
        select c_custkey, c_name, c_nationkey,
               case when c_custkey % 7 = 3 then null else c_acctbal end as c_acctbal,
               case when c_custkey % 11 = 5 then null else c_mktsegment end as c_mktsegment
        from customer where c_custkey % 50 = 0""",
    "customer_outlier": """
        select c_custkey, c_nationkey, c_mktsegment,
               case when c_custkey % 97 = 0 then c_acctbal * 20 else c_acctbal end as c_acctbal,
               case when c_custkey % 7 = 3 then null when c_custkey % 97 = 5 then c_acctbal * 20 else c_acctbal end as balance_gaps
        from customer""",
    "customer_mess": """
        select c_custkey, c_nationkey, case when c_custkey % 11 = 5 then null else c_mktsegment end as c_mktsegment,
               case when c_custkey % 7 = 3 then null when c_custkey % 97 = 0 then c_acctbal * 20 else c_acctbal end as c_acctbal
        from customer
        union all
        select c_custkey, c_nationkey, case when c_custkey % 11 = 5 then null else c_mktsegment end as c_mktsegment,
               case when c_custkey % 7 = 3 then null when c_custkey % 97 = 0 then c_acctbal * 20 else c_acctbal end as c_acctbal
        from customer where c_custkey % 50 = 0""",
    "rule_models": """
        select 'discount' as model, case when l_linestatus = 'O' then 1 else 0 end as label, case when l_discount > 0.05 then 1 else 0 end as prediction from lineitem
        union all select 'price', case when l_linestatus = 'O' then 1 else 0 end, case when l_extendedprice > 50000 then 1 else 0 end from lineitem
        union all select 'quantity', case when l_linestatus = 'O' then 1 else 0 end, case when l_quantity > 25 then 1 else 0 end from lineitem
        union all select 'status', case when l_linestatus = 'O' then 1 else 0 end, case when l_linestatus = 'O' then 1 else 0 end from lineitem
        union all select 'constant', case when l_linestatus = 'O' then 1 else 0 end, 1 from lineitem""",
    "rule_regressors": """
        select 'cost' as model, p_retailprice as label, 900.0e0 + p_partkey / 10.0e0 as prediction from part
        union all select 'middle', p_retailprice, 950.0e0 from part
        union all select 'size', p_retailprice, 900.0e0 + p_size from part""",
    "orders_left": """
        select o_orderkey, case when o_orderkey % 13 = 0 then null else o_custkey end as o_custkey, o_totalprice
        from orders""",
    "customer_right": """
        select case when c_custkey % 500 = 1 then null else c_custkey end as o_custkey, c_acctbal, c_nationkey
        from customer where c_custkey % 3 <> 0""",
    "union_a": "select c_custkey, c_name, c_nationkey, c_mktsegment from customer",
    "union_b": "select c_custkey, c_name, c_acctbal, c_mktsegment from customer",
    "orders_binary": """
        select o_orderkey, o_totalprice, o_custkey, o_orderpriority,
               case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 1 else 0 end as label
        from orders""",
    "orders_rare": """
        select o_orderkey, o_totalprice, case when o_orderkey = 0 then 'X' else o_orderstatus end as status
        from orders""",
    "pred_rule": """
        select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 1 else 0 end as label,
               case when l_quantity > 25 then 1 else 0 end as prediction, l_quantity as score
        from lineitem""",
    "flag_scores": """
        select l_orderkey, l_linenumber, l_returnflag as label,
               case when l_quantity > 34 then 'A' when l_quantity > 17 then 'N' else 'R' end as prediction,
               l_quantity / 50.0 as score_a, l_discount * 10.0 as score_n, 1.0 - l_quantity / 50.0 as score_r
        from lineitem""",
    "docs_labelled": """
        select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "const_col": "select c_custkey, c_acctbal, 2.0e0 as c, c_nationkey from customer",
}


ROWS_PER_TASK = 500_000


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """For operators with much work per row: the test tables are one row group each, so they are dealt to all cores, and
    to more tasks where a task would get more than ``ROWS_PER_TASK`` rows, so that no task's part grows with the table."""
    df = table(spark, sf, name)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK)))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for t in TABLES:
        if t in text:
            table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(text)


def over(names: str | list[str], sql: str) -> str:
    """Put the derived views in front of an oracle query."""
    names = [names] if isinstance(names, str) else names
    parts = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {parts}, {body[5:]}"
    return f"with {parts} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register
