"""Sources, sinks, schema operators and combining tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.functions.columns import col, nan_to_null, numeric_columns
from loomtab.functions.quantiles import medians
from loomtab.functions.staging import new_path
from loomtab.operators import combine, roles
from loomtab.sources.history import RunHistory
from loomtab.sources.tables import StepCheckpoints, load_table, load_tables, preview_rows, table_overview

from .registry import over, query, table, view

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("src_load_table", "select count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderpriority) as first_priority from orders")
def src_load_table(spark, sf):
    df = load_table(spark, f"{sf}/orders.parquet")
    return df.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderpriority").alias("first_priority"))


@query("src_nan_to_null", """
    select count(*) as n, count(case when l_quantity > 45 then null else l_tax end) as filled,
           round(avg(case when l_quantity > 45 then null else l_tax end), 6) as mean_tax from lineitem""")
def src_nan_to_null(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    df = nan_to_null(raw)
    return df.agg(F.count("*").alias("n"), F.count("l_tax").alias("filled"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query("src_multi_preview", """
    select 'customer.parquet' as name, count(*) as n_rows, 5 as n_columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as columns from customer
    union all select 'nation.parquet', count(*), 3, 'n_nationkey,n_name,n_regionkey' from nation
    union all select 'orders.parquet', count(*), 6, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' from orders""")
def src_multi_preview(spark, sf):
    return table_overview(load_tables(spark, [f"{sf}/{t}.parquet" for t in ("customer", "nation", "orders")]))


@query("sink_checkpoint_roundtrip", """
    select 'cleaning' as step, count(*) as n_rows, 5 as n_columns, round(sum(c_acctbal), 2) as total from customer""")
def sink_checkpoint_roundtrip(spark, sf):
    steps = StepCheckpoints(spark, new_path(spark, "steps"))
    saved = steps.save("cleaning", table(spark, sf, "customer"))
    total = saved.agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return steps.log().select("step", "n_rows", "n_columns").join(total.withColumn("step", F.lit("cleaning")), "step")


RUN_ROWS = """
    select lpad(cast(o_orderkey as varchar(20)), 10, '0') as id, cast(o_orderdate as varchar(30)) as timestamp,
           o_orderpriority as dataset_name,
           case when o_orderkey % 3 = 1 then 'regression' else 'classification' end as task_type, 'target' as target_col,
           o_orderstatus as best_model, '{}' as config_json,
           case when o_orderkey % 3 = 0 then concat('{"f1": 0.', cast(o_orderkey % 900 + 100 as varchar(20)), '}')
                when o_orderkey % 3 = 1 then concat('{"r2": 0.', cast(o_orderkey % 900 + 100 as varchar(20)), '}')
                else concat('{"accuracy": 0.', cast(o_orderkey % 900 + 100 as varchar(20)), '}') end as metrics_json,
           o_custkey as n_rows, 5 as n_features, 2 as n_models_trained, 1.5e0 as duration_seconds, false as auto_explore
    from orders"""


def _history(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    runs = RunHistory(spark, new_path(spark, "runs"))
    runs.append(spark.sql(RUN_ROWS))
    return runs


@query("runs_append", f"""
    with runs as ({RUN_ROWS})
    select task_type, best_model, count(*) as n_runs, cast(sum(n_rows) as bigint) as n_rows, min(id) as first_id from runs group by 1, 2""")
def runs_append(spark, sf):
    return _history(spark, sf).all().groupBy("task_type", "best_model").agg(
        F.count("*").alias("n_runs"), F.sum("n_rows").alias("n_rows"), F.min("id").alias("first_id"))


@query("runs_recent", f"""
    with runs as ({RUN_ROWS})
    select id, timestamp, task_type, best_model,
           coalesce(cast(json_extract_string(metrics_json, '$.f1') as double), cast(json_extract_string(metrics_json, '$.r2') as double),
                    cast(json_extract_string(metrics_json, '$.accuracy') as double)) as score
    from runs order by timestamp desc, id limit 50""")
def runs_recent(spark, sf):
    return _history(spark, sf).recent(50).select("id", "timestamp", "task_type", "best_model", "score")


@query("runs_delete", f"""
    with runs as ({RUN_ROWS})
    select best_model, count(*) as n_runs from runs where id <> '0000000003' group by 1""")
def runs_delete(spark, sf):
    runs = _history(spark, sf)
    runs.delete("0000000003")
    return runs.all().groupBy("best_model").agg(F.count("*").alias("n_runs"))


@query("runs_clear", f"with runs as ({RUN_ROWS}) select count(*) as removed, cast(0 as bigint) as n_left from runs")
def runs_clear(spark, sf):
    runs = _history(spark, sf)
    removed = runs.clear()
    return runs.all().agg(F.count("*").alias("n_left")).withColumn("removed", F.lit(removed).cast("long"))


@query("src_load_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def src_load_csv(spark, sf):
    """The table written as CSV with a header and read back with inferred types."""
    path = new_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return load_table(spark, path)


@query("preview_head", """
    select c_custkey, concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_nationkey":', c_nationkey,
           ',"c_mktsegment":"', c_mktsegment, '"}') as record
    from customer order by c_custkey limit 100""")
def preview_head(spark, sf):
    return preview_rows(table(spark, sf, "customer").drop("c_acctbal"), ["c_custkey"], 100)


# schema operators -----------------------------------------------------------------------------------
@query("proj_exclude", "select c_custkey, c_nationkey, c_mktsegment from customer")
def proj_exclude(spark, sf):
    base = table(spark, sf, "customer")
    return combine.configure_tables({"c": base}, {"c": "train"}, exclude=["c_name", "c_acctbal", "not_there"]).train


@query("proj_numeric", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def proj_numeric(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*numeric_columns(df))


@query("column_list", " union all ".join(
    f"select '{c}' as name, '{t}' as dtype, count(distinct {c}) as n_distinct, {str(t != 'object').lower()} as is_numeric from part"
    for c, t in (("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"), ("p_size", "int64"), ("p_retailprice", "float64"))))
def column_list(spark, sf):
    from loomtab.operators.profile import column_summary
    return column_summary(table(spark, sf, "part")).select(
        F.col("column").alias("name"), "dtype", "n_distinct", (F.col("kind") == "numeric").alias("is_numeric"))


def _task_sql(table_name, columns):
    parts = []
    for c, kind in columns:
        n = f"count(distinct {c})"
        task = {"text": "'classification'", "int": f"case when {n} <= 20 then 'classification' else 'regression' end"}.get(kind, "'regression'")
        parts.append(f"select '{c}' as \"column\", {n} as n_distinct, {task} as task from {table_name}")
    return " union all ".join(parts)


@query("detect_task", _task_sql("lineitem", [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "real"),
    ("l_extendedprice", "real"), ("l_discount", "real"), ("l_tax", "real"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "real")]))
def detect_task(spark, sf):
    return roles.task_per_column(table(spark, sf, "lineitem"))


@query("proj_common", "select c_custkey, c_name, c_mktsegment from customer")
def proj_common(spark, sf):
    return combine.shared_columns(view(spark, sf, "union_a"), view(spark, sf, "union_b"))


@query("label_prepare", """
    select o_orderkey, o_totalprice, cast((select count(distinct o2.o_orderstatus) from orders o2 where o2.o_orderstatus < o.o_orderstatus) as double) as label
    from orders o""")
def label_prepare(spark, sf):
    df, _ = roles.prepare_label(table(spark, sf, "orders"), "o_orderstatus", "classification")
    return df.select("o_orderkey", "o_totalprice", "label")


@query("detect_datetime", "select 'ts' as found, count(*) as n_rows, count(try_cast(cast(ts as varchar) as timestamp)) as n_parsed from events")
def detect_datetime(spark, sf):
    df = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string")).select("event_id", "event_type", "ts", "value")
    found = roles.find_datetime_column(df)
    return df.agg(F.count("*").alias("n_rows"), F.count(F.try_to_timestamp(col(found))).alias("n_parsed")).select(F.lit(found).alias("found"), "n_rows", "n_parsed")


@query("route_roles", """
    select 'train' as role, 'customer,orders' as tables, (select count(*) from customer) + (select count(*) from orders) as n_rows
    union all select 'supplement', 'labels', (select count(*) from labels)
    union all select 'test', 'test_part', (select count(*) from part)""")
def route_roles(spark, sf):
    names = {"customer": "customer", "orders": "orders", "labels": "labels", "test_part": "part"}
    tables = {n: table(spark, sf, t) for n, t in names.items()}
    routed = combine.route_by_role({n: combine.suggest_role(n) for n in tables})
    counts = table_overview(tables).select("name", "n_rows")
    role = F.coalesce(*[F.when(F.col("name").isin(members), F.lit(r)) for r, members in routed.items() if members])
    return counts.withColumn("role", role).groupBy("role").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("tables"), F.sum("n_rows").alias("n_rows"))


@query("fill_median_final", over("customer_dirty", """
    select c_custkey, c_nationkey, coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from customer_dirty)) as c_acctbal from customer_dirty"""))
def fill_median_final(spark, sf):
    df = view(spark, sf, "customer_dirty").select("c_custkey", "c_nationkey", "c_acctbal")
    mid = medians(df, ["c_acctbal"])["c_acctbal"]
    return df.withColumn("c_acctbal", F.coalesce("c_acctbal", F.lit(mid)))


# combining ------------------------------------------------------------------------------------------
@query("union_by_name", over(["union_a", "union_b"], """
    select c_custkey, c_name, c_nationkey, c_mktsegment, null::double as c_acctbal from union_a
    union all select c_custkey, c_name, null, c_mktsegment, c_acctbal from union_b"""))
def union_by_name(spark, sf):
    return combine.merge_tables([view(spark, sf, "union_a"), view(spark, sf, "union_b")], "concat")


def _join_sql(kind):
    return over(["orders_left", "customer_right"], f"""
        select coalesce(l.o_custkey, r.o_custkey) as o_custkey, l.o_orderkey, l.o_totalprice, r.c_acctbal, r.c_nationkey
        from orders_left l {kind} join customer_right r on l.o_custkey is not distinct from r.o_custkey""")


def _join(how):
    def run(spark, sf):
        return combine.merge_tables([view(spark, sf, "orders_left"), view(spark, sf, "customer_right")], "join", "o_custkey", how)
    return run


for _how, _kind in (("inner", "inner"), ("left", "left"), ("right", "right"), ("outer", "full outer")):
    query(f"join_{_how}", _join_sql(_kind))(_join(_how))


@query("join_supplement", """
    select s.s_suppkey, s.s_name, s.s_nationkey, s.s_acctbal, n.n_name, n.n_regionkey
    from supplier s join (select n_nationkey as s_nationkey, n_name, n_regionkey from nation) n on s.s_nationkey = n.s_nationkey""")
def join_supplement(spark, sf):
    tables = {"suppliers": table(spark, sf, "supplier"), "nation_meta": table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")}
    return combine.configure_tables(tables, {n: combine.suggest_role(n) for n in tables}, on="s_nationkey").train


@query("zip_join", """
    with a as (select *, row_number() over (order by o_totalprice, o_orderkey) as rn from orders),
         b as (select o_orderkey as key_y, o_orderdate as date_y, row_number() over (order by o_orderdate, o_orderkey) as rn from orders)
    select o_orderkey, o_totalprice, key_y, cast(date_y as varchar) as date_y from a join b using (rn)""")
def zip_join(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key_y"), F.col("o_orderdate").alias("date_y"))
    out = combine.zip_columns(left, right, ["o_totalprice", "o_orderkey"], ["date_y", "key_y"])
    return out.withColumn("date_y", F.col("date_y").cast("string"))


@query("configure_tables", """
    with stacked as (select s_suppkey as k, s_nationkey, s_acctbal from supplier union all select c_custkey, c_nationkey, c_acctbal from customer)
    select k, s_nationkey, s_acctbal, n_regionkey from stacked join nation on s_nationkey = n_nationkey""")
def configure_tables(spark, sf):
    tables = {
        "suppliers": table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "k"),
        "customers": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal")),
        "nation_meta": table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"),
    }
    done = combine.configure_tables(tables, {n: combine.suggest_role(n) for n in tables}, on="s_nationkey", exclude=["s_name", "n_name"])
    return done.train
