"""Profiling reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import profile

from .registry import over, query, table, view, wide_table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY = [("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int64"), ("c_acctbal", "float64"), ("c_mktsegment", "object")]


def each(columns, text):
    """The same SELECT for every column, stacked."""
    return " union all ".join(text.replace("{c}", c) for c in columns)


@query("profile_overview", over("customer_dirty", """
    select count(*) as n_rows, 5 as n_columns, count(*) - (select count(*) from (select distinct * from customer_dirty)) as duplicates,
           cast(sum(case when c_acctbal is null then 1 else 0 end + case when c_mktsegment is null then 1 else 0 end) as bigint) as total_missing,
           round(sum(case when c_acctbal is null then 1 else 0 end + case when c_mktsegment is null then 1 else 0 end) * 100.0 / (count(*) * 5), 2) as missing_pct,
           3 as numeric_cols, 2 as categorical_cols from customer_dirty"""))
def profile_overview(spark, sf):
    return profile.overview(view(spark, sf, "customer_dirty"))


@query("profile_duplicates", over("customer_dirty", """
    select count(*) as n_rows, count(*) - (select count(*) from (select distinct * from customer_dirty)) as duplicates from customer_dirty"""))
def profile_duplicates(spark, sf):
    return profile.duplicate_rows(view(spark, sf, "customer_dirty"))


@query("profile_columns", over("customer_dirty", " union all ".join(
    f"""select '{c}' as "column", '{t}' as dtype, '{'categorical' if t == 'object' else 'numeric'}' as kind,
        count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct,
        count(distinct {c}) as n_distinct, round(count(distinct {c}) * 100.0 / count(*), 2) as distinct_pct from customer_dirty""" for c, t in DIRTY)))
def profile_columns(spark, sf):
    return profile.column_summary(view(spark, sf, "customer_dirty"))


@query("profile_numeric", each(LINE, """
    select '{c}' as "column", round(min({c})::double, 4) as min, round(max({c})::double, 4) as max, round(avg({c}), 4) as mean,
           round(quantile_cont({c}::double, 0.5), 4) as median, round(stddev_samp({c}), 4) as std, round(skewness({c}), 4) as skewness,
           round(kurtosis({c}), 4) as kurtosis, count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives,
           count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers
    from lineitem, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from lineitem)"""))
def profile_numeric(spark, sf):
    return profile.numeric_summary(table(spark, sf, "lineitem"))


@query("profile_iqr_outliers", over("customer_outlier", each(["c_custkey", "c_nationkey", "c_acctbal", "balance_gaps"], """
    select '{c}' as "column", round(min(q1 - 1.5 * (q3 - q1)), 4) as lower_bound, round(min(q3 + 1.5 * (q3 - q1)), 4) as upper_bound,
           count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers
    from customer_outlier, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from customer_outlier)""")))
def profile_iqr_outliers(spark, sf):
    return profile.iqr_outliers(view(spark, sf, "customer_outlier"))


HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_histogram", each(HIST, """
    select '{c}' as "column", b.bin::int as bin, round(lo + b.bin * (hi - lo) / 10, 4) as left_edge, round(lo + (b.bin + 1) * (hi - lo) / 10, 4) as right_edge,
           count(h.bin) as n
    from (select min({c}) as lo, max({c}) as hi from lineitem) m cross join (select unnest(range(10)) as bin) b
    left join (select least(floor(({c} - lo2) * 10 / (hi2 - lo2)), 9) as bin from lineitem, (select min({c}) as lo2, max({c}) as hi2 from lineitem)) h
      on h.bin = b.bin group by b.bin, lo, hi"""))
def profile_histogram(spark, sf):
    return profile.histogram(wide_table(spark, sf, "lineitem"), HIST)


def _top_sql(src, columns, n):
    return " union all ".join(f"""
        select * from (select '{c}' as "column", row_number() over (order by count(*) desc, {c}::varchar)::int as rank, {c}::varchar as value, count(*) as n,
               round(count(*) * 100.0 / (select count({c}) from {src}), 2) as pct
        from {src} where {c} is not null group by {c} order by 2 limit {n})""" for c in columns)


@query("profile_top_values", _top_sql("lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"], 10))
def profile_top_values(spark, sf):
    return profile.top_values(wide_table(spark, sf, "lineitem"))


@query("profile_mode", over("customer_dirty", " union all ".join(
    f"""select * from (select '{c}' as "column", {c}::varchar as mode, count(*) as mode_count from customer_dirty
        where {c} is not null group by {c} order by count(*) desc, {c} limit 1)""" for c in ("c_name", "c_mktsegment"))))
def profile_mode(spark, sf):
    return profile.mode_summary(view(spark, sf, "customer_dirty"))


@query("profile_missing", over("docs_labelled", "select * from (" + each(["doc_id", "lang", "source", "n_chars", "quality", "toxic"], """
    select '{c}' as "column", count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct from docs_labelled""")
    + ") where missing > 0"))
def profile_missing(spark, sf):
    return profile.missing_report(view(spark, sf, "docs_labelled"))


@query("analyze_missing", over("customer_dirty", each([c for c, _ in DIRTY], """
    select '{c}' as "column", count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct from customer_dirty""")))
def analyze_missing(spark, sf):
    return profile.missing_summary(view(spark, sf, "customer_dirty"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("profile_corr_matrix", " union all ".join(
    f"select '{a}' as col1, '{b}' as col2, round(coalesce(corr({a}, {b}), 0), 4) as correlation from lineitem" for a in CORR for b in CORR))
def profile_corr_matrix(spark, sf):
    return profile.correlation_matrix(wide_table(spark, sf, "lineitem"), CORR)


@query("profile_corr_top", "select *, abs(correlation) as strength from (" + " union all ".join(
    f"select '{a}' as col1, '{b}' as col2, round(corr({a}, {b}), 4) as correlation from lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1:])
    + ") order by abs(correlation) desc, col1, col2 limit 15")
def profile_corr_top(spark, sf):
    return profile.top_correlations(wide_table(spark, sf, "lineitem"), LINE)


def _alert_sql():
    cols = [("doc_id", True), ("lang", False), ("source", False), ("n_chars", True), ("quality", True), ("toxic", True)]
    rules = ["""select case when pct > 70 then 'danger' else 'warning' end as level, 'missing' as category, name as "column",
                printf('%s: %.1f%% of the cells are empty', name, pct) as message from stats where pct > 30""",
             """select 'danger', 'constant', name, printf('%s: the same value in every row', name) from stats where d <= 1""",
             """select 'info', 'cardinality', name, printf('%s: %d different texts', name, d) from stats where not num and d > 50""",
             """select 'info', 'skewness', name, printf('%s: lopsided, skewness %.2f', name, sk) from stats where num and sk > 3""",
             """select 'warning', 'duplicates', null, printf('%d repeated rows, %.1f%% of all', n, n * 100.0 / t)
                from (select count(*) - (select count(*) from (select distinct * from docs_labelled)) as n, count(*) as t from docs_labelled) where n > 0"""]
    stats = " union all ".join(
        f"select '{c}' as name, {str(num).lower()} as num, (count(*) - count({c})) * 100.0 / count(*) as pct, count(distinct {c}) as d, "
        f"{f'abs(skewness({c}))' if num else 'null'} as sk from docs_labelled" for c, num in cols)
    return over("docs_labelled", f"with stats as ({stats}) " + " union all ".join(rules))


@query("profile_alerts", _alert_sql())
def profile_alerts(spark, sf):
    return profile.quality_alerts(view(spark, sf, "docs_labelled"))


@query("data_preview", over("customer_dirty", " union all ".join(
    f"""select '{c}' as "column", '{t}' as dtype, count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct,
        count(distinct {c}) as n_distinct,
        {'null::double' if t == 'object' else f'round(min({c})::double, 4)'} as min, {'null::double' if t == 'object' else f'round(max({c})::double, 4)'} as max,
        {'null::double' if t == 'object' else f'round(avg({c}), 4)'} as mean,
        {f'(select {c} from customer_dirty where {c} is not null group by {c} order by count(*) desc, {c} limit 1)' if t == 'object' else 'null'} as top
        from customer_dirty""" for c, t in DIRTY)))
def data_preview(spark, sf):
    return profile.table_preview(view(spark, sf, "customer_dirty"))


@query("dtype_summary", """
    select 'int64' as dtype, 4 as n_columns, (count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_linenumber))::bigint as filled_cells from lineitem
    union all select 'float64', 4, (count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax))::bigint from lineitem
    union all select 'object', 2, (count(l_returnflag) + count(l_linestatus))::bigint from lineitem
    union all select 'datetime64', 1, count(l_shipdate) from lineitem""")
def dtype_summary(spark, sf):
    return profile.dtype_summary(table(spark, sf, "lineitem"))


@query("class_distribution", over("orders_binary", """
    select label as class, count(*) as n, round(count(*) * 100.0 / (select count(*) from orders_binary), 2) as pct from orders_binary group by 1"""))
def class_distribution(spark, sf):
    return profile.class_distribution(view(spark, sf, "orders_binary"), "label")


@query("feature_ranges", each(HIST, """
    select '{c}' as "column", round(min({c}), 4) as min, round(max({c}), 4) as max, round(avg({c}), 4) as mean,
           round(quantile_cont({c}, 0.5), 4) as median from lineitem"""))
def feature_ranges(spark, sf):
    return profile.feature_ranges(table(spark, sf, "lineitem"), HIST)
