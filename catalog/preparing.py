"""Cleaning, encoding, scaling, feature building and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import clean, features, select, transform
from loomtab.operators.rules import facts_table

from .registry import over, query, table, view, wide_table

DIRTY = "customer_dirty"
FENCE = "(select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from {t})"


def fence(c, t):
    return FENCE.replace("{c}", c).replace("{t}", t)


MODE_SEGMENT = "(select c_mktsegment from customer_dirty where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1)"


def _impute_sql(value, segment="c_mktsegment"):
    return over(DIRTY, f"select c_custkey, c_nationkey, round(coalesce(c_acctbal, {value}), 6) as c_acctbal, {segment} as c_mktsegment from customer_dirty")


def _imputed(df):
    return df.select("c_custkey", "c_nationkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


@query("impute_mean", _impute_sql("(select avg(c_acctbal) from customer_dirty)"))
def impute_mean(spark, sf):
    return _imputed(clean.impute(view(spark, sf, DIRTY), "mean", ["c_acctbal"]))


@query("impute_median", _impute_sql("(select quantile_cont(c_acctbal, 0.5) from customer_dirty)"))
def impute_median(spark, sf):
    return _imputed(clean.impute(view(spark, sf, DIRTY), "median", ["c_acctbal"]))


@query("impute_mode", _impute_sql("(select c_acctbal from customer_dirty where c_acctbal is not null group by 1 order by count(*) desc, 1 limit 1)", f"coalesce(c_mktsegment, {MODE_SEGMENT})"))
def impute_mode(spark, sf):
    return _imputed(clean.impute(view(spark, sf, DIRTY), "mode"))


@query("impute_auto", _impute_sql("(select avg(c_acctbal) from customer_dirty)", f"coalesce(c_mktsegment, {MODE_SEGMENT})"))
def impute_auto(spark, sf):
    return _imputed(clean.impute(view(spark, sf, DIRTY), "auto"))


@query("drop_missing", over(DIRTY, "select * from customer_dirty where c_acctbal is not null and c_mktsegment is not null"))
def drop_missing(spark, sf):
    return clean.impute(view(spark, sf, DIRTY), "drop", ["c_acctbal", "c_mktsegment"])


@query("impute_report", over(DIRTY, f"""
    select 'c_acctbal' as "column", 'mean' as strategy, count(*) - count(c_acctbal) as n_filled, printf('%.4f', avg(c_acctbal)) as fill_value from customer_dirty
    union all select 'c_mktsegment', 'mode', count(*) - count(c_mktsegment), {MODE_SEGMENT} from customer_dirty"""))
def impute_report(spark, sf):
    return clean.impute_report(view(spark, sf, DIRTY), "auto")


@query("dedup_all", over(DIRTY, "select distinct * from customer_dirty"))
def dedup_all(spark, sf):
    return clean.drop_duplicates(view(spark, sf, DIRTY))


def _dedup_sql(direction):
    return f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice from (
        select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate {direction}, o_orderkey {direction}) as rn from orders) where rn = 1"""


@query("dedup_keep_first", _dedup_sql("asc"))
def dedup_keep_first(spark, sf):
    out = clean.drop_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "first", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("dedup_keep_last", _dedup_sql("desc"))
def dedup_keep_last(spark, sf):
    out = clean.drop_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "last", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


OUT_COLUMNS = ["c_acctbal", "balance_gaps"]


@query("outlier_zscore", over("customer_outlier", " union all ".join(f"""
    select '{c}' as "column", count(*) filter (abs(({c} - m) / s) > 3) as outliers, round(min(m - 3 * s), 4) as lower_bound, round(min(m + 3 * s), 4) as upper_bound
    from customer_outlier, (select avg({c}) as m, stddev_pop({c}) as s from customer_outlier)""" for c in OUT_COLUMNS)))
def outlier_zscore(spark, sf):
    return clean.outlier_report(view(spark, sf, "customer_outlier"), "zscore", OUT_COLUMNS)


@query("outlier_iqr", over("customer_outlier", " union all ".join(f"""
    select '{c}' as "column", count(*) filter ({c} < lo or {c} > hi) as outliers, round(min(lo), 4) as lower_bound, round(min(hi), 4) as upper_bound
    from customer_outlier, {fence(c, 'customer_outlier')}""" for c in OUT_COLUMNS)))
def outlier_iqr(spark, sf):
    return clean.outlier_report(view(spark, sf, "customer_outlier"), "iqr", OUT_COLUMNS)


ZB = "(select avg({c}) - 3 * {f}({c}) as lo, avg({c}) + 3 * {f}({c}) as hi from customer_outlier)"


def _clip_sql(bounds):
    a, b = (bounds(c) for c in OUT_COLUMNS)
    return over("customer_outlier", f"""
        select c_custkey, round(least(greatest(c_acctbal, a.lo), a.hi), 6) as c_acctbal,
               case when balance_gaps is null then null else round(least(greatest(balance_gaps, b.lo), b.hi), 6) end as balance_gaps
        from customer_outlier, {a} a, {b} b""")


def _outlier_rows(df):
    return df.select("c_custkey", *[F.round(c, 6).alias(c) for c in OUT_COLUMNS])


@query("outlier_clip_iqr", _clip_sql(lambda c: fence(c, "customer_outlier")))
def outlier_clip_iqr(spark, sf):
    return _outlier_rows(clean.handle_outliers(view(spark, sf, "customer_outlier"), "iqr", "clip", OUT_COLUMNS))


@query("outlier_clip_zscore", _clip_sql(lambda c: ZB.replace("{c}", c).replace("{f}", "stddev_samp")))
def outlier_clip_zscore(spark, sf):
    return _outlier_rows(clean.handle_outliers(view(spark, sf, "customer_outlier"), "zscore", "clip", OUT_COLUMNS, compat=True))


@query("outlier_null", over("customer_outlier", f"""
    select c_custkey, case when c_acctbal between a.lo and a.hi then round(c_acctbal, 6) end as c_acctbal,
           case when balance_gaps between b.lo and b.hi then round(balance_gaps, 6) end as balance_gaps
    from customer_outlier, {fence('c_acctbal', 'customer_outlier')} a, {fence('balance_gaps', 'customer_outlier')} b"""))
def outlier_null(spark, sf):
    return _outlier_rows(clean.handle_outliers(view(spark, sf, "customer_outlier"), "iqr", "nan", OUT_COLUMNS))


@query("outlier_remove", over("customer_outlier", f"""
    select c_custkey, round(c_acctbal, 6) as c_acctbal, round(balance_gaps, 6) as balance_gaps
    from customer_outlier, {fence('c_acctbal', 'customer_outlier')} a, {fence('balance_gaps', 'customer_outlier')} b
    where c_acctbal between a.lo and a.hi and balance_gaps between b.lo and b.hi"""))
def outlier_remove(spark, sf):
    return _outlier_rows(clean.handle_outliers(view(spark, sf, "customer_outlier"), "iqr", "remove", OUT_COLUMNS))


def _z_limits(c):
    return f"(select avg({c}) - 3 * stddev_pop({c}) as lo, avg({c}) + 3 * stddev_pop({c}) as hi from customer_outlier)"


@query("outlier_remove_zscore", over("customer_outlier", f"""
    select c_custkey, round(c_acctbal, 6) as c_acctbal, round(balance_gaps, 6) as balance_gaps
    from customer_outlier, {_z_limits('c_acctbal')} a, {_z_limits('balance_gaps')} b
    where c_acctbal between a.lo and a.hi and balance_gaps between b.lo and b.hi"""))
def outlier_remove_zscore(spark, sf):
    return _outlier_rows(clean.handle_outliers(view(spark, sf, "customer_outlier"), "zscore", "remove", OUT_COLUMNS))


CLEANED = f"""
    d as (select distinct * from customer_mess),
    k as (select c_custkey, c_nationkey, c_mktsegment, case when c_acctbal is null then null else least(greatest(c_acctbal, lo), hi) end as c_acctbal
          from d, {fence('c_acctbal', 'd')})"""


@query("clean_default", over("customer_mess", f"""
    with {CLEANED}
    select c_custkey, c_nationkey, round(coalesce(c_acctbal, (select avg(c_acctbal) from k)), 6) as c_acctbal,
           coalesce(c_mktsegment, (select c_mktsegment from k where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1)) as c_mktsegment
    from k"""))
def clean_default(spark, sf):
    return _imputed(clean.clean(view(spark, sf, "customer_mess")))


@query("explain_facts", over("customer_mess", f"""
    with {CLEANED}
    select 'duplicates' as step, 'rows' as item, 'removed' as method, ((select count(*) from customer_mess) - (select count(*) from d))::double as value
    union all select 'outliers', 'c_acctbal', 'iqr/clip', (select count(*) from d, {fence('c_acctbal', 'd')} where c_acctbal < lo or c_acctbal > hi)::double
    union all select 'missing_values', 'c_acctbal', 'mean', (select count(*) - count(c_acctbal) from k)::double
    union all select 'missing_values', 'c_mktsegment', 'mode', (select count(*) - count(c_mktsegment) from k)::double
    union all select 'encoding', 'c_mktsegment', 'onehot', (select count(distinct c_mktsegment) from k)::double
    union all select 'scaling', n, 'standard', 1.0 from (select 'c_custkey' as n union all select 'c_nationkey' union all select 'c_acctbal'
        union all select distinct 'c_mktsegment_' || c_mktsegment from k where c_mktsegment > (select min(c_mktsegment) from k))"""))
def explain_facts(spark, sf):
    raw = view(spark, sf, "customer_mess")
    cleaned, plan = clean.fit_clean(raw)
    shaped = transform.fit_transform_plan(cleaned)
    removed = float(raw.count() - cleaned.count())
    return facts_table(spark, [("duplicates", "rows", "removed", removed), *plan.facts, *shaped.facts])


# encoding and scaling -------------------------------------------------------------------------------
@query("encode_label", over(DIRTY, """
    select c_custkey, d.code as c_mktsegment from customer_dirty c left join
      (select c_mktsegment, (row_number() over (order by c_mktsegment) - 1)::double as code from (select distinct c_mktsegment from customer_dirty where c_mktsegment is not null)) d
      on c.c_mktsegment = d.c_mktsegment"""))
def encode_label(spark, sf):
    return transform.label_encode(view(spark, sf, DIRTY), ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


# The categories of the given tables, in sorted order.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummies(c, values):
    return ", ".join(f"case when {c} = '{v}' then 1 else 0 end as \"{c}_{v}\"" for v in values[1:])


@query("encode_onehot", over(DIRTY, f"select c_custkey, c_name, c_nationkey, c_acctbal, {_dummies('c_mktsegment', SEGMENTS)} from customer_dirty"))
def encode_onehot(spark, sf):
    return transform.onehot_encode(view(spark, sf, DIRTY))


@query("encode_target", over(DIRTY, """
    select c_custkey, round(m, 6) as c_mktsegment from customer_dirty c left join
      (select c_mktsegment, avg(c_acctbal) as m from customer_dirty where c_mktsegment is not null group by 1) t on c.c_mktsegment = t.c_mktsegment"""))
def encode_target(spark, sf):
    out = transform.target_encode(view(spark, sf, DIRTY), "c_acctbal", ["c_mktsegment"])
    return out.select("c_custkey", F.round("c_mktsegment", 6).alias("c_mktsegment"))


@query("encode_auto", f"""
    select o_orderkey, {_dummies('o_orderstatus', STATUSES)}, {_dummies('o_orderpriority', PRIORITIES)}, b.code as brand
    from orders join (select p_partkey, code from part join
      (select p_brand, (row_number() over (order by p_brand) - 1)::double as code from (select distinct p_brand from part)) using (p_brand)) b
      on o_custkey = b.p_partkey""")
def encode_auto(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("o_custkey"), F.col("p_brand").alias("brand"))
    coded = transform.transform(part, {"encoding": "auto", "scaling": "none"})
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return transform.transform(orders, {"encoding": "auto", "scaling": "none"}).join(coded, "o_custkey").drop("o_custkey")


SCALED = ["c_acctbal", "c", "c_nationkey"]


def _scale_sql(shift, divisor):
    cols = ", ".join(f"round(({c} - (select {shift.replace('?', c)} from const_col)) / (select case when {divisor.replace('?', c)} = 0 then 1 else {divisor.replace('?', c)} end from const_col), 6) as {c}" for c in SCALED)
    return over("const_col", f"select c_custkey, {cols} from const_col")


def _scaled(method):
    def run(spark, sf):
        out = transform.scale(view(spark, sf, "const_col"), method, exclude=["c_custkey"])
        return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in SCALED])
    return run


query("scale_minmax", _scale_sql("min(?)", "(max(?) - min(?))"))(_scaled("minmax"))
query("scale_standard", _scale_sql("avg(?)", "stddev_pop(?)"))(_scaled("standard"))
query("scale_robust", _scale_sql("quantile_cont(?::double, 0.5)", "(quantile_cont(?::double, 0.75) - quantile_cont(?::double, 0.25))"))(_scaled("robust"))


@query("transform_log1p", over(DIRTY, "select c_name, round(ln(1 + c_custkey::double), 6) as c_custkey, round(ln(1 + c_nationkey::double), 6) as c_nationkey, c_acctbal from customer_dirty"))
def transform_log1p(spark, sf):
    out = transform.log_transform(view(spark, sf, DIRTY))
    return out.select("c_name", F.round("c_custkey", 6).alias("c_custkey"), F.round("c_nationkey", 6).alias("c_nationkey"), "c_acctbal")


@query("boxcox_fixed_lambda", "select l_orderkey, l_linenumber, round((pow(l_extendedprice, 0.3) - 1) / 0.3, 6) as l_extendedprice, round(ln(l_quantity), 6) as l_quantity from lineitem")
def boxcox_fixed_lambda(spark, sf):
    out = transform.apply_boxcox(table(spark, sf, "lineitem"), {"l_extendedprice": 0.3, "l_quantity": 0.0})
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("l_extendedprice"), F.round("l_quantity", 6).alias("l_quantity"))


@query("boxcox_fit")
def boxcox_fit(spark, sf):
    found = transform.fit_boxcox(wide_table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return spark.createDataFrame([(c, round(v, 4)) for c, v in found.items()], "column string, lambda double")


@query("transform_default", f"""
    with e as (select c_custkey, c_nationkey, c_acctbal, {_dummies('c_mktsegment', SEGMENTS)} from customer)
    select c_nationkey, """ + ", ".join(
    f"round((\"{c}\" - (select avg(\"{c}\") from e)) / (select stddev_pop(\"{c}\") from e), 6) as \"{c}\"" for c in ["c_custkey", "c_acctbal", *[f"c_mktsegment_{s}" for s in SEGMENTS[1:]]]) + " from e")
def transform_default(spark, sf):
    out = transform.transform(table(spark, sf, "customer").drop("c_name"), {}, target="c_nationkey")
    return out.select(*[F.col(c) if c == "c_nationkey" else F.round(f"`{c}`", 6).alias(c) for c in out.columns])


# features -------------------------------------------------------------------------------------------
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]
KEYS = "l_orderkey, l_linenumber"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)


@query("feat_polynomial", f"select {KEYS}, {', '.join(LINE)}, " + ", ".join(
    f'{a} * {b} as "{a + "^2" if a == b else a + "_" + b}"' for i, a in enumerate(LINE) for b in LINE[i:]) + " from lineitem")
def feat_polynomial(spark, sf):
    return features.add_polynomial(_lines(spark, sf), LINE)


@query("feat_poly_interaction_only", f"select {KEYS}, {', '.join(LINE)}, " + ", ".join(f'{a} * {b} as "{a}_{b}"' for a, b in PAIRS) + " from lineitem")
def feat_poly_interaction_only(spark, sf):
    return features.add_polynomial(_lines(spark, sf), LINE, interaction_only=True)


@query("feat_interactions", f"select {KEYS}, {', '.join(LINE)}, " + ", ".join(f"{a} * {b} as {a}_x_{b}" for a, b in PAIRS) + " from lineitem")
def feat_interactions(spark, sf):
    return features.add_interactions(_lines(spark, sf), LINE)


TIME_SQL = """hour(ts)::int as ts_hour, (isodow(ts) - 1)::int as ts_dayofweek, month(ts)::int as ts_month, day(ts)::int as ts_day,
    quarter(ts)::int as ts_quarter, case when isodow(ts) >= 6 then 1 else 0 end as ts_is_weekend"""


@query("feat_time", f"select event_id, {TIME_SQL} from events")
def feat_time(spark, sf):
    return features.add_time_parts(table(spark, sf, "events").select("event_id", "ts")).drop("ts")


def _rolling_sql(partition):
    over_text = "({p} order by ts, event_id rows between {k} preceding and current row)"
    parts = []
    for w in (3, 5, 10):
        win = over_text.replace("{p}", partition).replace("{k}", str(w - 1))
        parts += [f"round(avg(value) over {win}, 6) as value_rolling_mean_{w}", f"round(stddev_samp(value) over {win}, 6) as value_rolling_std_{w}"]
    return f"select event_id, {', '.join(parts)} from events"


def _rolled(df):
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in df.columns if "_rolling_" in c])


@query("feat_rolling", _rolling_sql("partition by user_id"))
def feat_rolling(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return _rolled(features.add_rolling(df, ["ts", "event_id"], ["value"], within=["user_id"]))


@query("feat_rolling_global", _rolling_sql(""))
def feat_rolling_global(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "value")
    return _rolled(features.add_rolling(df, ["ts", "event_id"], ["value"], bucket_rows=2000))


@query("feat_engineer_default", f"select event_id, user_id, event_type, value, {TIME_SQL}, event_id::double * user_id::double as event_id_x_user_id, "
       "event_id::double * value as event_id_x_value, user_id::double * value as user_id_x_value from events")
def feat_engineer_default(spark, sf):
    # the date column is named, so its parts are no inputs of the products
    base = table(spark, sf, "events").drop("props")
    built = features.engineer(base.drop("ts"), {"interactions": True})
    parts = features.engineer(base.select("event_id", "ts"))
    return built.join(parts.drop("ts"), "event_id")


PART_FEATURES = ["p_partkey", "p_size", "p_partkey^2", "p_partkey_p_size", "p_size^2"]
PART_SQL = """poly as (select p_partkey::double as p_partkey, p_size::double as p_size, p_partkey::double * p_partkey as "p_partkey^2",
    p_partkey::double * p_size as p_partkey_p_size, p_size::double * p_size as "p_size^2", p_retailprice from part)"""


@query("select_correlation", f"with {PART_SQL} select feature, round(correlation, 6) as correlation from (" + " union all ".join(
    f"select '{c}' as feature, abs(corr(\"{c}\", p_retailprice)) as correlation from poly" for c in PART_FEATURES) + ") where correlation >= 0.05")
def select_correlation(spark, sf):
    built = features.add_polynomial(table(spark, sf, "part"), ["p_partkey", "p_size"])
    return select.select_by_correlation(built, "p_retailprice").withColumn("correlation", F.round("correlation", 6))


def _mi_sql():
    parts = []
    for c in LINE:
        cuts = f"(select list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from lineitem)"
        parts.append(f"""
            select '{c}' as feature, round(sum(p * ln(n * nt / (nx * ny))), 6) as score from (
              select n::double as n, n / (sum(n) over ()) as p, sum(n) over () as nt, sum(n) over (partition by b) as nx, sum(n) over (partition by y) as ny from (
                select len(list_filter(e, lambda x: {c} > x)) as b, l_returnflag as y, count(*)::double as n from lineitem, {cuts} group by 1, 2))""")
    return " union all ".join(parts)


@query("select_mutual_info", _mi_sql())
def select_mutual_info(spark, sf):
    df = wide_table(spark, sf, "lineitem").select(*LINE, "l_returnflag")
    return select.mutual_information(df, "l_returnflag", "classification", columns=LINE).withColumn("score", F.round("score", 6))


@query("select_apply", " union all ".join(
    [f"select '{c}' as \"column\", coalesce(abs(corr({c}, p_retailprice)), 0) >= 0.05 as kept from part" for c in ("p_partkey", "p_size")]
    + [f"select '{c}', true" for c in ("p_name", "p_brand", "p_type", "p_retailprice")]))
def select_apply(spark, sf):
    df = table(spark, sf, "part")
    kept = set(features.engineer(df, {"time_features": False, "selection_method": "correlation"}, "p_retailprice", "regression").columns)
    return spark.createDataFrame([(c, c in kept) for c in df.columns], "column string, kept boolean")


def _selection(name, fn):
    @query(name)
    def run(spark, sf):
        df = wide_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
        built = features.add_polynomial(df, ["p_partkey", "p_size"], exclude=["p_retailprice"])
        scaled = transform.scale(built, "standard", exclude=["p_retailprice"])
        return fn(scaled)
    return run


_selection("select_rfe", lambda df: select.recursive_elimination(df, "p_retailprice", 2, "regression"))
_selection("select_lasso", lambda df: select.lasso(df, "p_retailprice"))
_selection("select_ridge", lambda df: select.ridge(df, "p_retailprice"))
_selection("select_tree", lambda df: select.tree_importance(df, "p_retailprice", "regression"))
