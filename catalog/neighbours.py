"""Neighbour searches and class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import balance, cluster, neighbors

from .registry import query, wide_table

DIMS = 64
FEATURES = [f"e{i}" for i in range(DIMS)]
DIST = "round(list_distance(a.v, b.v), 9)"
EMB = "emb as (select vec_id, embedding::double[] as v, label, (label = 0)::int as rare from embeddings)"
NEAR = """near as (select q, s, d, row_number() over (partition by q order by d, s) as rn from (
    select a.vec_id as q, b.vec_id as s, """ + DIST + """ as d from emb a join emb b on a.vec_id <> b.vec_id))"""
EPS = 1.2


def _vectors(spark, sf):
    """One double column per coordinate; ``rare`` marks one label in ten."""
    df = wide_table(spark, sf, "embeddings")
    return df.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
                     "label", (F.col("label") == 0).cast("int").alias("rare"))


@query("knn_join", f"with {EMB}, {NEAR} select q as vec_id, s as neighbor, round(d, 6) as distance, rn::int as rank from near where rn <= 5")
def knn_join(spark, sf):
    return neighbors.knn_join(_vectors(spark, sf), "vec_id", FEATURES, 5).withColumn("distance", F.round("distance", 6))


@query("eps_join", f"with {EMB} select a.vec_id, count(*) as n_within from emb a join emb b on {DIST} <= {EPS} group by 1")
def eps_join(spark, sf):
    return neighbors.eps_counts(_vectors(spark, sf), "vec_id", FEATURES, EPS)


DBSCAN_SQL = f"""
    with recursive {EMB},
    pairs as materialized (select a.vec_id as x, b.vec_id as y from emb a join emb b on {DIST} <= {EPS}),
    core as materialized (select x from pairs group by x having count(*) >= 5),
    links as materialized (select x, y from pairs where x in (select x from core) and y in (select x from core)),
    reach as (select x as node, x as root from core union select l.y, r.root from reach r join links l on l.x = r.node),
    owner as (select node, min(root) as first from reach group by 1),
    numbered as (select first, dense_rank() over (order by first) - 1 as cluster from (select distinct first from owner)),
    joined as (select x as vec_id, min(first) as first from pairs join owner on y = node
               where x not in (select x from core) group by 1 union all select node, first from owner)
    select e.vec_id, coalesce(cluster, -1)::int as cluster from emb e left join joined using (vec_id) left join numbered using (first)"""


@query("dbscan", DBSCAN_SQL)
def dbscan(spark, sf):
    return cluster.dbscan(_vectors(spark, sf), "vec_id", FEATURES, EPS, 5)


GAP_DIMS = DIMS
GAPS = FEATURES[:GAP_DIMS]


@query("impute_knn", f"""
    with g as (select vec_id, list_transform(range({GAP_DIMS}), lambda i: case when (vec_id + i) % 11 = 0 then null else embedding[i + 1]::double end) as v from embeddings),
    need as (select vec_id, v, unnest(range({GAP_DIMS})) as c from g),
    lack as (select * from need where v[c + 1] is null),
    pairs as (select l.vec_id, l.c, b.vec_id as donor, b.v[l.c + 1] as val,
              list_filter(list_transform(range({GAP_DIMS}), lambda i: pow(l.v[i + 1] - b.v[i + 1], 2)), lambda x: x is not null) as sq
              from lack l join g b on b.vec_id <> l.vec_id and b.v[l.c + 1] is not null),
    near as (select *, row_number() over (partition by vec_id, c order by round(sqrt(list_sum(sq) * {GAP_DIMS} / len(sq)), 9), donor) as rn from pairs where len(sq) > 0),
    fill as (select vec_id, c, avg(val) as val from near where rn <= 5 group by 1, 2),
    wide as (select vec_id, """ + ", ".join(f"max(case when c = {i} then val end) as f{i}" for i in range(GAP_DIMS)) + """ from fill group by 1)
    select g.vec_id, """ + ", ".join(f"round(coalesce(v[{i + 1}], f{i}), 6) as e{i}" for i in range(GAP_DIMS)) + " from g left join wide using (vec_id)")
def impute_knn(spark, sf):
    df = _vectors(spark, sf).select("vec_id", *[F.when((F.col("vec_id") + i) % 11 != 0, F.col(c)).alias(c) for i, c in enumerate(GAPS)])
    out = neighbors.knn_impute(df, GAPS, 5, key="vec_id")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in GAPS])


def _unit(seed):
    return f"(('0x' || substr(md5('{seed}:' || r.vec_id || ':' || i), 1, 8))::bigint / 4294967296.0::double)"


SMOTE = f"""
    sizes as (select count(*) filter (rare = 1) as n, count(*) filter (rare = 0) as top from emb),
    mine as (select *, row_number() over (order by md5('42:' || vec_id)) as pos from emb where rare = 1),
    own as (select q, s, row_number() over (partition by q order by d, s) as rn from (
        select a.vec_id as q, b.vec_id as s, {DIST} as d from mine a join mine b on a.vec_id <> b.vec_id)),
    avail as (select q, max(rn) as a from own where rn <= 5 group by 1),
    asked as (select vec_id, v, unnest(range((top - n) // n + case when pos <= top % n then 1 else 0 end)) as i from mine, sizes),
    made as (select r.vec_id, i, {_unit(42)} as u, r.v, o.v as w from asked r join avail on avail.q = r.vec_id
             join own on own.q = r.vec_id and own.rn = least(floor({_unit(43)} * a)::int + 1, a) join emb o on o.vec_id = own.s)"""


@query("smote", f"""
    with {EMB}, {SMOTE}
    select vec_id || '#' || i as vec_id, {', '.join(f'round(v[{j + 1}] + u * (w[{j + 1}] - v[{j + 1}]), 6) as e{j}' for j in range(DIMS))}, 1 as rare, true as synthetic from made
    union all select vec_id::varchar, {', '.join(f'round(v[{j + 1}], 6)' for j in range(DIMS))}, rare, false from emb""")
def smote(spark, sf):
    out = balance.smote(_vectors(spark, sf), "vec_id", FEATURES, "rare")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in FEATURES], "rare", "synthetic")


def _made(extra: str = "") -> str:
    return f"""select vec_id || '#' || i as vec_id, {', '.join(f'round(v[{j + 1}] + u * (w[{j + 1}] - v[{j + 1}]), 6) as e{j}' for j in range(DIMS))}, 1 as rare, true as synthetic from made
    union all select vec_id::varchar, {', '.join(f'round(v[{j + 1}], 6)' for j in range(DIMS))}, rare, false from emb"""


ADASYN = SMOTE.replace(SMOTE[SMOTE.index("    asked as"):SMOTE.index("    made as")], """    share as (select q as vec_id, avg((y.rare <> 1)::double) as r from near join emb x on x.vec_id = q join emb y on y.vec_id = s where x.rare = 1 and rn <= 5 group by 1),
    asked as (select mine.vec_id, v, unnest(range(round_even(r * (top - n) / (select sum(r) from share), 0)::bigint)) as i from share join mine using (vec_id), sizes),
""")


@query("adasyn", f"with {EMB}, {NEAR}, {ADASYN} {_made()}")
def adasyn(spark, sf):
    out = balance.adasyn(_vectors(spark, sf), "vec_id", FEATURES, "rare")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in FEATURES], "rare", "synthetic")


@query("tomek_links", f"""
    with {EMB}, {NEAR}, one as (select q, s from near where rn = 1)
    select vec_id, rare from emb where vec_id not in (
      select a.q from one a join one b on a.q = b.s and a.s = b.q join emb x on x.vec_id = a.q join emb y on y.vec_id = a.s where x.rare = 0 and y.rare = 1)""")
def tomek_links(spark, sf):
    return balance.tomek_links(_vectors(spark, sf), "vec_id", FEATURES, "rare").select("vec_id", "rare")


@query("enn", f"""
    with {EMB}, {NEAR}
    select vec_id, rare from emb where vec_id not in (
      select q from near join emb x on x.vec_id = q join emb y on y.vec_id = s where rn <= 3 and x.rare = 0 and y.rare = 1)""")
def enn(spark, sf):
    return balance.enn(_vectors(spark, sf), "vec_id", FEATURES, "rare").select("vec_id", "rare")


@query("smote_enn", f"""
    with {EMB}, {SMOTE},
    grown as materialized (
      select vec_id || '#' || i as id, list_transform(range({DIMS}), lambda j: v[j + 1] + u * (w[j + 1] - v[j + 1])) as v, 1 as rare, true as synthetic from made
      union all select vec_id::varchar, v, rare, false from emb),
    close as (select q, other, row_number() over (partition by q order by d, s) as rn from (
      select a.id as q, b.id as s, b.rare <> a.rare as other, {DIST} as d from grown a join grown b on a.id <> b.id))
    select id as vec_id, {', '.join(f'round(v[{j + 1}], 6) as e{j}' for j in range(DIMS))}, rare, synthetic from grown
    where id not in (select q from close where rn <= 3 and other)""")
def smote_enn(spark, sf):
    out = balance.smote_enn(_vectors(spark, sf), "vec_id", FEATURES, "rare")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in FEATURES], "rare", "synthetic")


@query("imbalance_report", f"""
    with {EMB}
    select 'before' as stage, rare as class, count(*) as n, round(count(*) * 100.0 / (select count(*) from emb), 2) as pct from emb group by 2
    union all select 'after', rare, (select count(*) filter (rare = 0) from emb), 50.0 from (select distinct rare from emb)""")
def imbalance_report(spark, sf):
    df = _vectors(spark, sf)
    return balance.balance_report(df, balance.rebalance(df, "vec_id", FEATURES, "rare", "smote"), "rare")
