"""Graph recall and link counts against brute force; odd vectors."""
import numpy as np
from pyspark.sql import functions as F

from loomtab.llm import hnsw as H


def clustered(rng, n, d=16):
    x = rng.standard_normal((n, d))
    for i in range(0, n, 4):
        x[i + 1 : i + 3] = x[i] + 0.15 * rng.standard_normal((len(x[i + 1 : i + 3]), d))
    x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, d))  # a dense group
    return x


def true_links(x, y=None):
    u, v = (a / np.linalg.norm(a, axis=1)[:, None] for a in (x, x if y is None else y))
    return u @ v.T >= 0.95


def found_by(shard, vectors):
    asked = shard._ready(vectors)
    q, node, full = shard.pairs(asked)
    got = np.zeros((len(vectors), len(shard.unit)), dtype=bool)
    got[q, node] = True
    for rows, hit in shard.scan(asked, np.flatnonzero(full)):
        got[rows] = hit
    return got, full


def test_graph_recall():
    x = clustered(np.random.default_rng(0), 1500)
    shard = H.Shard(x, 0.95)
    true = true_links(x)
    got, full = found_by(shard, x)
    assert not (got & ~true).any() and (got & true).sum() >= 0.99 * true.sum()
    assert full[: 1500 // 3].all() and (got[full] == true[full]).all()  # full beams are answered by a scan
    degree = shard.graph.layers[0]
    assert (np.bincount(degree[degree >= 0], minlength=len(x)) > 0).all()  # every node can be reached


def test_links_are_folded_in_strips(monkeypatch):
    rng = np.random.default_rng(4)
    x = clustered(rng, 900)
    copies = rng.integers(1, 4, len(x)).astype(float)
    true = true_links(x)
    np.fill_diagonal(true, False)
    monkeypatch.setattr(H, "STRIP", 5000)
    shard = H.Shard(x, 0.95)
    counts, label = shard.links_inside(copies)
    assert (counts <= true @ copies).all() and counts.sum() >= 0.99 * (true @ copies).sum()
    want = H.Labels(len(x))
    want.join(*np.nonzero(true))
    assert (label == want.roots()).all()
    # queries of another shard
    y = clustered(rng, 300)
    y[:120] = x[:120] + 0.01 * rng.standard_normal((120, 16))
    weight, between = rng.integers(1, 4, len(y)).astype(float), true_links(y, x)
    before = counts.copy()
    links, q, component = shard.links_to(y, weight, copies, label, counts)
    assert (links <= between @ copies).all() and links.sum() >= 0.99 * (between @ copies).sum()
    assert (counts - before).sum() >= 0.99 * (weight @ between).sum() and (counts - before <= weight @ between).all()
    ties = {(i, label[j]) for i, j in zip(*np.nonzero(between))}
    assert len(set(zip(q, component)) - ties) == 0 and len(set(zip(q, component))) >= 0.99 * len(ties)


def test_a_dense_shard_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 3000
    x = rng.standard_normal(32)[None, :] + 0.05 * rng.standard_normal((n, 32))
    shard = H.Shard(x, 0.95)
    tracemalloc.start()
    counts, label = shard.links_inside(np.ones(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    true = true_links(x)
    assert (counts == true.sum(axis=1) - 1).all() and (label == 0).all()
    assert true.sum() > 0.9 * n * n and peak < 120 << 20  # all pairs as two numbers each would take 140 MB and more


def test_the_audit_widens_beams():
    rng = np.random.default_rng(6)
    shard = H.Shard(clustered(rng, 800), 0.95)
    shard.width, shard.true, shard.seen, shard.foreign = 32, 0, 0, 0
    shard.graph.layers[0][:] = -1  # a graph without links finds next to nothing
    y = shard.vectors[500:700] + 0.01 * rng.standard_normal((200, 16))
    label, counts = np.arange(800), np.zeros(800)
    shard.links_to(y, np.ones(200), np.ones(800), label, counts)
    assert shard.width > 32
    for _ in range(8):
        shard.links_to(y, np.ones(200), np.ones(800), label, counts)
    links, *_ = shard.links_to(y, np.ones(200), np.ones(800), label, counts)
    assert shard.width == 800 and (links == true_links(y, shard.vectors).sum(axis=1)).all()


def test_other_keys_and_audit_figures(spark):
    x = clustered(np.random.default_rng(7), 200).astype(np.float32)
    rows = [(i, [float(v) for v in r], "s", 1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, good int")
    want = sorted((r.vec_id, r.n_links, r.component_id) for r in H.near_duplicates(df).collect())
    for kind in ("smallint", "decimal(12,2)", "string", "date"):
        key = F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int")) if kind == "date" else F.lpad(F.col("vec_id").cast("string"), 4, "0") if kind == "string" else F.col("vec_id").cast(kind)
        own = df.withColumn("vec_id", key)
        names = dict(enumerate(r.vec_id for r in own.orderBy("vec_id").collect()))
        found, audit = H.audited_near_duplicates(own)
        assert found.schema["vec_id"].dataType == own.schema["vec_id"].dataType == found.schema["component_id"].dataType
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [(names[i], n, names[c]) for i, n, c in want]
    figures = audit.collect()
    assert len(figures) == H.SHARDS and sum(r.found for r in figures) >= 0.99 * sum(r.matches for r in figures)


def test_table_against_brute_force(spark):
    x = clustered(np.random.default_rng(1), 400).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, rows[5][1], 1), (1001, rows[5][1], 1), (1002, [2 * v for v in rows[9][1]], 1)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(2000 + k, v, 2) for k, v in enumerate(odd)] + [(3000, [1.0, 2.0], 0), (3001, [1.0, 2.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int").repartition(3)
    got = {r.vec_id: r for r in H.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if not 2000 <= i < 3000]
    links = {i: set() for i, *_ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i].add(j)
    total = sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links) and sum(r.n_links for r in got.values()) >= 0.99 * total
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            new = links[stack.pop()] - seen
            seen |= new
            stack += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    assert H.near_duplicates(df.limit(0)).count() == 0
