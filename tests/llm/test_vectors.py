from pathlib import Path

import numpy as np
import pytest
from vectide.llm import clustering, imi
from vectide.llm.vectors import usable
from vectide.session import shared_dir

SCHEMA = "rowid long, vector array<float>, embedded_at string, cell int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "t", 1, "y") for i, v in rows], SCHEMA)


def groups(seed, sizes, noise=0.25, alone=60):
    r = np.random.default_rng(seed)
    out = [c + noise * r.normal(size=(n, 64)) / 8 * np.linalg.norm(c) for n in sizes for c in [r.normal(size=64)]]
    x = np.concatenate([*out, r.normal(size=(alone, 64))])
    return (x * r.uniform(0.5, 9, size=(len(x), 1))).astype(np.float32)


def exact(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.fixture(scope="module")
def made(spark):
    x = groups(1, [300, 120, 40, 12, 5, 3, 2])
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x)]
    dirty = [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 63), (5003, [float("nan")] * 64), rows[3], rows[3]]
    return x, table(spark, rows + dirty)


def test_usable(made):
    x, df = made
    assert usable(df).count() == len(x)


def test_most_similar(made):
    x, df = made
    s = exact(x)
    np.fill_diagonal(s, -9)
    got = {(r["rowid"], r["neighbour"]) for r in imi.neighbours(df, 5).collect()}
    top = np.argsort(-s, axis=1, kind="stable")[:, :5]
    want = {(i + 10, j + 10) for i in range(len(x)) for j in top[i]}
    assert len(got & want) / len(want) >= 0.9
    strong = {(min(i, j) + 10, max(i, j) + 10) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.75}
    pairs = {r[:] for r in imi.found(df).select("rowid_a", "rowid_b").collect()}
    assert len(pairs & strong) / len(strong) >= 0.97 and len(pairs - strong) <= 0.03 * len(strong)
    part = {(r["rowid"], r["neighbour"]) for r in imi.neighbours(df, 5, every=20).collect()}
    assert {a for a, _ in part} == {i + 10 for i in range(len(x)) if (i + 10) % 20 == 0}


def test_chains_of_neighbours(made):
    x, df = made
    near = exact(x) >= 0.7
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    size = np.bincount(root, minlength=len(x))
    want = {(i + 10, root[i] + 10) for i in range(len(x)) if size[root[i]] >= 3}
    assert {r[:] for r in clustering.found(df).select("rowid", "cluster_key").collect()} == want


def test_clusters(made):
    x, df = made
    s, got = exact(x), clustering.clusters(df).collect()
    assert sum(r["n_members"] for r in got) == len(x)
    big = next(r for r in got if r["cluster_id"] == 10)
    assert big["n_members"] == 300 and len(big["typical"]) == 3 and big["medoid"] == big["typical"][0]
    assert big["medoid"] - 10 == int(s[:300, :300].sum(axis=1).argmax())


def test_a_chain_is_one_group(spark):
    a = np.zeros((9, 64), np.float32)
    for i in range(9):
        a[i, 0], a[i, 1] = np.cos(i * 0.6), np.sin(i * 0.6)
    got = {r[:] for r in clustering.found(table(spark, [(i, v.tolist()) for i, v in enumerate(a)])).select("rowid", "cluster_key").collect()}
    assert got == {(i, 0) for i in range(9)}


def test_copies_and_ties(spark):
    r = np.random.default_rng(2)
    v, w = r.normal(size=64).astype(np.float32), r.normal(size=64).astype(np.float32)
    df = table(spark, [(i, v.tolist()) for i in range(1, 41)] + [(100, w.tolist())])
    near = {}
    for row in imi.neighbours(df, 5).collect():
        near.setdefault(row["rowid"], []).append(row["neighbour"])
    assert sorted(near[3]) == [1, 2, 4, 5, 6] and sorted(near[30]) == [1, 2, 3, 4, 5] and len(near[100]) == 5
    pairs = {x[:] for x in imi.found(df).select("rowid_a", "rowid_b").collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in near.items() if a != 100 for b in bs}
    assert {x[:] for x in clustering.found(df).select("rowid", "cluster_key").collect()} == {(i, 1) for i in range(1, 41)}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = table(spark, [(i, np.eye(64)[i].tolist()) for i in range(n)])
    assert imi.neighbours(df, 5).count() == n * (n - 1)
    assert imi.found(df).count() == 0 and clustering.found(df).count() == 0 and clustering.clusters(df).count() == n


def test_walk_is_in_order():
    r = np.random.default_rng(3)
    g = imi.Grid(r.normal(size=(9, 32)).astype(np.float32), r.normal(size=(7, 32)).astype(np.float32), r.integers(0, 4, 63))
    x = r.normal(size=(3, 64)).astype(np.float32)
    a, b = g.distances(x)
    for k, path in enumerate(g.walk(x, 10**9)):
        d = [a[k, c // 7] + b[k, c % 7] for c in path]
        assert d == sorted(d) and set(path) == set(np.flatnonzero(g.counts).tolist())
        short = next(g.walk(x[k : k + 1], 20))
        assert short == path[: len(short)] and g.counts[short].sum() >= 20 > g.counts[short[:-1]].sum()


def test_regions_cover_all_cells():
    r = np.random.default_rng(4)
    cells, counts, points = np.arange(500), r.integers(1, 90, 500), r.normal(size=(500, 64)).astype(np.float32)
    out = imi.regions(cells, counts, points, 3000)
    assert np.bincount(out, weights=counts).max() <= 3000 and out.min() == 0


def test_a_hot_cell_is_spread(spark, monkeypatch):
    x = groups(6, [260, 40], alone=20)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    monkeypatch.setattr(imi, "REGION_ROWS", (64, 64))
    rows = usable(df)
    index = imi.fit(rows.selectExpr("xxhash64(vector) vkey", "vector"), "vkey")
    assert index.grid.parts.max() > 1
    sent = imi.routed(index).where("kind = 0").groupBy("region").count().toPandas()
    assert sent["count"].sum() == len(x) and sent["count"].max() < 130
    s = exact(x)
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :5]
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.75}
    assert {r[:] for r in imi.found(df).select("rowid_a", "rowid_b").collect()} == want
    assert clustering.found(df).groupBy("cluster_key").count().where("count >= 40").count() == 2


def test_a_group_larger_than_a_walk_is_one_cluster(spark):
    # Close families of ten within one group: the five nearest are met at once, the other 1,990 are neighbours too.
    r = np.random.default_rng(7)
    c = r.normal(size=64)
    heads = c + 0.38 * r.normal(size=(200, 64))
    x = np.concatenate([np.repeat(heads, 10, axis=0) + 0.02 * r.normal(size=(2000, 64)), r.normal(size=(400, 64))]).astype(np.float32)
    s = exact(x)
    assert s[:2000, :2000].min() >= 0.7 and s[2000:, :2000].max() < 0.7
    big = next(r for r in clustering.clusters(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect() if r["cluster_id"] == 0)
    assert big["n_members"] == 2000 and big["medoid"] == int(s[:2000, :2000].sum(axis=1).argmax())


def test_rounds_on_driver_and_in_passes_agree(spark, monkeypatch, made):
    x, df = made
    want = {r[:] for r in clustering.found(df).select("rowid", "cluster_key").collect()}
    sizes = {r["cluster_id"]: r["n_members"] for r in clustering.clusters(df).collect()}
    for batches, block in ((0, 100), (2, 64)):
        monkeypatch.setattr(clustering, "BATCH", 16)
        monkeypatch.setattr(clustering, "BATCHES", batches)
        monkeypatch.setattr(clustering, "BLOCK", block)
        assert {r[:] for r in clustering.found(df).select("rowid", "cluster_key").collect()} == want
        assert {r["cluster_id"]: r["n_members"] for r in clustering.clusters(df).collect()} == sizes


def test_pivots_are_those_of_the_hash_order(spark, made):
    x, _ = made
    near, order = exact(x) >= 0.7, np.random.default_rng(3).permutation(len(x))
    want, taken = [], np.zeros(len(x), bool)
    for i in order:
        if not taken[i]:
            want.append(i)
            taken |= near[i]
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert order[clustering.local_minima(u[order], 0.7)].tolist() == want


def test_one_link_joins_two_large_groups(spark, monkeypatch):
    # Two groups of 600 at a right angle, and two vectors between them that are neighbours of each other and of one group each.
    r = np.random.default_rng(8)
    a, b = np.eye(64)[0], np.eye(64)[1]
    near = [c + 0.02 * r.normal(size=(600, 64)) for c in (a, b)]
    bridge = np.array([np.cos(t) * a + np.sin(t) * b for t in (0.5, 1.1)])
    x = np.concatenate([*near, bridge]).astype(np.float32)
    s = exact(x)
    assert s[:600, 600:1200].max() < 0.7 and s[1200, 600:1200].max() < 0.7 and s[1201, :600].max() < 0.7 and s[1200, 1201] >= 0.7
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert {r[:] for r in clustering.found(df).select("rowid", "cluster_key").collect()} == {(i, 0) for i in range(1202)}
    alone = table(spark, [(i, v.tolist()) for i, v in enumerate(x[:-1])])
    assert clustering.found(alone).select("cluster_key").distinct().count() == 2


def written(spark):
    """Bytes that this session has shuffled or left in the shared folder so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    shuffled = spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    return shuffled + sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*"))


@pytest.mark.parametrize("query", ["found", "clusters"])
def test_vectors_are_not_copied_to_be_compared(spark, monkeypatch, query):
    x = groups(9, [40] * 50, alone=1000)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    whole = {r[:2] for r in getattr(clustering, query)(df).collect()}
    monkeypatch.setattr(clustering, "BATCH", 64)
    monkeypatch.setattr(clustering, "BLOCK", 128)  # 24 slices, which were as many copies of each vector
    before = written(spark)
    assert {r[:2] for r in getattr(clustering, query)(df).collect()} == whole
    assert written(spark) - before < 12 * x.nbytes
