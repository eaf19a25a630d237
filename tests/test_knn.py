import numpy as np
import pytest
from pyspark.sql import functions as F
from vectide.operators import hnsw, knn as K, metrics
from vectide.config import VecConfig


@pytest.fixture(scope="module")
def shells(spark):
    rows = [(1, [1, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [0, 0, 1, 0]), (4, [0, 0, 0, 1]), (5, [1, 1, 0, 0]), (6, None)]
    return spark.createDataFrame([(i, [float(x) for x in v] if v else None, i % 2) for i, v in rows], "rowid long, vector array<float>, tag int")


def test_order_and_ties(shells):
    got = [r["rowid"] for r in K.knn(shells, [1, 0, 0, 0], 10, "l2").collect()]
    assert got == [1, 5, 2, 3, 4]


@pytest.mark.parametrize(("bounds", "n"), [({"below": 1.0}, 2), ({"below": 1.0, "closed": "none"}, 1), ({"above": 1.0, "closed": "none"}, 3), ({"above": 1.0}, 4), ({"above": 0.5, "below": 1.2, "closed": "none"}, 1)])
def test_thresholds_filter_afterwards(shells, bounds, n):
    assert K.threshold(K.knn(shells, [1, 0, 0, 0], 10, "l2"), **bounds).count() == n


def test_limits_nulls_and_errors(shells):
    assert K.knn(shells, None, 3).count() == 0
    assert K.knn(shells, [1, 0, 0, 0], 0, "l2", ef_search=2).count() == 2
    with pytest.raises(ValueError, match="LIMIT"):
        K.knn(shells, [1, 0, 0, 0], 4097)
    with pytest.raises(Exception, match="query has 2 dims, table has 4"):
        K.knn(shells, [1, 0], 3).collect()
    assert K.knn(shells.where("rowid < 0"), [1, 0, 0, 0], 3).count() == 0


def test_prefilter_and_keep(shells):
    got = K.knn(shells, [1, 0, 0, 0], 2, "l2", prefilter=F.col("tag") == 0, keep=["tag"]).collect()
    assert [(r["rowid"], r["tag"]) for r in got] == [(2, 0), (4, 0)]


def test_batch_matches_single(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rowid long, vector array<float>").repartition(3)
    asked = df.where("rowid < 5").select(F.col("rowid").alias("qid"), "vector")
    for m in ("l2", "cosine", "ip", "l1", "hamming", "jaccard"):
        got = K.batch_knn(df, asked, 4, m, skip_self=False).orderBy("qid", "rank").collect()
        for q in range(5):
            want = [w["rowid"] for w in K.knn(df, x[q].tolist(), 4, m).collect()]
            assert [g["rowid"] for g in got if g["qid"] == q] == want
    near = K.similarity_join(df, asked, 1.5, "l2").count()
    assert near == int((np.linalg.norm(x[:5, None] - x[None], axis=2) <= 1.5).sum())
    assert K.batch_knn(df, asked.where("qid < 0"), 4).count() == 0


def brute(x, q, k):
    return set(np.argsort(np.linalg.norm(x - q, axis=1), kind="stable")[:k].tolist())


def test_graph_recall_and_integrity(spark):
    r = np.random.default_rng(42)
    x = r.uniform(-1, 1, size=(1000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rowid long, vector array<float>")
    c = VecConfig(64, "l2", ef_construction=80, ef_search=64)
    built = hnsw.build(df, c, 3).cache()
    asked = [(i, r.uniform(-1, 1, 64).astype(np.float32)) for i in range(20)]
    found = hnsw.search(built, asked, 10, c).collect()
    share = np.mean([len(brute(x, q, 10) & {f["rowid"] for f in found if f["qid"] == i}) / 10 for i, q in asked])
    assert share >= 0.8
    report = metrics.integrity(df, hnsw.edges(built), hnsw.layers(built), c.m).first()
    assert report[:] == (0, 0, 0, 0, 0)
    top = metrics.entry_point(hnsw.layers(built)).first()
    assert top["max_layer"] == hnsw.layers(built).agg(F.max("max_layer")).first()[0]
    again = hnsw.build(df, c, 3)
    assert built.exceptAll(again).isEmpty()
    over = hnsw.search(built, asked[:2], 5, c, metric="cosine")
    assert over.count() == 10


def test_recall_and_latency(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2)], "qid int, rowid int")
    found = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 9)], "qid int, rowid int")
    assert metrics.recall(found, truth, 2).first()[:] == (0.75, 0.5, 1.0)
    p = metrics.latency(spark.range(1, 102).withColumn("ms", F.col("id").cast("double")), "ms").first()
    assert p[:] == (1.0, 51.0, 96.0, 100.0, 101.0)


def test_graph_queries_beyond_one_block(spark, tmp_path, monkeypatch):
    from vectide.queries import QUERIES

    r = np.random.default_rng(8)
    rows = [(i, r.uniform(-1, 1, 64).astype(np.float32).tolist(), "a") for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(K, "BLOCK", 4)
    got = QUERIES["ann_hnsw_topk"](spark, str(tmp_path)).groupBy("qid").count().collect()
    assert {x[:] for x in got} == {(i, 10) for i in range(0, 300, 20)}
    assert QUERIES["hnsw_recall"](spark, str(tmp_path)).first()[:] == (15, True)


def test_many_queries_meet_the_corpus_by_a_shuffle(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.integers(-3, 4, size=(400, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "rowid long, vector array<float>").repartition(3)
    asked = df.select(F.col("rowid").alias("qid"), "vector")
    runs = []
    for direct in (4, 0):
        monkeypatch.setattr(K, "DIRECT", direct)
        monkeypatch.setattr(K, "BLOCK", 64 if not direct else 4096)
        near = {q[:] for q in K.batch_knn(df, asked, 3, "l2", skip_self=True).select("qid", "rowid", "rank").collect()}
        close = {q[:] for q in K.similarity_join(df, asked, 2.0, "l2").select("qid", "rowid").collect()}
        runs.append((near, close))
    assert runs[0] == runs[1] and len(runs[0][0]) == 1200
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, 1e9)
    assert runs[0][0] == {(i, int(j), k + 1) for i in range(400) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


def test_a_graph_is_mended_where_nodes_go_and_come(spark):
    r = np.random.default_rng(11)
    x = r.uniform(-1, 1, size=(900, 24)).astype(np.float32)
    c = VecConfig(24, "l2", ef_construction=60, ef_search=64)
    before = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:800])], "rowid long, vector array<float>")
    kept = [i for i in range(800) if i % 8]
    after = [(i, (x[i] if i % 40 != 1 else x[i] + 1).tolist()) for i in kept] + [(i, x[i].tolist()) for i in range(800, 860)]
    rows = spark.createDataFrame(after, "rowid long, vector array<float>")
    built = hnsw.refresh(rows, hnsw.build(before, c, 2), c, 2).cache()
    assert metrics.integrity(rows, hnsw.edges(built), hnsw.layers(built), c.m).first()[:] == (0, 0, 0, 0, 0)
    assert hnsw.layers(built).count() == len(after) and hnsw.edges(built).groupBy("layer", "node_id", "neighbor_id").count().where("count > 1").isEmpty()
    ids, now = np.array([i for i, _ in after]), np.array([v for _, v in after], np.float32)
    asked = [(i, r.uniform(-1, 1, 24).astype(np.float32)) for i in range(20)]
    found = hnsw.search(built, asked, 10, c).collect()
    share = [len({f["rowid"] for f in found if f["qid"] == i} & set(ids[np.argsort(np.linalg.norm(now - q, axis=1))[:10]].tolist())) / 10 for i, q in asked]
    assert np.mean(share) >= 0.9
    empty = hnsw.refresh(rows.where("false"), hnsw.build(before, c, 2), c, 2)
    assert empty.count() == 0 and hnsw.search(empty, asked, 3, c).count() == 0


def test_shards_are_bounded_in_rows_and_bytes():
    assert hnsw.shard_count(20_001) == 2 and hnsw.shard_count(20_000, dims=8192) == 10 and hnsw.shard_count(0) == 1 and hnsw.shard_count(1000, cores=8) == 4
