import numpy as np
import pytest
from pyspark.sql import functions as F
from vectide.config import VecConfig
from vectide.plans.planner import Request, explain, path, register_search, run
from vectide.sources.table import VectorTable

CUBE = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def frame(spark, rows, start=None):
    if start is None:
        return spark.createDataFrame([(v,) for v in rows], "vector array<float>").coalesce(2)
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(rows)], "rowid long, vector array<float>")


@pytest.fixture
def table(spark, tmp_path):
    t = VectorTable.create(spark, str(tmp_path / "t"), "dims=3", "metric=l2", "ef_search=50")
    t.insert(frame(spark, CUBE))
    return t


def test_insert_assigns_ids(table):
    assert sorted(r["rowid"] for r in table.scan().collect()) == list(range(1, 9))
    assert table.count() == 8 and table.scan().where("distance is not null").isEmpty()


def test_texts_and_given_ids(spark, table):
    table.insert(spark.createDataFrame([(100, "[9, 9, 9]")], "rowid long, vector string"))
    assert [r["rowid"] for r in table.match("[9,9,9]", 1).collect()] == [100]
    table.insert(frame(spark, [[5.0, 5.0, 5.0]]))
    assert table.match([5, 5, 5], 1).first()["rowid"] == 101
    with pytest.raises(ValueError, match="already exists"):
        table.insert(frame(spark, [[0.0, 0.0, 0.0]], 3))
    assert table.count() == 10


def test_errors_change_nothing(spark, table):
    for bad in ([[1.0, 2.0]], [None]):
        with pytest.raises(Exception, match="expected 3 dims, got 2|NULL vector"):
            table.insert(frame(spark, bad))
    assert table.count() == 8
    with pytest.raises(ValueError, match="query has 2 dims, table has 3"):
        table.match("[1,2]")
    with pytest.raises(ValueError, match="not supported"):
        VectorTable.create(spark, str(table.path) + "2", "dims=3", "metric=hamming", "type=int8")


def test_transactions_and_snapshots(spark, table):
    reader = VectorTable.load(spark, str(table.path))
    before = reader.scan()
    table.begin()
    table.insert(frame(spark, [[7.0, 7.0, 7.0], [8.0, 8.0, 8.0]]))
    assert VectorTable.load(spark, str(table.path)).count() == 8
    table.rollback()
    assert table.count() == 8
    table.begin()
    table.delete([1, 999])
    table.commit()
    assert table.count() == 7 and before.count() == 8
    reader.refresh()
    assert reader.count() == 7
    table.vacuum()
    assert table.scan().count() == 7


def test_update_delete_reinsert(spark, table):
    table.update(frame(spark, [[4.0, 4.0, 4.0]], 2))
    assert table.match([4, 4, 4], 1).first()[:] == (2, 0.0)
    with pytest.raises(ValueError, match="cannot change rowid"):
        table.update(spark.createDataFrame([(2, [1.0, 1.0, 1.0], 3)], "rowid long, vector array<float>, new_rowid long"))
    table.delete(where=F.col("rowid") > 4)
    assert table.count() == 4
    table.delete()
    assert table.count() == 0 and table.match([0, 0, 0], 3).count() == 0
    table.insert(frame(spark, CUBE[:2]))
    assert table.count() == 2


@pytest.mark.parametrize(("kind", "metrics"), [("float32", ("l2", "cosine", "ip", "l1")), ("int8", ("l2", "cosine", "ip", "l1")), ("bit", ("hamming", "jaccard"))])
def test_types_and_metrics(spark, tmp_path, kind, metrics):
    rows = np.eye(16)[:4] * 50 if kind != "bit" else np.array([[1] * 8 + [0] * 8, [0] * 8 + [1] * 8, [1] * 4 + [0] * 12, [1] * 16], float)
    for m in metrics:
        t = VectorTable.create(spark, str(tmp_path / m), config=VecConfig(16, m, kind))
        t.insert(frame(spark, rows.tolist(), 1))
        got = t.match(rows[0].tolist(), 4).collect()
        assert got[0]["rowid"] == 1 and [g["distance"] for g in got] == sorted(g["distance"] for g in got)
        again = VectorTable.load(spark, str(tmp_path / m))
        assert again.config == t.config and again.match(rows[0].tolist(), 4).collect() == got
        text = again.scan(text=True).where("rowid = 1").first()["vector"]
        assert text.startswith("[1,1," if kind == "bit" else "[50,0,")


def test_index_follows_changes(spark, table):
    asked = table.match_indexed([(0, [0, 0, 0])], 3)
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the shards' nearest by query
    near = asked.collect()
    assert {n["rowid"] for n in near} >= {1} and len(near) == 3
    table.delete([1])
    assert table.state["dirty"] == [0]
    first = table.state["graph"]
    assert 1 not in {n["rowid"] for n in table.match_indexed([(0, [0, 0, 0])], 8).collect()}
    assert table.state["graph"].keys() == first.keys() and table.state["graph"] != first
    table.vacuum()
    assert table.match_indexed([(0, [0, 0, 0])], 8).count() == 7
    table.views("v")
    assert spark.sql("SELECT count(*) FROM v_graph g LEFT ANTI JOIN v_data d ON g.node_id = d.id").first()[0] == 0
    assert spark.table("v_layers").count() == 7 and spark.table("v_config").where("key = 'count'").first()["value"] == "7"


def test_rename_and_drop(spark, table):
    t = table.rename("other")
    assert t.path.name == "other" and t.count() == 8
    t.drop()
    assert not t.path.exists()
    with pytest.raises(FileExistsError):
        VectorTable.create(spark, str(t.path), "dims=3")
        VectorTable.create(spark, str(t.path), "dims=3")


def test_planner(spark, table):
    assert path(table, Request()) == "scan" and path(table, Request(rowid=2)) == "point" and path(table, Request(query=[0, 0, 0], matched=True, rowid=1)) == "exact"
    assert run(table, Request(rowid=2)).count() == 1 and run(table, Request()).count() == 8
    r = Request(query="[0,0,0]", matched=True, k=8, below=1.0)
    assert run(table, r).count() == 4 and explain(table, r) == "exact metric=l2 k=8 ef_search=50 then below=1.0"
    assert run(table, Request(query="[0,0,0]", matched=True, k=2, mode="graph")).count() == 2
    assert run(table, Request(query=None, matched=True)).count() == 0
    assert run(table, Request(query="[0,0,0]", matched=True, ef_search=-5)).count() == 8
    register_search(spark, "cube", table)
    assert spark.sql("SELECT * FROM vec_search_cube(array(float(0), float(0), float(0)), 3)").count() == 3


def test_point_lookup_reaches_the_scan(table):
    plan = table.point(3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rowid,3)" in plan


def test_stream_insert_is_idempotent(spark, tmp_path):
    from vectide.streaming.ingest import insert_stream

    frame(spark, CUBE, 1).write.parquet(str(tmp_path / "in"))
    t = VectorTable.create(spark, str(tmp_path / "t"), "dims=3")
    stream = lambda: spark.readStream.schema("rowid long, vector array<float>").parquet(str(tmp_path / "in"))
    insert_stream(stream(), t, str(tmp_path / "c1")).awaitTermination()
    insert_stream(stream(), t, str(tmp_path / "c2")).awaitTermination()
    assert VectorTable.load(spark, str(tmp_path / "t")).count() == 8


def test_recall_after_half_is_deleted_and_inserted_again(spark, tmp_path):
    r = np.random.default_rng(42)
    x = r.uniform(-1, 1, size=(500, 32)).astype(np.float32)
    t = VectorTable.create(spark, str(tmp_path / "t"), "dims=32", "metric=l2", "ef_construction=60", "ef_search=64")
    t.insert(frame(spark, x.tolist(), 1))
    t.optimize()
    t.delete(where=F.col("rowid") % 2 == 0)
    t.insert(frame(spark, x[1::2].tolist(), 1001))
    asked = [(i, r.uniform(-1, 1, 32).astype(np.float32)) for i in range(20)]
    ids = np.array([*range(1, 501, 2), *range(1001, 1251)])
    now = np.concatenate([x[0::2], x[1::2]])
    found = t.match_indexed(asked, 10).collect()
    share = [len({f["rowid"] for f in found if f["qid"] == i} & set(ids[np.argsort(np.linalg.norm(now - q, axis=1))[:10]].tolist())) / 10 for i, q in asked]
    assert np.mean(share) >= 0.8 and t.count() == 500


def test_deletes_are_tombstones_until_a_quarter_is_gone(spark, table):
    first = list(table.state["data"])
    table.delete([2])
    assert table.state["data"] == first and len(table.state["gone"]) == 1 and table.count() == 7
    table.update(frame(spark, [[4.0, 4.0, 4.0]], 3))
    assert table.count() == 7 and table.point(3).first()["vector"] == [4.0, 4.0, 4.0]
    table.insert(frame(spark, [[6.0, 6.0, 6.0]], 2))
    assert table.point(2).first()["vector"] == [6.0, 6.0, 6.0] and table.scan().count() == table.count() == 8
    table.delete([1, 4, 5])
    assert table.state["gone"] == [] and table.state["data"] != first and sorted(r["rowid"] for r in table.scan().collect()) == [2, 3, 6, 7, 8]
    table.vacuum()
    assert table.scan().count() == table.count() == 5


def test_an_update_names_an_id_once(spark, table):
    with pytest.raises(ValueError, match="named twice"):
        table.update(spark.createDataFrame([(2, [4.0, 4.0, 4.0]), (2, [5.0, 5.0, 5.0])], "rowid long, vector array<float>"))
    assert table.count() == 8 and table.scan().count() == 8
    table.update(frame(spark, [[9.0, 9.0, 9.0]], 77))
    assert table.count() == 8 and table.point(77).isEmpty()


def test_search_branches(spark, table, tmp_path):
    q = [0.0, 0.0, 0.0]
    table.optimize()
    for mode in ("exact", "graph"):
        want = [r["rowid"] for r in run(table, Request(query=q, k=3, mode=mode)).collect()]
        for ef in (-5, 0, "bad", True):
            assert [r["rowid"] for r in run(table, Request(query=q, k=3, mode=mode, ef_search=ef)).collect()] == want
        got = run(table, Request(query=q, k=3, mode=mode, prefilter=F.col("rowid") > 5)).collect()
        assert [r["rowid"] for r in got] == [6, 7, 8] or {r["rowid"] for r in got} <= {6, 7, 8} and len(got) == 3
    cosine = VectorTable.create(spark, str(tmp_path / "c"), "dims=3", "metric=cosine")
    cosine.insert(frame(spark, CUBE))
    register_search(spark, "zero", cosine)
    rows = spark.sql("SELECT * FROM vec_search_zero(array(float(1), float(0), float(0)), 8)").collect()
    assert len(rows) == 8 and {r["rowid"]: r["distance"] for r in rows}[1] == 1.0
    hamming = VectorTable.create(spark, str(tmp_path / "h"), "dims=3", "metric=hamming", "type=bit")
    hamming.insert(frame(spark, CUBE))
    register_search(spark, "bits", hamming)
    assert [r[:] for r in spark.sql("SELECT * FROM vec_search_bits(X'E0', 2)").collect()] == [(8, 0.0), (4, 1.0)]
