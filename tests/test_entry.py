from pathlib import Path

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_names():
    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
    found = [n for n in names if n.endswith("_found")]
    assert all(n.startswith("p") for n in found) and "p3_found" in found


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_entry(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["rowid"] == 0 and rows[0]["distance"] == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["knn_l2", "knn_threshold_band", "batch_knn", "label_stats", "degree_stats", "strip_markup", "p3_counts"])
def test_some_queries(spark, name):
    assert e.queries()[name](spark, DATA).count() > 0


def test_only_the_optional_part_may_be_absent():
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError("gone", name={name!r})
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(e.llm is None)
"""
    root = str(Path(__file__).resolve().parents[1])
    for name, fine in (("vectide.llm", True), ("xxhash", False)):
        done = subprocess.run([sys.executable, "-c", code.format(name=name)], cwd=root, capture_output=True, text=True)
        if name == "xxhash" and e.llm is None:
            continue
        assert (done.stdout.strip() == "True") == fine, done.stderr


def test_components_of_all_layers(spark, tmp_path):
    from vectide.queries import QUERIES

    edges = [(0, 1, 2), (0, 2, 3), (1, 4, 3), (0, 7, 8), (0, 8, 8), (0, 9, None), (0, 1, 2)]
    spark.createDataFrame(edges, "layer int, node_id long, neighbor_id long").write.parquet(f"{tmp_path}/v_graph.parquet")
    got = {x[:] for x in QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
