import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from vectide.config import VecConfig, check_k, check_metric
from vectide.functions import kernels, native
from vectide.functions.register import register


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    return lambda q: spark.sql(f"SELECT {q} AS r").first()["r"]


@pytest.mark.parametrize(
    ("call", "value"),
    [
        ("vec_distance_l2('[3,0]', '[0,4]')", 5), ("vec_distance_cosine('[1,2]', '[1,2]')", 0), ("vec_distance_cosine('[1,0]', '[0,1]')", 1),
        ("vec_distance_cosine('[1,0]', '[-1,0]')", 2), ("vec_distance_ip('[1,2]', '[3,4]')", -11), ("vec_distance_l1('[1,2]', '[4,6]')", 7),
        ("vec_distance_hamming('[0]', '[-0]')", 1), ("vec_distance_jaccard('[0]', '[0]')", 1), ("vec_distance_jaccard('[0]', '[-0]')", 1),
        ("vec_distance_l2_i8('[1,2,3]', '[3,4,5]')", 3.4641016), ("vec_distance_ip_i8('[1,2,3]', '[4,5,6]')", -32), ("vec_distance_l1_i8('[1,2,3]', '[4,5,6]')", 9),
        ("vec_distance_hamming_bit(X'FF', X'00')", 8), ("vec_distance_hamming_bit(X'FF00', X'F000')", 4), ("vec_distance_cosine('[0,0]', '[0,0]')", 0),
        ("vec_distance_cosine('[0,0]', '[1,0]')", 1), ("vec_dims('[1,2,3]')", 3), ("vec_norm('[3,4]')", 5),
    ],
)
def test_known_numbers(sql, call, value):
    assert sql(call) == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize(
    ("call", "value"),
    [
        ("vec('[1,,3]')", "[1,3]"), ("vec_add('[1,2,3]', '[4,5,6]')", "[5,7,9]"), ("vec_sub('[5,7,9]', '[1,2,3]')", "[4,5,6]"),
        ("vec_normalize('[3,4]')", "[0.6,0.8]"), ("vec_slice('[1,2,3,4,5]', 1, 4)", "[2,3,4]"), ("hex(vec_int8('[200,-200,50]').data)", "7F8032"),
        ("vec_type(vec_f32('[1]'))", "float32"), ("vec_type(vec_int8('[1]'))", "int8"), ("vec_type(vec_bit(X'F0'))", "bit"),
        ("vec_distance_l2(NULL, '[1]')", None), ("vec_slice('[1,2]', NULL, 1)", "[1]"),
    ],
)
def test_known_texts(sql, call, value):
    assert sql(call) == value


@pytest.mark.parametrize(
    ("call", "message"),
    [
        ("vec_distance_l2('[1]', '[1,2]')", "vec_distance: dimension mismatch"), ("vec_add('[1]', '[1,2]')", "vec_add: dimension mismatch"),
        ("vec_add('x', '[1,2]')", "vec_add: invalid first vector"), ("vec_normalize('[0,0]')", "zero vector has no unit form"),
        ("vec_slice('[1,2]', -1, 1)", "invalid slice indices"), ("vec_slice('[1,2]', 1, 1)", "empty slice not allowed"), ("vec_bit(CAST(NULL AS BINARY))", "vec_bit"),
        ("vec_distance_hamming_bit(X'FF', X'')", "equal size"),
    ],
)
def test_messages(sql, call, message):
    with pytest.raises(Exception, match=message):
        sql(call)


def test_native_against_kernels(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(30, 8)).astype(np.float32), r.normal(size=(30, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<float>, b array<float>")
    got = df.select("i", *[f(F.col("a"), F.col("b")).alias(n) for n, f in native.DISTANCES.items()]).orderBy("i").toPandas()
    for n in native.DISTANCES:
        np.testing.assert_allclose(got[n], kernels.KERNELS[n](a, b), atol=1e-9)
        np.testing.assert_allclose(np.diag(kernels.pairwise(n, a, b)), kernels.KERNELS[n](a, b), atol=1e-7)


def test_native_nulls_and_sizes(spark):
    df = spark.sql("SELECT array(float(1)) AS a, CAST(NULL AS array<float>) AS n, array(float(1), float(2)) AS b")
    assert df.select(native.distance_l2(F.col("a"), F.col("n")).alias("x"), native.vec_dims(F.col("n")).alias("d"), native.vec_normalize(F.col("n")).alias("z")).first()[:] == (None, None, None)
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(native.distance_l2(F.col("a"), F.col("b"))).collect()


def test_three_int8_conversions(spark):
    df = spark.sql("SELECT array(float(200), float(-200), float(0), float(50), float(1.5), float(-1.5), float(0.4)) AS v")
    row = df.select(native.store_int8(F.col("v")).alias("s"), native.vec_int8(F.col("v")).alias("t")).first()
    assert row["s"] == [127, -128, 0, 50, 2, -2, 0] == kernels.store(np.array([200, -200, 0, 50, 1.5, -1.5, 0.4], np.float32), "int8").tolist()
    assert row["t"] == [127, -128, 0, 50, 1, -1, 0]


def test_bit_packing():
    assert kernels.store(np.array([1, 1, 1, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, 0, 1], np.float32), "bit").tobytes() == b"\xf0\xa5"


def test_config():
    assert VecConfig.parse("dims=4", "metric=l2sq").metric == "l2"
    assert check_metric("dot", "int8") == "ip" and check_k(None, 10) == 10 and check_k(-1, 7) == 7 and check_k(4096, 1) == 4096
    for bad in (("dims=0",), ("dims=9000",), ("metric=l2",), ("dims=4", "metric=hamming", "type=int8"), ("dims=4", "metric=nope"), ("dims=4", "typ=int8"), ("dims=4", "m=1")):
        with pytest.raises(ValueError):
            VecConfig.parse(*bad)
    with pytest.raises(ValueError, match="LIMIT must be <= 4096"):
        check_k(4097, 10)


@settings(max_examples=40)
@given(st.lists(st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4), min_size=3, max_size=3))
def test_metric_axioms(rows):
    x, y, z = (np.array(v, np.float32) for v in rows)
    for m in ("l2", "l1", "hamming"):
        d = kernels.KERNELS[m]
        assert d(x, x) == 0 and d(x, y) == d(y, x) and d(x, z) <= d(x, y) + d(y, z) + 1e-6
    assert 0 <= kernels.cosine(x, y) <= 2 + 1e-9


@pytest.mark.parametrize(
    ("call", "value"),
    [
        ("vec_type('[1]')", "text"), ("vec_type(vec_f32('[1,2,3]'))", "float32"), ("vec_type(vec_int8(X'010203'))", "int8"), ("vec_type(vec_bit(X'FF00'))", "bit"),
        ("vec_type(X'00')", "unknown"), ("vec_type(NULL)", None), ("vec_f32(NULL)", None), ("vec_int8(CAST(NULL AS STRING))", None), ("vec_type(vec_f32(CAST(NULL AS STRING)))", None),
        ("hex(vec_int8('[200, -200, 50]').data)", "7F8032"), ("hex(vec_f32(X'0000803F').data)", "0000803F"), ("length(vec_f32(array(1D, 2D, 3D)).data)", 12),
        ("vec_add(array(float(1), float(2)), '[1,1]')", "[2,3]"), ("vec_type(array(float(1)))", "float32"),
    ],
)
def test_typed_values(sql, call, value):
    assert sql(call) == value


def test_arrays_and_mixed_sizes(spark, sql):
    assert sql("vec_distance_l2(array(1, 2), array(4, 6))") == 5 and sql("vec_dims(array(1, 2))") == 2
    rows = spark.createDataFrame([(1, "[3,0]", "[0,4]"), (2, "[1]", "[3]"), (3, None, "[1]"), (4, "[0,0]", "[3,4]")], "i int, a string, b string").coalesce(1)
    got = {r["i"]: r["d"] for r in rows.select("i", F.expr("vec_distance_l2(a, b)").alias("d")).collect()}
    assert got == {1: 5.0, 2: 2.0, 3: None, 4: 5.0}
    with pytest.raises(Exception, match="input must be a BLOB"):
        sql("vec_bit(NULL)")
