"""SQL names of the vector functions, as Arrow functions over vectors and blobs.

``register(spark)`` makes all of them known to ``spark.sql``. A vector is a text or an array of
numbers; a batch of equally long vectors is computed as one block. Typed blobs carry their
type as a struct ``(kind, data)``. Null gives null, but for ``vec_bit``, which wants a blob.
For arrays within DataFrames ``native`` has the same functions as plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from . import kernels
from .parse import VectorError, format_vec, parse_f32, parse_i8

BLOB = "kind string, data binary"
_STRUCT = pa.struct([("kind", pa.string()), ("data", pa.binary())])


def _vector(x: object, parse: Callable = parse_f32) -> np.ndarray:
    """A text parsed, an array as it is; a blob isn't a vector."""
    if isinstance(x, str):
        return parse(x)
    if isinstance(x, (bytes, bytearray, dict)):
        raise VectorError("vec: expected a text or an array, got a blob")
    return np.asarray(x, np.int8 if parse is parse_i8 else np.float32)


def _each(f: Callable, *columns: pd.Series) -> pd.Series:
    """``f`` of every row without a null."""
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)


def _pairs(name: str, a: pd.Series, b: pd.Series, f: Callable, parse: Callable = parse_f32) -> list:
    """``f`` of blocks of rows of one vector size, in the order of the rows; None where a side is null."""
    sides: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for k, row in enumerate(zip(a, b, strict=True)):
        if row[0] is None or row[1] is None:
            continue
        made = []
        for place, x in zip(("first", "second"), row, strict=True):
            try:
                made.append(_vector(x, parse))
            except VectorError as e:
                raise VectorError(f"{name}: invalid {place} vector: {e}") from None
        if len(made[0]) != len(made[1]):
            raise VectorError(f"{name}: dimension mismatch")
        sides.setdefault(len(made[0]), []).append((k, *made))
    out: list = [None] * len(a)
    for rows in sides.values():
        for k, value in zip([r[0] for r in rows], f(np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows])), strict=True):
            out[k] = value
    return out


def normalized(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    if n < 1e-10:
        raise VectorError("vec_normalize: zero vector has no unit form")
    return (v.astype(np.float64) / n).astype(np.float32)


def sliced(v: np.ndarray, start: int, end: int) -> np.ndarray:
    if start < 0 or end < 0 or start > end or end > len(v):
        raise VectorError("vec_slice: invalid slice indices")
    if start == end:
        raise VectorError("vec_slice: empty slice not allowed")
    return v[start:end]


def bit_blobs(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not a or len(a) != len(b):
        raise VectorError("vec_distance: bit vectors must be blobs of equal size")
    return np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)


def int8_blob(v: np.ndarray) -> bytes:
    """Clamped, then cut toward zero."""
    return np.trunc(np.clip(v, -128, 127)).astype(np.int8).tobytes()


def _tagged(kind: str, v: pa.Array, encode: Callable[[np.ndarray], bytes] | None) -> pa.Array:
    """Typed blobs: a blob is only tagged, a vector encoded, null stays null."""
    data = []
    for x in v.to_pylist():
        if encode is None and not isinstance(x, bytes):
            raise VectorError("vec_bit: input must be a BLOB")
        data.append(x if x is None or isinstance(x, bytes) else encode(_vector(x)))
    kinds = pa.array([kind] * len(data), pa.string())
    return pa.StructArray.from_arrays([kinds, pa.array(data, pa.binary())], fields=list(_STRUCT), mask=pa.array([x is None for x in data], pa.bool_()))


def scalar_udfs() -> dict[str, object]:
    """All functions by SQL name."""
    out: dict[str, object] = {}

    def vector_distance(metric: str, parse: Callable, name: str):
        kernel = kernels.KERNELS[metric]

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(_pairs("vec_distance", a, b, lambda x, y: kernel(x, y).tolist(), parse), dtype="Float64")

        out[name] = run

    for m in ("l2", "cosine", "ip", "l1", "hamming", "jaccard"):
        vector_distance(m, parse_f32, f"vec_distance_{m}")
    for m in ("l2", "cosine", "ip", "l1"):
        vector_distance(m, parse_i8, f"vec_distance_{m}_i8")

    def bit_distance(metric: str):
        kernel = kernels.KERNELS[metric]

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return _each(lambda x, y: float(kernel(*bit_blobs(x, y))), a, b).astype("Float64")

        out[f"vec_distance_{metric}_bit"] = run

    bit_distance("hamming")
    bit_distance("jaccard")

    @F.pandas_udf("string")
    def vec(v: pd.Series) -> pd.Series:
        return _each(lambda x: format_vec(_vector(x)), v)

    @F.pandas_udf("int")
    def vec_dims(v: pd.Series) -> pd.Series:
        return _each(lambda x: len(_vector(x)), v).astype("Int32")

    @F.pandas_udf("double")
    def vec_norm(v: pd.Series) -> pd.Series:
        return _each(lambda x: float(np.sqrt((_vector(x).astype(np.float64) ** 2).sum())), v).astype("Float64")

    @F.pandas_udf("string")
    def vec_add(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_pairs("vec_add", a, b, lambda x, y: map(format_vec, x + y)), dtype=object)

    @F.pandas_udf("string")
    def vec_sub(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_pairs("vec_sub", a, b, lambda x, y: map(format_vec, x - y)), dtype=object)

    @F.pandas_udf("string")
    def vec_normalize(v: pd.Series) -> pd.Series:
        return _each(lambda x: format_vec(normalized(_vector(x))), v)

    @F.pandas_udf("string")
    def vec_slice(v: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        whole = [0 if pd.isna(x) else int(x) for x in start], [0 if pd.isna(x) else int(x) for x in end]
        return pd.Series([None if x is None else format_vec(sliced(_vector(x), s, e)) for x, s, e in zip(v, *whole, strict=True)], dtype=object)

    @F.arrow_udf(BLOB)
    def vec_f32(v: pa.Array) -> pa.Array:
        return _tagged("float32", v, lambda x: x.tobytes())

    @F.arrow_udf(BLOB)
    def vec_int8(v: pa.Array) -> pa.Array:
        return _tagged("int8", v, int8_blob)

    @F.arrow_udf(BLOB)
    def vec_bit(v: pa.Array) -> pa.Array:
        return _tagged("bit", v, None)

    @F.arrow_udf("string")
    def vec_type(v: pa.Array) -> pa.Array:
        kind = v.type
        if pa.types.is_struct(kind) and kind.get_field_index("kind") >= 0:
            return pa.array([x and x["kind"] for x in v.to_pylist()], pa.string())
        name = "text" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else "unknown"
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            name = {"float": "float32", "int8": "int8"}.get(str(kind.value_type), "unknown")
        return pa.array([None if gone else name for gone in v.is_null().to_pylist()], pa.string())

    return out | {f.__name__: f for f in (vec, vec_dims, vec_norm, vec_add, vec_sub, vec_normalize, vec_slice, vec_f32, vec_int8, vec_bit, vec_type)}


def register(spark: SparkSession) -> list[str]:
    """Makes every function known under its SQL name."""
    made = scalar_udfs()
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
