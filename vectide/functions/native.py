"""Vector functions as native column expressions over ``array<float>`` and ``array<tinyint>``.

They stay in the JVM, null in gives null out, and sizes are checked, since ``zip_with`` pads
short arrays. For all pairs or many queries use ``operators.knn``, which is vectorised.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISMATCH = "vec_distance: dimension mismatch"


def _guard(a: Column, b: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def vec_dims(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def vec_norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def vec_add(a: Column, b: Column) -> Column:
    return _guard(a, b, F.zip_with(a, b, lambda x, y: x + y), "vec_add: dimension mismatch", "array<float>")


def vec_sub(a: Column, b: Column) -> Column:
    return _guard(a, b, F.zip_with(a, b, lambda x, y: x - y), "vec_sub: dimension mismatch", "array<float>")


def vec_normalize(v: Column) -> Column:
    n = vec_norm(v)
    return F.when(v.isNull(), F.lit(None)).when(n < 1e-10, F.raise_error(F.lit("vec_normalize: zero vector has no unit form")).cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def vec_slice(v: Column, start: int, end: int) -> Column:
    """Elements ``start`` up to but without ``end``, counted from 0."""
    if start < 0 or start > end:
        raise ValueError("vec_slice: invalid slice indices")
    if start == end:
        raise ValueError("vec_slice: empty slice not allowed")
    return F.when(v.isNull(), F.lit(None)).when(F.size(v) < end, F.raise_error(F.lit("vec_slice: invalid slice indices")).cast("array<float>")).otherwise(F.slice(v, start + 1, end - start))


def distance_l2(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _guard(a, b, F.sqrt(_sum(F.zip_with(a, b, square))), MISMATCH, "double")


def distance_l1(a: Column, b: Column) -> Column:
    return _guard(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), MISMATCH, "double")


def distance_ip(a: Column, b: Column) -> Column:
    return _guard(a, b, -_dot(a, b), MISMATCH, "double")


def distance_cosine(a: Column, b: Column) -> Column:
    na, nb = vec_norm(a), vec_norm(b)
    d = F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - _dot(a, b) / (na * nb)))
    return _guard(a, b, d, MISMATCH, "double")


DISTANCES = {"l2": distance_l2, "l1": distance_l1, "ip": distance_ip, "cosine": distance_cosine}


def store_int8(v: Column) -> Column:
    """Stored int8: clamped to [-128, 127], rounded half away from zero, not scaled."""

    def one(x: Column) -> Column:
        c = F.least(F.greatest(x, F.lit(-128.0).cast("float")), F.lit(127.0).cast("float"))
        return F.when(c < 0, F.greatest(c - F.lit(0.5).cast("float"), F.lit(-128.0).cast("float"))).otherwise(F.least(c + F.lit(0.5).cast("float"), F.lit(127.0).cast("float"))).cast("tinyint")

    return F.transform(v, one)


def vec_int8(v: Column) -> Column:
    """The typed constructor: clamped, then cut toward zero."""
    return F.transform(v, lambda x: F.least(F.greatest(x, F.lit(-128.0).cast("float")), F.lit(127.0).cast("float")).cast("tinyint"))


def vec_type(kind: str) -> Column:
    """The type name of a column, from its Spark type: ``float32``, ``int8``, ``bit``, ``text`` or ``unknown``."""
    names = {"array<float>": "float32", "array<tinyint>": "int8", "binary": "bit", "string": "text"}
    return F.lit(names.get(kind, "unknown"))


def stretch(v: Column, factor: float) -> Column:
    """Elements times a constant, in float32."""
    return F.transform(v, lambda x: (x.cast("double") * F.lit(factor)).cast("float"))
