"""Usable vectors and their exact copies, shared by the vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

DIMS = 64
#: So many smallest ids of equal vectors are kept beside each distinct vector; a search for k needs k + 1.
KEPT = 6


def valid(df: DataFrame, dims: int = DIMS, key: str = "rowid", vector: str = "vector") -> DataFrame:
    """(rowid, vector) of every row whose vector has ``dims`` finite elements that aren't all zero."""
    v = F.col(vector).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dims)).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("rowid"), v.alias("vector"))


def usable(df: DataFrame, dims: int = DIMS, key: str = "rowid", vector: str = "vector") -> DataFrame:
    """(rowid, vector) once an id, of the valid rows."""
    return valid(df, dims, key, vector).dropDuplicates(["rowid"])


def distinct_vectors(rows: DataFrame, kept: int = KEPT, salts: int = 16) -> DataFrame:
    """(vkey, vector, n, ids): each distinct vector, its number of ids and the smallest of them.

    The smallest ids are taken first per salt and then overall, so a vector that a third of
    all ids share is spread over ``salts`` groups.
    """
    keyed = rows.withColumn("vkey", F.xxhash64("vector")).withColumn("salt", F.pmod(F.xxhash64("rowid"), F.lit(salts)))
    part = keyed.withColumn("r", F.row_number().over(Window.partitionBy("vkey", "salt").orderBy("rowid"))).where(F.col("r") <= kept)
    some = part.groupBy("vkey").agg(F.first("vector").alias("vector"), F.slice(F.sort_array(F.collect_list("rowid")), 1, kept).alias("ids"))
    return some.join(keyed.groupBy("vkey").agg(F.count("*").alias("n")), "vkey")


def unit(values) -> np.ndarray:
    """Rows of unit length, in float32; the norm is taken in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, DIMS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, which cross to and from Python as one block."""
    return [row.tobytes() for row in x]


def matrix(rows) -> np.ndarray:
    """The rows that ``packed`` made."""
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)
