"""Queries of the core by name, and their SQL for the comparison.

Distances are taken in double precision and rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .config import METRICS, VecConfig
from .functions import native
from .functions.parse import format_vec
from .functions.register import register, scalar_udfs
from .operators import hnsw, knn as K, metrics, orphans, text
from .operators.components import components
from .plans import planner
from .session import cut, shared_dir, spread, table as t
from .sources.pages import append_csv, read_pages, write_json
from .sources.table import VectorTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows_of(s: SparkSession, d: str) -> DataFrame:
    """The embeddings as (rowid, vector, label)."""
    return t(s, d, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"), "label")


def first_vector(s: SparkSession, d: str, rowid: int = 0) -> np.ndarray:
    return np.array(rows_of(s, d).where(F.col("rowid") == rowid).select("vector").first()[0], np.float32)


def constant(v: np.ndarray) -> Column:
    return F.expr("array(" + ", ".join(f"float({float(x)!r}D)" for x in v) + ")")


def scratch(s: SparkSession) -> str:
    """The name of a fresh folder under the shared one."""
    return f"{shared_dir(s).rstrip('/')}/vectide-{uuid.uuid4().hex}"


_E = "(SELECT vec_id AS rowid, embedding::DOUBLE[] AS v, label FROM embeddings)"
_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_D = {
    "l2": "list_distance({a}, {b})",
    "cosine": "greatest(0, 1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))",
    "ip": "-list_inner_product({a}, {b})",
    "l1": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
}


def _sql_distance(m: str, a: str = "v", b: str = "q") -> str:
    return _D[m].format(a=a, b=b)


# Scans, points, columns


@query("scan_all", f"SELECT rowid, list_transform(v, lambda x: round(x, 6)) AS vector, NULL::DOUBLE AS distance FROM {_E}")
def scan_all(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"), F.lit(None).cast("double").alias("distance"))


@query("point_lookup", f"SELECT rowid, label, len(v)::INTEGER AS dims FROM {_E} WHERE rowid = 7")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).where("rowid = 7").select("rowid", "label", native.vec_dims(F.col("vector")).alias("dims"))


# Distances of all rows to one query


def _distance(m: str) -> None:
    @query(f"dist_{m}", f"SELECT rowid, round({_sql_distance(m)}, 6) AS distance FROM {_E}, {_Q0}")
    def run(s: SparkSession, d: str) -> DataFrame:
        return rows_of(s, d).select("rowid", F.round(native.DISTANCES[m](F.col("vector"), constant(first_vector(s, d))), 6).alias("distance"))

    @query(f"knn_{m}", f"SELECT rowid, round({_sql_distance(m)}, 6) AS distance FROM {_E}, {_Q0} ORDER BY {_sql_distance(m)}, rowid LIMIT 10")
    def near(s: SparkSession, d: str) -> DataFrame:
        return K.knn(rows_of(s, d), first_vector(s, d), 10, m).select("rowid", F.round("distance", 6).alias("distance"))


for _m in _D:
    _distance(_m)

_I8 = "list_transform(v, lambda x: (CASE WHEN least(greatest(x * 127, -128), 127) < 0 THEN ceil(least(greatest(x * 127, -128), 127) - 0.5::DOUBLE) ELSE floor(least(greatest(x * 127, -128), 127) + 0.5::DOUBLE) END)::DOUBLE)"
_I8ROWS = f"(SELECT rowid, label, {_I8} AS v FROM (SELECT rowid, label, list_transform(v, lambda x: (x)::FLOAT::DOUBLE) AS v FROM {_E}) e)"


def int8_rows(s: SparkSession, d: str) -> DataFrame:
    """The embeddings times 127 in stored int8."""
    return rows_of(s, d).withColumn("vector", native.store_int8(F.transform("vector", lambda x: (x.cast("double") * 127).cast("float"))))


def _distance_i8(m: str) -> None:
    @query(f"dist_{m}_i8", f"SELECT rowid, round({_sql_distance(m)}, 6) AS distance FROM {_I8ROWS} r, (SELECT v AS q FROM {_I8ROWS} x WHERE rowid = 0) y")
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = int8_rows(s, d)
        q = rows.where("rowid = 0").select("vector").first()[0]
        return rows.select("rowid", F.round(native.DISTANCES[m](F.col("vector"), F.array(*[F.lit(int(x)).cast("tinyint") for x in q])), 6).alias("distance"))


for _m in _D:
    _distance_i8(_m)


def bit_rows(s: SparkSession, d: str) -> DataFrame:
    """The signs of the embeddings, packed."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.asarray(x) > 0).tobytes() for x in v])

    return rows_of(s, d).withColumn("vector", pack("vector"))


_SIGNS = f"(SELECT rowid, list_transform(v, lambda x: (x > 0)::INTEGER) AS b FROM {_E})"
_BITS = {
    "hamming": "list_sum(list_transform(list_zip(b, q), lambda z: (z[1] <> z[2])::INTEGER))::DOUBLE",
    "jaccard": "CASE WHEN list_sum(list_transform(list_zip(b, q), lambda z: greatest(z[1], z[2]))) = 0 THEN 1.0::DOUBLE ELSE round(1 - list_sum(list_transform(list_zip(b, q), lambda z: z[1] * z[2]))::DOUBLE / list_sum(list_transform(list_zip(b, q), lambda z: greatest(z[1], z[2]))), 6) END",
}


_BOTH = "list_sum(list_transform(list_zip(embedding, q), lambda z: bit_count(z[1]::FLOAT::BIT {op} z[2]::FLOAT::BIT)))::DOUBLE"
_FLOAT_BITS = {
    "hamming": "list_sum(list_transform(list_zip(embedding, q), lambda z: bit_count(xor(z[1]::FLOAT::BIT, z[2]::FLOAT::BIT))))::DOUBLE",
    "jaccard": f"round(CASE WHEN {_BOTH.format(op='|')} = 0 THEN 1 ELSE 1 - {_BOTH.format(op='&')} / {_BOTH.format(op='|')} END, 6)",
}


def _distance_bit(m: str) -> None:
    @query(f"dist_{m}_bit", f"SELECT rowid, {_BITS[m]} AS distance FROM {_SIGNS} x, (SELECT b AS q FROM {_SIGNS} y WHERE rowid = 0) z")
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = bit_rows(s, d)
        q = F.lit(bytearray(rows.where("rowid = 0").select("vector").first()[0]))
        return rows.select("rowid", F.round(scalar_udfs()[f"vec_distance_{m}_bit"](F.col("vector"), q), 6).alias("distance"))

    @query(f"dist_{m}_f32", f"SELECT vec_id AS rowid, {_FLOAT_BITS[m]} AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) y")
    def raw(s: SparkSession, d: str) -> DataFrame:
        return K.within(rows_of(s, d), first_vector(s, d), float("inf"), m).select("rowid", F.round("distance", 6).alias("distance"))

    @query(f"knn_{m}_bit", f"SELECT rowid, {_BITS[m]} AS distance FROM {_SIGNS} x, (SELECT b AS q FROM {_SIGNS} y WHERE rowid = 0) z ORDER BY 2, 1 LIMIT 10")
    def near(s: SparkSession, d: str) -> DataFrame:
        rows = bit_rows(s, d)
        q = bytes(rows.where("rowid = 0").select("vector").first()[0])
        return K.knn(rows, q, 10, m).select("rowid", F.round("distance", 6).alias("distance"))


for _m in _BITS:
    _distance_bit(_m)


# Scalar functions


@query("vec_dims", f"SELECT rowid, len(v)::INTEGER AS dims FROM {_E}")
def q_dims(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", native.vec_dims(F.col("vector")).alias("dims"))


@query("vec_norm", f"SELECT rowid, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM {_E}")
def q_norm(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", F.round(native.vec_norm(F.col("vector")), 6).alias("norm"))


def _binary(name: str, f: Callable[[Column, Column], Column], op: str) -> None:
    @query(name, f"SELECT vec_id AS rowid, list_transform(list_zip(embedding, q), lambda z: round((z[1] {op} z[2])::FLOAT::DOUBLE, 6) + 0::DOUBLE) AS vector FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
    def run(s: SparkSession, d: str) -> DataFrame:
        v = f(F.col("vector"), constant(first_vector(s, d)))
        # Adding zero takes the sign off a rounded -0.0.
        return rows_of(s, d).select("rowid", F.transform(v, lambda x: F.round(x.cast("double"), 6) + F.lit(0.0)).alias("vector"))


_binary("vec_add", native.vec_add, "+")
_binary("vec_sub", native.vec_sub, "-")


@query("vec_normalize", f"SELECT rowid, list_transform(y, lambda x: round((x / sqrt(list_inner_product(y, y)))::FLOAT::DOUBLE, 5)) AS vector FROM (SELECT rowid, list_transform(v, lambda x: (3 * x)::FLOAT::DOUBLE) AS y FROM {_E}) t")
def q_normalize(s: SparkSession, d: str) -> DataFrame:
    v = native.vec_normalize(native.stretch(F.col("vector"), 3.0))
    return rows_of(s, d).select("rowid", F.transform(v, lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@query("vec_slice", f"SELECT rowid, list_transform(list_slice(v, 9, 16), lambda x: round(x, 6)) AS vector FROM {_E}")
def q_slice(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", F.transform(native.vec_slice(F.col("vector"), 8, 16), lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def _text_of(vector: str) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([format_vec(x) for x in v])

    return run(vector)


@query("vec_text_roundtrip", "SELECT vec_id AS rowid, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.7g', x::DOUBLE)), ',') || ']' AS txt FROM embeddings")
def q_text(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", scalar_udfs()["vec"](_text_of("vector")).alias("txt"))


@query("vec_int8", "SELECT vec_id AS rowid, list_transform(embedding, lambda x: trunc(least(greatest((x::DOUBLE * 200)::FLOAT, -128), 127))::TINYINT) AS v8 FROM embeddings")
def q_int8(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", native.vec_int8(native.stretch(F.col("vector"), 200.0)).alias("v8"))


@query("vec_store_int8", f"SELECT rowid, list_transform(v, lambda x: x::TINYINT) AS v8 FROM {_I8ROWS} r")
def q_store_int8(s: SparkSession, d: str) -> DataFrame:
    return int8_rows(s, d).select("rowid", F.col("vector").alias("v8"))


@query("vec_type", "SELECT vec_id AS rowid, 'float32' AS f, 'int8' AS i, 'bit' AS b, 'text' AS s FROM embeddings")
def q_type(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("rowid", *[native.vec_type(k).alias(n) for n, k in (("f", dict(rows_of(s, d).dtypes)["vector"]), ("i", dict(int8_rows(s, d).dtypes)["vector"]), ("b", dict(bit_rows(s, d).dtypes)["vector"]), ("s", "string"))])


_ONES = "list_sum(list_transform(embedding, lambda x: bit_count(x::FLOAT::BIT)))::DOUBLE AS ones"


def _typed(s: SparkSession, d: str) -> None:
    """A view of the embeddings as arrays, texts and packed signs, and the SQL functions."""
    register(s)
    bits = bit_rows(s, d).select("rowid", F.col("vector").alias("bits"))
    rows_of(s, d).withColumn("txt", _text_of("vector")).join(bits, "rowid").createOrReplaceTempView("vectide_typed")


@query("vec_f32", f"SELECT vec_id AS rowid, (4 * len(embedding))::INTEGER AS n_bytes, 'float32' AS kind, {_ONES} FROM embeddings")
def q_f32(s: SparkSession, d: str) -> DataFrame:
    _typed(s, d)
    return s.sql("SELECT rowid, length(b.data) AS n_bytes, b.kind, vec_distance_hamming_bit(b.data, cast(repeat(chr(0), length(b.data)) AS binary)) AS ones FROM (SELECT rowid, vec_f32(vector) AS b FROM vectide_typed)")


@query("vec_bit", "SELECT vec_id AS rowid, 8 AS n_bytes, 'bit' AS kind, len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS ones FROM embeddings")
def q_bit(s: SparkSession, d: str) -> DataFrame:
    _typed(s, d)
    return s.sql("SELECT rowid, length(b.data) AS n_bytes, b.kind, vec_distance_hamming_bit(b.data, X'0000000000000000') AS ones FROM (SELECT rowid, vec_bit(bits) AS b FROM vectide_typed)")


@query(
    "vec_type_sql",
    "SELECT vec_id AS rowid, CASE WHEN vec_id % 3 = 0 THEN 'int8' WHEN vec_id % 3 = 1 THEN 'float32' END AS typed, CASE WHEN vec_id % 2 = 0 THEN 'text' END AS txt, 'unknown' AS raw FROM embeddings",
)
def q_type_sql(s: SparkSession, d: str) -> DataFrame:
    _typed(s, d)
    return s.sql(
        "SELECT rowid, vec_type(CASE WHEN rowid % 3 = 0 THEN vec_int8(txt) WHEN rowid % 3 = 1 THEN vec_f32(bits) END) AS typed, vec_type(CASE WHEN rowid % 2 = 0 THEN txt END) AS txt, vec_type(bits) AS raw FROM vectide_typed"
    )


@query("sql_functions_arrays", f"SELECT rowid, {', '.join(f'round({_sql_distance(m)}, 5) AS {m}' for m in _D)} FROM {_E}, {_Q0}")
def q_sql_arrays(s: SparkSession, d: str) -> DataFrame:
    _typed(s, d)
    measures = ", ".join(f"round(vec_distance_{m}(a.vector, b.vector), 5) AS {m}" for m in _D)
    return s.sql(f"SELECT a.rowid, {measures} FROM vectide_typed a JOIN (SELECT vector FROM vectide_typed WHERE rowid = 0) b")


_TEXTS = "(SELECT vec_id AS rowid, list_transform(embedding, lambda x: printf('%.7g', x::DOUBLE)::FLOAT::DOUBLE) AS v FROM embeddings)"


@query("sql_functions", f"SELECT rowid, round({_sql_distance('l2')}, 5) AS l2, len(v)::INTEGER AS dims FROM {_TEXTS} a, (SELECT v AS q FROM {_TEXTS} b WHERE rowid = 0) c")
def q_sql(s: SparkSession, d: str) -> DataFrame:
    register(s)
    rows_of(s, d).select("rowid", _text_of("vector").alias("txt")).createOrReplaceTempView("vectide_texts")
    q = format_vec(first_vector(s, d))
    return s.sql(f"SELECT rowid, round(vec_distance_l2(txt, '{q}'), 5) AS l2, vec_dims(txt) AS dims FROM vectide_texts")


# Nearest neighbours with conditions


def _threshold(name: str, where: str, **bounds: object) -> None:
    @query(name, f"SELECT rowid, round(x, 6) AS distance FROM (SELECT rowid, {_sql_distance('l2')} AS x FROM {_E}, {_Q0} ORDER BY 2, 1 LIMIT 50) k WHERE {where}")
    def run(s: SparkSession, d: str) -> DataFrame:
        near = K.threshold(K.knn(rows_of(s, d), first_vector(s, d), 50, "l2"), **bounds)
        return near.select("rowid", F.round("distance", 6).alias("distance"))


_threshold("knn_threshold_lt", "x < 1.2", below=1.2, closed="none")
_threshold("knn_threshold_le", "x <= 1.2", below=1.2)
_threshold("knn_threshold_gt", "x > 1.0", above=1.0, closed="none")
_threshold("knn_threshold_ge", "x >= 1.0", above=1.0)
_threshold("knn_threshold_band", "x >= 0.5 AND x <= 1.2", above=0.5, below=1.2)


@query("range_search", f"SELECT rowid, round({_sql_distance('l2')}, 6) AS distance FROM {_E}, {_Q0} WHERE {_sql_distance('l2')} <= 1.3")
def q_range(s: SparkSession, d: str) -> DataFrame:
    return K.within(rows_of(s, d), first_vector(s, d), 1.3, "l2").select("rowid", F.round("distance", 6).alias("distance"))


_NEAR = f"(SELECT rowid, label, {_sql_distance('cosine')} AS x FROM {_E}, {_Q0} ORDER BY x, rowid LIMIT 20)"


@query("knn_prefilter_label", f"SELECT rowid, round({_sql_distance('cosine')}, 6) AS distance FROM {_E}, {_Q0} WHERE label = 3 ORDER BY {_sql_distance('cosine')}, rowid LIMIT 10")
def q_prefilter(s: SparkSession, d: str) -> DataFrame:
    return K.knn(rows_of(s, d), first_vector(s, d), 10, "cosine", prefilter=F.col("label") == 3).select("rowid", F.round("distance", 6).alias("distance"))


@query("knn_postfilter_label", f"SELECT rowid, round(x, 6) AS distance, label FROM {_NEAR} n WHERE label IN (1, 3, 5)")
def q_postfilter(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20, "cosine", keep=["label"])
    return near.where(F.col("label").isin(1, 3, 5)).select("rowid", F.round("distance", 6).alias("distance"), "label")


@query("knn_rowid_join", f"SELECT n.rowid, p_name, round(x, 6) AS distance FROM {_NEAR} n JOIN part ON p_partkey = n.rowid")
def q_join(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20)
    return t(s, d, "part").join(F.broadcast(near), F.col("p_partkey") == F.col("rowid")).select("rowid", "p_name", F.round("distance", 6).alias("distance"))


def wiki_rows(s: SparkSession, d: str) -> DataFrame:
    """Whole 64-element vectors of the chunks, once an id."""
    v = t(s, d, "wiki_vec").where("vector is not null and size(vector) = 64")
    return v.where(F.exists("vector", lambda x: x != 0)).dropDuplicates(["rowid"]).select("rowid", "vector")


_WIKI = "(SELECT rowid, any_value(vector)::DOUBLE[] AS v FROM (SELECT \"rowid\" AS rowid, vector FROM wiki_vec) w WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY rowid)"
_CHUNK = "(SELECT id, any_value(article_id) AS article_id, any_value(chunk_index) AS chunk_index, any_value(content) AS content FROM wiki_chunks GROUP BY id)"
_ARTICLE = "(SELECT id, any_value(title) AS title FROM wiki_articles GROUP BY id)"


@query(
    "knn_join3",
    f"""WITH w AS {_WIKI}, q AS (SELECT v AS q FROM w WHERE rowid = (SELECT min(rowid) FROM w)),
n AS (SELECT rowid, {_sql_distance('cosine')} AS x FROM w, q ORDER BY x, rowid LIMIT 20)
SELECT n.rowid, c.chunk_index, a.title, round(x, 6) AS distance, round(1 - x, 6) AS similarity FROM n JOIN {_CHUNK} c ON c.id = n.rowid JOIN {_ARTICLE} a ON a.id = c.article_id""",
)
def q_join3(s: SparkSession, d: str) -> DataFrame:
    rows = wiki_rows(s, d)
    q = rows.agg(F.min_by("vector", "rowid")).first()[0]
    near = K.knn(rows, q, 20, "cosine")
    chunks, articles = t(s, d, "wiki_chunks").dropDuplicates(["id"]), t(s, d, "wiki_articles").dropDuplicates(["id"])
    return text.ranked(near, chunks, articles).select("rowid", "chunk_index", "title", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(
    "ranked_preview",
    f"""WITH w AS {_WIKI}, q AS (SELECT v AS q FROM w WHERE rowid = (SELECT min(rowid) FROM w)),
n AS (SELECT rowid, {_sql_distance('cosine')} AS x FROM w, q ORDER BY x, rowid LIMIT 10),
r AS (SELECT n.rowid, x, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS line FROM n JOIN {_CHUNK} c ON c.id = n.rowid JOIN {_ARTICLE} a ON a.id = c.article_id)
SELECT row_number() OVER (ORDER BY x, rowid)::INTEGER AS rank, rowid, CASE WHEN length(line) <= 60 THEN line ELSE rtrim(substring(line, 1, 57)) || '...' END AS preview FROM r""",
)
def q_ranked(s: SparkSession, d: str) -> DataFrame:
    rows = wiki_rows(s, d)
    near = K.knn(rows, rows.agg(F.min_by("vector", "rowid")).first()[0], 10, "cosine")
    return text.ranked(near, t(s, d, "wiki_chunks").dropDuplicates(["id"]), t(s, d, "wiki_articles").dropDuplicates(["id"]), 60).select("rank", "rowid", "preview")


@query("knn_semi", f"SELECT rowid, label FROM {_E} WHERE rowid IN (SELECT rowid FROM {_NEAR} n)")
def q_semi(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20)
    return rows_of(s, d).join(F.broadcast(near), "rowid", "left_semi").select("rowid", "label")


@query("knn_anti", f"SELECT rowid, label FROM {_E} WHERE rowid NOT IN (SELECT rowid FROM {_NEAR} n)")
def q_anti(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20)
    return rows_of(s, d).join(F.broadcast(near), "rowid", "left_anti").select("rowid", "label")


@query("knn_offset", f"SELECT rowid, round(x, 6) AS distance FROM {_NEAR} n ORDER BY x DESC, rowid LIMIT 5 OFFSET 3")
def q_offset(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20)
    return near.orderBy(F.desc("distance"), "rowid").offset(3).limit(5).select("rowid", F.round("distance", 6).alias("distance"))


@query("knn_count", f"SELECT count(*) AS n, round(min(x), 6) AS nearest, round(max(x), 6) AS farthest, count(DISTINCT label) AS labels FROM {_NEAR} n")
def q_count(s: SparkSession, d: str) -> DataFrame:
    near = K.knn(rows_of(s, d), first_vector(s, d), 20, keep=["label"])
    return near.agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"), F.count_distinct("label").alias("labels"))


@query("scalar_subquery", f"SELECT rowid, round(x - (SELECT avg(x) FROM {_NEAR} m), 6) AS above FROM {_NEAR} n WHERE x >= (SELECT avg(x) FROM {_NEAR} m)")
def q_scalar(s: SparkSession, d: str) -> DataFrame:
    K.knn(rows_of(s, d), first_vector(s, d), 20).createOrReplaceTempView("vectide_near")
    return s.sql("SELECT rowid, round(distance - (SELECT avg(distance) FROM vectide_near), 6) AS above FROM vectide_near WHERE distance >= (SELECT avg(distance) FROM vectide_near)")


_PAIRS = f"(SELECT b.rowid AS qid, a.rowid, {_sql_distance('cosine', 'a.v', 'b.v')} AS x FROM {_E} a, {_E} b WHERE b.rowid % 20 = 0)"


@query("batch_knn", f"SELECT qid, rowid, round(x, 6) AS distance, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9), rowid) AS k FROM {_PAIRS} p) r WHERE k <= 10")
def q_batch(s: SparkSession, d: str) -> DataFrame:
    rows = rows_of(s, d)
    asked = rows.where("rowid % 20 = 0").select(F.col("rowid").alias("qid"), "vector")
    return K.batch_knn(rows, asked, 10, "cosine").select("qid", "rowid", F.round("distance", 6).alias("distance"), "rank")


@query("similarity_join", f"SELECT qid, rowid, round(x, 6) AS distance FROM {_PAIRS} p WHERE x <= 0.6")
def q_simjoin(s: SparkSession, d: str) -> DataFrame:
    rows = rows_of(s, d)
    asked = rows.where("rowid % 20 = 0").select(F.col("rowid").alias("qid"), "vector")
    return K.similarity_join(rows, asked, 0.6, "cosine").select("qid", "rowid", F.round("distance", 6).alias("distance"))


# Aggregates over vectors and graphs


@query("label_stats", f"SELECT label, count(*) AS n, round(min(x), 6) AS nearest, round(max(x), 6) AS farthest, round(avg(x), 6) AS mean FROM (SELECT label, {_sql_distance('l2')} AS x FROM {_E}, {_Q0}) y GROUP BY label")
def q_labels(s: SparkSession, d: str) -> DataFrame:
    rows = rows_of(s, d).withColumn("x", native.distance_l2(F.col("vector"), constant(first_vector(s, d))))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("nearest"), F.round(F.max("x"), 6).alias("farthest"), F.round(F.avg("x"), 6).alias("mean"))


@query("label_centroids", f"SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM {_E}) y GROUP BY label, pos")
def q_centroids(s: SparkSession, d: str) -> DataFrame:
    return rows_of(s, d).select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


_GRAPH = "(SELECT DISTINCT layer, node_id, neighbor_id, distance FROM v_graph)"


@query("degree_stats", f"SELECT layer, count(*) AS nodes, max(n) AS max_degree, round(avg(n), 6) AS avg_degree FROM (SELECT layer, node_id, count(*) AS n FROM {_GRAPH} g GROUP BY layer, node_id) d GROUP BY layer")
def q_degrees(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "v_graph").select("layer", "node_id", "neighbor_id", "distance").distinct()
    return metrics.degrees(g).withColumn("avg_degree", F.round("avg_degree", 6))


@query(
    "graph_integrity",
    f"""SELECT (SELECT count(*) FROM (SELECT node_id AS id FROM {_GRAPH} g UNION ALL SELECT neighbor_id FROM {_GRAPH} g) e WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM v_data)) AS orphan_ends,
(SELECT count(*) FROM {_GRAPH} g WHERE node_id = neighbor_id) AS self_edges, (SELECT count(*) FROM {_GRAPH} g WHERE distance < 0) AS negative,
(SELECT count(*) FROM (SELECT layer, node_id, count(*) AS n FROM {_GRAPH} g GROUP BY 1, 2) x WHERE n > CASE WHEN layer = 0 THEN 32 ELSE 16 END) AS over_degree,
(SELECT count(*) FROM (SELECT DISTINCT id FROM v_data) x WHERE id NOT IN (SELECT node_id FROM v_layers)) AS without_layer""",
)
def q_integrity(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "v_graph").select("layer", "node_id", "neighbor_id", "distance").distinct()
    return metrics.integrity(t(s, d, "v_data").select("id").distinct(), g, t(s, d, "v_layers"), 16, "id")


@query("entry_point", "SELECT node_id AS entry_point, max_layer FROM v_layers ORDER BY max_layer DESC, node_id LIMIT 1")
def q_entry(s: SparkSession, d: str) -> DataFrame:
    return metrics.entry_point(t(s, d, "v_layers"))


@query(
    "graph_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT node_id AS a, neighbor_id AS b FROM v_graph WHERE node_id IS NOT NULL AND neighbor_id IS NOT NULL AND node_id <> neighbor_id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, min(least(a, b)) AS root FROM u GROUP BY a UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node WHERE w.root < u.b)
SELECT node, min(root) AS root FROM w GROUP BY node""",
)
def q_components(s: SparkSession, d: str) -> DataFrame:
    return components(t(s, d, "v_graph"), "node_id", "neighbor_id")


@query(
    "recall_exact_vs_int8",
    f"""WITH p8 AS (SELECT b.rowid AS qid, a.rowid, {_sql_distance('l2', 'a.v', 'b.v')} AS x FROM {_I8ROWS} a, {_I8ROWS} b WHERE b.rowid % 20 = 0),
p AS (SELECT b.rowid AS qid, a.rowid, {_sql_distance('l2', 'a.v', 'b.v')} AS x FROM {_E} a, {_E} b WHERE b.rowid % 20 = 0),
n8 AS (SELECT qid, rowid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 6), rowid) AS k FROM p8) y WHERE k <= 10),
n AS (SELECT qid, rowid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 6), rowid) AS k FROM p) y WHERE k <= 10),
r AS (SELECT n.qid, count(n8.rowid) / 10.0::DOUBLE AS r FROM n LEFT JOIN n8 ON n.qid = n8.qid AND n.rowid = n8.rowid GROUP BY 1)
SELECT round(avg(r), 6) AS recall_mean, min(r) AS recall_min, max(r) AS recall_max FROM r""",
)
def q_recall(s: SparkSession, d: str) -> DataFrame:
    rows, small = rows_of(s, d), int8_rows(s, d)
    ask = lambda x: x.where("rowid % 20 = 0").select(F.col("rowid").alias("qid"), "vector")
    exact, coded = K.batch_knn(rows, ask(rows), 10, "l2"), K.batch_knn(small, ask(small), 10, "l2")
    return metrics.recall(coded, exact, 10).withColumn("recall_mean", F.round("recall_mean", 6))


@query("latency_percentiles", "SELECT round(min(value), 6) AS min_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS max_ms FROM events")
def q_latency(s: SparkSession, d: str) -> DataFrame:
    out = metrics.latency(t(s, d, "events"), "value")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# The text pipeline


_CHUNKS = """WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[\\s\\p{Z}]*\\n') AS ps FROM documents WHERE text IS NOT NULL) x),
w AS (SELECT doc_id, i, 0 AS k, trim(regexp_replace(raw, '[\\s\\p{Z}]+', ' ', 'g')) AS rest, '' AS line FROM p
  UNION ALL SELECT doc_id, i, k + 1, CASE WHEN length(rest) > 1200 THEN trim(substring(rest, cut_at + 1)) ELSE '' END, CASE WHEN length(rest) > 1200 THEN trim(substring(rest, 1, cut_at)) ELSE rest END
  FROM (SELECT *, CASE WHEN back > 0 AND 1201 - back >= 600 THEN 1201 - back ELSE 1200 END AS cut_at FROM (SELECT *, position(' ' IN reverse(substring(rest, 1, 1201))) AS back FROM w) y) z WHERE rest <> ''),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS j FROM w WHERE line <> ''),
g AS (SELECT doc_id, j, 0 AS c, 1200 - length(line) AS room FROM l WHERE j = 1
  UNION ALL SELECT l.doc_id, l.j, CASE WHEN length(line) + 2 <= room THEN c ELSE c + 1 END, CASE WHEN length(line) + 2 <= room THEN room - length(line) - 2 ELSE 1200 - length(line) END FROM g JOIN l ON l.doc_id = g.doc_id AND l.j = g.j + 1),
b AS (SELECT doc_id, c, string_agg(line, chr(10) || chr(10) ORDER BY j) AS body, max(c) OVER (PARTITION BY doc_id) AS top FROM g JOIN l USING (doc_id, j) GROUP BY doc_id, c),
m AS (SELECT doc_id, CASE WHEN c = top AND c > 0 AND length(body) < 200 THEN c - 1 ELSE c END AS c2, c, body FROM b),
f AS (SELECT doc_id, c2, string_agg(body, chr(10) || chr(10) ORDER BY c) AS content FROM m GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c2) - 1)::INTEGER AS chunk_index, content FROM f WHERE length(content) >= 20"""


@query("chunk_documents", _CHUNKS)
def q_chunks(s: SparkSession, d: str) -> DataFrame:
    return text.chunk(spread(t(s, d, "documents").select("doc_id", "text")))


def _strip_sql() -> str:
    """The same by repeated replacement: templates of up to three levels, then piece by piece."""
    out = "content"
    steps = [(r"\{\{[^{}]*\}\}", " ")] * 3 + [
        (r"(?s)\{\|.*?\|\}", " "),
        (r"(?s)<ref\b[^>]*>.*?</ref>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<gallery\b[^>]*>.*?</gallery>", ""),
        (r"<[^>]+>", ""),
        (r"(?i)\[\[(?:file|image|category):[^\]]+\]\]", " "),
        (r"\[\[[^|\]]+\|([^\]]+)\]\]", r"\1"),
        (r"\[\[([^\]]+)\]\]", r"\1"),
        (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"),
        (r"\[https?://[^\s\]]+\]", " "),
        (r"(?m)^=+[ \t]*([^\n]*?)[ \t]*=+$", r"\1"),
        (r"\x27\x27+", ""),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ]
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


@query("strip_markup", f"SELECT DISTINCT id, {_strip_sql()} AS plain_text FROM wiki_chunks WHERE content IS NOT NULL")
def q_strip(s: SparkSession, d: str) -> DataFrame:
    rows = spread(t(s, d, "wiki_chunks").where("content is not null").select("id", "content"))
    return rows.select("id", text.strip_markup(F.col("content")).alias("plain_text")).distinct()


@query("embed_chunks", "SELECT DISTINCT id, 64 AS dims FROM wiki_chunks WHERE content IS NOT NULL")
def q_embed(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "wiki_chunks").where("content is not null").select("id", "content").dropDuplicates(["id"])
    return text.embed(rows, text.hashed_embedding(64), 64).select("id", native.vec_dims(F.col("vector")).alias("dims"))


@query(
    "upsert_documents",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, coalesce(lang, 'und') AS lang, 'recrawl' AS source FROM documents WHERE doc_id % 3 = 0",
)
def q_upsert(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("doc_id", "lang", "source")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.lit("recrawl").alias("source"))
    return text.upsert(docs, changes, "doc_id")


@query("insert_ignore", "SELECT article_id, chunk_index, min(id) AS id FROM (SELECT DISTINCT article_id, chunk_index, id FROM wiki_chunks WHERE article_id IS NOT NULL) x GROUP BY 1, 2")
def q_ignore(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "wiki_chunks").where("article_id is not null").groupBy("article_id", "chunk_index").agg(F.min("id").alias("id"))
    return text.insert_ignore(rows.where("id % 2 = 0"), rows, ["article_id", "chunk_index"])


@query("resume_pages", "SELECT DISTINCT id FROM wiki_articles WHERE id > 100")
def q_resume(s: SparkSession, d: str) -> DataFrame:
    state = s.createDataFrame([("last_page_id", "100")], "key string, value string")
    return text.resume(t(s, d, "wiki_articles").select("id").distinct(), state, "id")


@query("lcg_vectors", "SELECT i AS rowid, list_transform(range(0, 8), lambda d: round(((((i * 1103515245::HUGEINT) + d * 12345 + 42 * 2654435761::HUGEINT) % 2147483647)::DOUBLE / 2147483647 * 2 - 1)::FLOAT::DOUBLE, 6)) AS vector FROM range(1, 1001) r(i)")
def q_lcg(s: SparkSession, d: str) -> DataFrame:
    return text.lcg_vectors(s, 1000, 8, 42).select("rowid", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


# Tables, index, plans, streams


@query("crud_snapshot", "SELECT vec_id AS rowid, round((embedding[1] + (CASE WHEN vec_id % 10 = 3 THEN 1 ELSE 0 END)::FLOAT)::DOUBLE, 5) AS head FROM embeddings WHERE vec_id % 7 <> 0")
def q_crud(s: SparkSession, d: str) -> DataFrame:
    where = f"{scratch(s)}/t"
    table = VectorTable.create(s, where, config=VecConfig(64, "l2"))
    rows = rows_of(s, d).select("rowid", "vector")
    table.insert(rows)
    table.begin()
    table.delete(where=F.col("rowid") >= 0)
    table.rollback()
    table.begin()
    table.update(rows.where("rowid % 10 = 3").withColumn("vector", F.transform("vector", lambda x: x + F.lit(1.0).cast("float"))))
    table.delete(rows.where("rowid % 7 = 0"))
    table.commit()
    return VectorTable.load(s, where).scan().select("rowid", F.round(F.col("vector")[0].cast("double"), 5).alias("head"))


@query("planner_paths", "SELECT * FROM (VALUES ('scan'), ('point rowid=7'), ('exact metric=l2 k=5 ef_search=10'), ('exact metric=cosine k=10 ef_search=10 then below=0.5')) v(plan)")
def q_plans(s: SparkSession, d: str) -> DataFrame:
    table = VectorTable.create(s, f"{scratch(s)}/t", config=VecConfig(64, "l2"))
    table.insert(rows_of(s, d).select("rowid", "vector"))
    q = first_vector(s, d)
    asked = [planner.Request(), planner.Request(rowid=7), planner.Request(query=q, matched=True, k=5), planner.Request(query=q, matched=True, metric="cosine", below=0.5)]
    return s.createDataFrame([(planner.explain(table, r),) for r in asked], "plan string")


@query("sql_search", f"SELECT rowid, round({_sql_distance('l2')}, 6) AS distance FROM {_E}, {_Q0} ORDER BY {_sql_distance('l2')}, rowid LIMIT 10")
def q_search(s: SparkSession, d: str) -> DataFrame:
    table = VectorTable.create(s, f"{scratch(s)}/t", config=VecConfig(64, "l2"))
    table.insert(rows_of(s, d).select("rowid", "vector"))
    planner.register_search(s, "demo", table)
    q = ", ".join(f"float({float(x)!r})" for x in first_vector(s, d))
    return s.sql(f"SELECT rowid, round(distance, 6) AS distance FROM vec_search_demo(array({q}), 10)")


def _built(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, VecConfig]:
    rows, config = rows_of(s, d), VecConfig(64, "l2", m=16, ef_construction=100, ef_search=64)
    return rows, cut(hnsw.build(rows, config, hnsw.shard_count(rows.count(), s.sparkContext.defaultParallelism))), config


def _searched(rows: DataFrame, built: DataFrame, config: VecConfig, residue: int = 0, ef: int | None = None, metric: str | None = None) -> DataFrame:
    """The 10 nearest found for every rowid that leaves ``residue`` divided by 20, asked block by block."""
    found = None
    for ids, x in K.query_blocks(rows.where(F.col("rowid") % 20 == residue), "rowid", "vector"):
        part = hnsw.search(built, list(zip(ids.tolist(), x, strict=True)), 10, config, ef, metric)
        found = part if found is None else found.unionByName(part)
    return hnsw.search(built, [], 10, config) if found is None else found


@query("ann_hnsw_topk")
def q_hnsw(s: SparkSession, d: str) -> DataFrame:
    rows, built, config = _built(s, d)
    return _searched(rows, built, config).select("qid", "rowid", F.round("distance", 6).alias("distance"))


@query("hnsw_recall", "SELECT count(*) AS n_queries, true AS at_least_090 FROM embeddings WHERE vec_id % 20 = 0")
def q_hnsw_recall(s: SparkSession, d: str) -> DataFrame:
    rows, built, config = _built(s, d)
    ask = rows.where("rowid % 20 = 0")
    found = _searched(rows, built, config)
    exact = K.batch_knn(rows, ask.select(F.col("rowid").alias("qid"), "vector"), 10, "l2")
    return metrics.recall(found, exact, 10).select(F.lit(ask.count()).cast("long").alias("n_queries"), (F.col("recall_mean") >= 0.9).alias("at_least_090"))


@query("hnsw_integrity", "SELECT 0::BIGINT AS orphan_ends, 0::BIGINT AS self_edges, 0::BIGINT AS negative, 0::BIGINT AS over_degree, 0::BIGINT AS without_layer")
def q_hnsw_integrity(s: SparkSession, d: str) -> DataFrame:
    rows, built, config = _built(s, d)
    return metrics.integrity(rows, hnsw.edges(built), hnsw.layers(built), config.m)


_ALL10 = """SELECT qid, rowid, round(x, 6) AS distance, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9), rowid) AS k FROM
(SELECT b.rowid AS qid, a.rowid, {distance} AS x FROM {rows} a, {rows} b WHERE b.rowid % 20 = 1 AND {which}) p) r WHERE k <= 10"""


def _widely(s: SparkSession, rows: DataFrame, built: DataFrame, config: VecConfig, metric: str | None = None) -> DataFrame:
    """The graph's 10 nearest of every rowid that leaves 1 divided by 20, with a beam as wide as the table."""
    found = _searched(rows, built, config, 1, rows.count(), metric)
    return found.selectExpr("qid", "rowid", "round(distance, 6) distance", "cast(row_number() over (partition by qid order by round(distance, 9), rowid) as int) rank")


@query("graph_metric_override", _ALL10.format(distance=_sql_distance("cosine", "a.v", "b.v"), rows=_E, which="true"))
def q_override(s: SparkSession, d: str) -> DataFrame:
    """The graph of one metric walked by another."""
    rows, built, config = _built(s, d)
    return _widely(s, rows, built, config, "cosine")


@query("graph_after_deletes", _ALL10.format(distance=_sql_distance("l2", "a.v", "b.v"), rows=_E, which="a.rowid % 5 <> 0"))
def q_repaired(s: SparkSession, d: str) -> DataFrame:
    """The graph after a fifth of its nodes has gone and their neighbours were joined anew."""
    rows, built, config = _built(s, d)
    shards = hnsw.shard_count(rows.count(), s.sparkContext.defaultParallelism)
    return _widely(s, rows, cut(hnsw.refresh(rows.where("rowid % 5 <> 0"), built, config, shards)), config)


_ALIASES = {**{m: _sql_distance(METRICS[m]) for m in METRICS if METRICS[m] in _D}, **{m: _FLOAT_BITS[m].replace("embedding", "e") for m in _FLOAT_BITS}}


@query(
    "metric_aliases",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round({sql}, 6) AS distance FROM (SELECT embedding AS e, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1) a, (SELECT embedding{'' if m in _FLOAT_BITS else '::DOUBLE[]'} AS q FROM embeddings WHERE vec_id = 0) b" for m, sql in _ALIASES.items()),
)
def q_aliases(s: SparkSession, d: str) -> DataFrame:
    one, q = rows_of(s, d).where("rowid = 1"), first_vector(s, d)
    parts = [K.within(one, q, float("inf"), m).select(F.lit(m).alias("metric"), F.round("distance", 6).alias("distance")) for m in METRICS]
    return reduce(DataFrame.unionByName, parts)


@query(
    "table_lifecycle",
    """SELECT 'data' AS part, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'layers', count(*)::VARCHAR FROM embeddings UNION ALL SELECT 'count', count(*)::VARCHAR FROM embeddings
UNION ALL SELECT 'least_edge_end', min(vec_id)::VARCHAR FROM embeddings UNION ALL SELECT * FROM (VALUES ('dims', '64'), ('metric', 'l2'), ('type', 'float32'), ('m', '16'), ('old name', 'gone'), ('dropped', 'gone')) v""",
)
def q_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """A table made, filled, renamed and looked at through its views; another one dropped."""
    base = scratch(s)
    made = VectorTable.create(s, f"{base}/a", config=VecConfig(64, "l2", ef_construction=60))
    made.insert(rows_of(s, d).select("rowid", "vector"))
    table = made.rename("b")
    table.views("vectide_life")
    other = VectorTable.create(s, f"{base}/c", config=VecConfig(64))
    other.drop()
    state = [(n, "there" if p.exists() else "gone") for n, p in (("old name", made.path), ("dropped", other.path))]
    counts = s.sql(
        "SELECT 'data' AS part, cast(count(*) AS string) AS value FROM vectide_life_data UNION ALL SELECT 'layers', cast(count(*) AS string) FROM vectide_life_layers "
        "UNION ALL SELECT 'least_edge_end', cast(min(least(node_id, neighbor_id)) AS string) FROM vectide_life_graph UNION ALL SELECT key, value FROM vectide_life_config WHERE key IN ('dims', 'metric', 'type', 'm', 'count')"
    )
    return counts.unionByName(s.createDataFrame(state, "part string, value string"))


@query("xml_pages", "SELECT DISTINCT id AS page_id, trim(title) AS title, 'Text of ' || id AS body FROM wiki_articles WHERE trim(title) <> '' AND id % 7 <> 0 AND id % 5 <> 0")
def q_pages(s: SparkSession, d: str) -> DataFrame:
    """Articles written as a compressed dump with redirects and other namespaces, and read again."""
    where = f"{scratch(s)}/dump"
    ns, moved = F.when(F.col("id") % 5 == 0, "1").otherwise("0"), F.when(F.col("id") % 7 == 0, F.struct(F.col("title").alias("_title")))
    pages = t(s, d, "wiki_articles").where("trim(title) <> ''").select("id", "title").distinct()
    out = pages.select("title", ns.alias("ns"), "id", moved.alias("redirect"), F.struct(F.concat(F.lit("Text of "), "id").alias("text")).alias("revision"))
    out.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(where)
    return read_pages(s, where).select("page_id", F.trim("title").alias("title"), F.col("text").alias("body"))


@query("result_sinks", f"SELECT 'csv' AS sink, 2 * count(*) AS n, round(2 * sum(round(x, 6)), 4) AS total FROM {_NEAR} n UNION ALL SELECT 'json', count(*), round(sum(round(x, 6)), 4) FROM {_NEAR} n")
def q_sinks(s: SparkSession, d: str) -> DataFrame:
    """Results appended to CSV twice and written as JSON twice, read again."""
    base, near = scratch(s), K.knn(rows_of(s, d), first_vector(s, d), 20).select("rowid", F.round("distance", 6).alias("distance"))
    for _ in range(2):
        append_csv(near, f"{base}/csv")
        write_json(near, f"{base}/json")
    csv = s.read.option("header", True).schema("rowid long, distance double").csv(f"{base}/csv")
    both = csv.withColumn("sink", F.lit("csv")).unionByName(s.read.schema("rowid long, distance double").json(f"{base}/json").withColumn("sink", F.lit("json")))
    return both.groupBy("sink").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("total"))


@query("create_as_select", f"SELECT rowid, label, round(x, 6) AS distance FROM {_NEAR} n")
def q_ctas(s: SparkSession, d: str) -> DataFrame:
    where = f"{scratch(s)}/near"
    K.knn(rows_of(s, d), first_vector(s, d), 20, keep=["label"]).write.parquet(where)
    s.read.parquet(where).createOrReplaceTempView("vectide_ctas")
    return s.sql("SELECT rowid, label, round(distance, 6) AS distance FROM vectide_ctas")


@query("knn_ef_search", f"SELECT rowid, round(x, 6) AS distance FROM (SELECT rowid, {_sql_distance('l2')} AS x FROM {_E}, {_Q0} ORDER BY x, rowid LIMIT 7) n")
def q_ef(s: SparkSession, d: str) -> DataFrame:
    table = VectorTable.create(s, f"{scratch(s)}/t", config=VecConfig(64, "l2"))
    table.insert(rows_of(s, d).select("rowid", "vector"))
    r = planner.Request(query=first_vector(s, d), matched=True, ef_search=7)
    return planner.run(table, r).select("rowid", F.round("distance", 6).alias("distance"))


@query("ann_lsh_topk")
def q_lsh(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = rows_of(s, d).select("rowid", array_to_vector("vector").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=8, seed=42).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(first_vector(s, d).astype(float)), 10)
    return near.select("rowid", F.round("distCol", 6).alias("distance"))


@query("ann_minhash_topk", f"SELECT row_number() OVER (ORDER BY distance)::INTEGER AS rank, distance FROM (SELECT {_BITS['jaccard']} AS distance FROM {_SIGNS} x, (SELECT b AS q FROM {_SIGNS} y WHERE rowid = 0) z ORDER BY 1 LIMIT 10) n")
def q_minhash(s: SparkSession, d: str) -> DataFrame:
    """The distances of the 10 nearest sets of positive elements, found through MinHash tables."""
    from pyspark.ml.feature import MinHashLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    signs = rows_of(s, d).select("rowid", F.transform("vector", lambda x: (x > 0).cast("double")).alias("signs"))
    rows = signs.where(F.exists("signs", lambda x: x > 0)).select("rowid", array_to_vector("signs").alias("features"))
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=24, seed=42).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense((first_vector(s, d) > 0).astype(float)), 10)
    return near.selectExpr("cast(row_number() over (order by distCol) as int) rank", "round(distCol, 6) distance")


@query("stream_insert", "SELECT count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings")
def q_stream(s: SparkSession, d: str) -> DataFrame:
    from .streaming.ingest import insert_stream

    base = scratch(s)
    rows_of(s, d).select("rowid", "vector").write.parquet(f"{base}/in")
    table = VectorTable.create(s, f"{base}/t", config=VecConfig(64, "l2"))
    insert_stream(s.readStream.schema("rowid long, vector array<float>").parquet(f"{base}/in"), table, f"{base}/c").awaitTermination()
    return VectorTable.load(s, f"{base}/t").scan().agg(F.count("*").alias("n"), F.min("rowid").alias("first_id"), F.max("rowid").alias("last_id"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_windows(s: SparkSession, d: str) -> DataFrame:
    from .streaming.ingest import windowed_counts

    return windowed_counts(t(s, d, "events"), "ts", ["event_type"])


# References that fail


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans.failing({n: t(s, d, n) for n in ("wiki_chunks", "wiki_articles", "v_graph", "v_data", "v_layers")})


_FOUND = """
WITH refs AS (
  SELECT 'wiki_chunks' AS ref_table, 'article_id' AS ref_field, strftime(written_at, '%Y-%m') AS ref_month, article_id AS ref_key, loaded_at, 'wiki_articles' AS parent FROM wiki_chunks
  UNION ALL SELECT 'v_graph', 'node_id', strftime(written_at, '%Y-%m'), node_id, loaded_at, 'v_data' FROM v_graph
  UNION ALL SELECT 'v_graph', 'neighbor_id', strftime(written_at, '%Y-%m'), neighbor_id, loaded_at, 'v_data' FROM v_graph
  UNION ALL SELECT 'v_data', 'id', strftime(written_at, '%Y-%m'), id, loaded_at, 'v_layers' FROM v_data WHERE deleted_at IS NULL),
parents AS (
  SELECT 'wiki_articles' AS parent, id AS k, min(loaded_at) AS first_loaded, bool_or(deleted_at IS NOT NULL) AS gone FROM wiki_articles GROUP BY id
  UNION ALL SELECT 'v_data', id, min(loaded_at), bool_or(deleted_at IS NOT NULL) FROM v_data GROUP BY id
  UNION ALL SELECT 'v_layers', node_id, min(loaded_at), false FROM v_layers GROUP BY node_id),
states AS (
  SELECT ref_table, ref_field, ref_month, ref_key,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_loaded > r.loaded_at THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN parents p ON r.parent = p.parent AND r.ref_key = p.k WHERE ref_key IS NOT NULL)
SELECT DISTINCT ref_table, ref_field, ref_month, ref_key, ref_state FROM states WHERE ref_state IS NOT NULL"""


@query("p3_found", _FOUND)
def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _orphans(s, d)


@query("p3_counts", f"SELECT ref_table, ref_field, ref_month, ref_state, count(*) AS n_keys FROM ({_FOUND}) f GROUP BY ALL")
def p3_counts(s: SparkSession, d: str) -> DataFrame:
    return orphans.counts(_orphans(s, d))
