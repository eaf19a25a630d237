"""Which way a request goes, and why: scan, point lookup, exact search or graph search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import check_ef, check_k
from ..functions.parse import parse_f32
from ..functions.register import register
from ..operators.knn import threshold
from ..sources.table import VectorTable


@dataclass(frozen=True)
class Request:
    """A read of one table. A distance bound filters the nearest afterwards and never reaches below the search."""

    rowid: int | None = None
    query: str | Sequence[float] | None = None
    matched: bool = False
    metric: str | None = None
    k: int | None = None
    ef_search: int | None = None
    above: float | None = None
    below: float | None = None
    closed: str = "both"
    prefilter: Column | None = None
    mode: str = "auto"


def path(table: VectorTable, r: Request) -> str:
    """``exact``, ``graph``, ``point`` or ``scan``. A search goes before an id, an id before a scan.

    One query is exact unless the graph is asked for: a graph holds several times the bytes of
    its vectors and is read for every search, so one exact pass is always less work. Filtered
    rows are searched exactly, whatever the mode.
    """
    if r.matched or r.query is not None:
        return "graph" if r.mode == "graph" and r.prefilter is None else "exact"
    return "point" if r.rowid is not None else "scan"


def run(table: VectorTable, r: Request) -> DataFrame:
    """The rows of a request."""
    way = path(table, r)
    if way == "point":
        return table.point(r.rowid)
    if way == "scan":
        return table.scan()
    if way == "graph" and r.query is not None:
        q = parse_f32(r.query) if isinstance(r.query, str) else r.query
        table.query_block(q)
        near = table.match_indexed([(0, q)], r.k, r.ef_search, r.metric).drop("qid").orderBy("distance", "rowid")
    else:
        near = table.match(r.query, r.k, r.ef_search, r.metric, r.prefilter)
    near = threshold(near, r.above, r.below, r.closed)
    return near if r.rowid is None else near.where(F.col("rowid") == r.rowid)


def explain(table: VectorTable, r: Request) -> str:
    """One line: the way taken and the options that shape it."""
    way = path(table, r)
    if way in ("scan", "point"):
        return way + (f" rowid={r.rowid}" if way == "point" else "")
    ef = check_ef(r.ef_search, table.config.ef_search)
    bounds = [f"{n}={v}" for n, v in (("above", r.above), ("below", r.below)) if v is not None]
    return " ".join([way, f"metric={r.metric or table.config.metric}", f"k={check_k(r.k, ef)}", f"ef_search={ef}", *(["prefilter"] if r.prefilter is not None else []), *(["then", *bounds] if bounds else [])])


def register_search(spark: SparkSession, name: str, table: VectorTable, prefix: str = "vec") -> None:
    """Makes ``vec_search_<name>(query, k)`` known to SQL: a table function of (rowid, distance).

    It inlines to a sort of distances over the table's view, so the optimizer sees it whole;
    the bit metrics go through their Arrow functions. The query of a bit table is a blob.
    """
    table.stored().createOrReplaceTempView(f"{prefix}_{name}_rows")
    metric, bits = table.config.metric, table.config.type == "bit"
    own, theirs = (f"sqrt(aggregate({v}, 0D, (s, e) -> s + double(e) * double(e)))" for v in ("vector", "q"))
    body = {
        "l2": "sqrt(aggregate(zip_with(vector, q, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, e) -> s + e))",
        "ip": "-aggregate(zip_with(vector, q, (x, y) -> double(x) * double(y)), 0D, (s, e) -> s + e)",
        "l1": "aggregate(zip_with(vector, q, (x, y) -> abs(double(x) - double(y))), 0D, (s, e) -> s + e)",
        "cosine": f"CASE WHEN {own} = 0 AND {theirs} = 0 THEN 0D WHEN {own} = 0 OR {theirs} = 0 THEN 1D ELSE greatest(0D, 1 - aggregate(zip_with(vector, q, (x, y) -> double(x) * double(y)), 0D, (s, e) -> s + e) / ({own} * {theirs})) END",
        "hamming": f"vec_distance_hamming{'_bit' * bits}(vector, q)",
        "jaccard": f"vec_distance_jaccard{'_bit' * bits}(vector, q)",
    }
    if metric in ("hamming", "jaccard"):
        register(spark)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_search_{name}(q {'BINARY' if bits else 'ARRAY<FLOAT>'}, k INT) RETURNS TABLE (rowid BIGINT, distance DOUBLE) "
        f"RETURN SELECT rowid, distance FROM (SELECT rowid, distance, row_number() OVER (ORDER BY distance, rowid) AS n FROM (SELECT rowid, {body[metric]} AS distance FROM {prefix}_{name}_rows)) WHERE n <= k"
    )
