"""Exact nearest neighbours: one query, many queries, thresholds and similarity joins.

The corpus is scanned once with two columns (id, vector) as Arrow batches; each task keeps
its own k best per query, so what leaves a task is k rows a query, whatever the corpus size.
A few blocks of queries are broadcast behind a check of their size; a larger set is spread by
a shuffle. Ties go to the smaller id. Pairs are never listed:
a similarity join against a corpus keeps only pairs within its threshold.

Null vectors are no candidates; a query of another size than the corpus is an error; a null
query returns no rows. Extra columns may be carried along with ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import check_k, metric_name
from ..functions.kernels import KERNELS, pairwise

#: Queries of one broadcast block, and elements of one: 4096 * 8192 floats are 128 MB.
BLOCK = 4096
BLOCK_ELEMENTS = 1 << 25
#: So many blocks of queries are broadcast; more are grouped by a shuffle. Pairs of one matrix product.
DIRECT, PAIRS = 4, 1 << 22
#: The id of a neighbour that is missing.
NONE = np.iinfo(np.int64).max


def vectors_of(batch: pa.RecordBatch, dims: int, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the (n, dims) block of a batch's rows with vectors; another size is an error."""
    col = batch.column(column)
    if col.null_count:
        batch = batch.filter(pc.is_valid(col))
        col = batch.column(column)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        rows = [np.frombuffer(x, np.uint8) for x in col.to_pylist()]
        if any(len(r) != dims for r in rows):
            raise ValueError(f"vec0: query has {dims} bytes, table has another size")
        return ids, np.stack(rows) if rows else np.zeros((0, dims), np.uint8)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(col.offsets.to_numpy())
    if (sizes != dims).any():
        raise ValueError(f"vec0: query has {dims} dims, table has {int(sizes[sizes != dims][0])}")
    return ids, flat.reshape(len(ids), dims)


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, ties by id."""
    if len(d) > k:
        edge = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= edge)
    else:
        near = np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))][:k]


def knn(
    corpus: DataFrame, query: Sequence[float] | bytes | None, k: int | None = None, metric: str = "cosine", key: str = "rowid", vector: str = "vector",
    prefilter: Column | None = None, ef_search: int = 10, keep: Sequence[str] = (),
) -> DataFrame:
    """(key, distance, *keep) of the k nearest rows, nearest first. ``prefilter`` is applied before the search."""
    k = check_k(k, ef_search)
    kernel = KERNELS[metric_name(metric)]
    rows = corpus if prefilter is None else corpus.where(prefilter)
    schema = f"{key} long, distance double"
    if query is None:
        return rows.sparkSession.createDataFrame([], schema)
    q = np.frombuffer(query, np.uint8) if isinstance(query, (bytes, bytearray)) else np.asarray(query, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            ids, x = vectors_of(batch, len(q))
            d = np.concatenate([best_d, kernel(x, q.astype(x.dtype) if x.dtype != np.float32 else q)])
            i = np.concatenate([best_i, ids.astype(np.int64)])
            at = _best(d, i, k)
            best_d, best_i = d[at], i[at]
        yield pa.record_batch([pa.array(best_i), pa.array(best_d)], names=[key, "distance"])

    near = rows.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, schema).orderBy("distance", key).limit(k)
    if not keep:
        return near
    return near.join(rows.select(F.col(key), *keep), key).orderBy("distance", key)


def threshold(near: DataFrame, above: float | None = None, below: float | None = None, closed: str = "both") -> DataFrame:
    """Filters the k nearest by distance afterwards; fewer than k rows may stay. ``closed``: both, low, high or none."""
    d = F.col("distance")
    if above is not None:
        near = near.where(d >= above if closed in ("both", "low") else d > above)
    if below is not None:
        near = near.where(d <= below if closed in ("both", "high") else d < below)
    return near


def within(corpus: DataFrame, query: Sequence[float], radius: float, metric: str = "l2", key: str = "rowid", vector: str = "vector") -> DataFrame:
    """All rows whose distance is at most ``radius``: a range search, without a limit."""
    kernel, q = KERNELS[metric_name(metric)], np.asarray(query, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors_of(batch, len(q))
            d = kernel(x, q)
            yield pa.record_batch([pa.array(ids[d <= radius].astype(np.int64)), pa.array(d[d <= radius])], names=[key, "distance"])

    return corpus.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"{key} long, distance double")


def query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries as (ids, vectors) blocks of bounded size, streamed through the driver one at a time."""
    ids, rows = [], []
    for r in queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v")).where("v is not null").toLocalIterator():
        ids.append(r["q"])
        rows.append(np.frombuffer(r["v"], np.uint8) if isinstance(r["v"], (bytes, bytearray)) else np.asarray(r["v"], np.float32))
        if len(ids) >= BLOCK or len(ids) * len(rows[0]) >= BLOCK_ELEMENTS:
            yield np.array(ids, np.int64), np.stack(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.stack(rows)


def _nearest_of_each(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row with their ids, ties by id; missing ones have id ``NONE``."""
    d = np.where(np.isnan(d), np.inf, d)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
    r, c = np.nonzero(d <= edge)
    order = np.lexsort((i[r, c], d[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
    best_d, best_i = np.full((len(d), k), np.inf), np.full((len(d), k), NONE)
    best_d[r, rank], best_i[r, rank] = d[r, c], i[r, c]
    return best_d, best_i


class _Nearest:
    """The k nearest corpus rows of each query of a block."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, metric: str, k: int, skip_self: bool) -> None:
        self.qid, self.q, self.metric, self.k, self.skip_self = qid, q, metric, k, skip_self
        self.d, self.i = np.full((len(qid), k), np.inf), np.full((len(qid), k), NONE)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        d, i = pairwise(self.metric, self.q, x), np.broadcast_to(ids[None, :], (len(self.qid), len(ids)))
        if self.skip_self:
            own = self.qid[:, None] == i
            d, i = np.where(own, np.inf, d), np.where(own, NONE, i)
        self.d, self.i = _nearest_of_each(np.concatenate([self.d, d], axis=1), np.concatenate([self.i, i], axis=1), self.k)

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.i != NONE)
        return self.qid[r], self.i[r, c], self.d[r, c]


class _Within:
    """The corpus rows within a radius of each query of a block."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, metric: str, radius: float) -> None:
        self.qid, self.q, self.metric, self.radius = qid, q, metric, radius

    def see(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = pairwise(self.metric, self.q, x)
        r, c = np.nonzero(d <= self.radius)
        return self.qid[r], ids[c], d[r, c]

    def end(self) -> None:
        return None


def _against(corpus: DataFrame, queries: DataFrame, make, key: str, vector: str, query_key: str, query_vector: str) -> DataFrame:
    """(query_key, key, distance) rows that ``make(qid, q)`` gives for blocks of queries and all corpus rows.

    Up to ``DIRECT`` blocks are broadcast one after another, each with a scan of the corpus.
    More are grouped by a shuffle: a task holds one block of queries and streams a slice of
    the corpus past it, so no query goes through the driver.
    """
    spark = corpus.sparkSession
    schema = f"{query_key} long, {key} long, distance double"
    asked = queries.select(F.col(query_key).cast("long").alias("id"), F.col(query_vector).alias("v")).where("v is not null")
    rows = corpus.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    names = [query_key, key, "distance"]

    def stream(held, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // max(len(held.qid), 1))
        for lo in range(0, len(ids), step):
            got = held.see(ids[lo : lo + step], x[lo : lo + step])
            if got is not None:
                yield pa.record_batch([pa.array(c) for c in got], names=names)

    def finish(held) -> Iterator[pa.RecordBatch]:
        if held is not None and (got := held.end()) is not None:
            yield pa.record_batch([pa.array(c) for c in got], names=names)

    n = asked.count()
    if n <= DIRECT * BLOCK:
        every = None
        for block in query_blocks(asked, "id", "v"):
            shared = spark.sparkContext.broadcast(block)

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                held = make(*shared.value)
                for batch in batches:
                    ids, x = vectors_of(batch, held.q.shape[1])
                    yield from stream(held, ids.astype(np.int64), x)
                yield from finish(held)

            part = rows.mapInArrow(scan, schema)
            every = part if every is None else every.unionByName(part)
        return spark.createDataFrame([], schema) if every is None else every
    groups = -(-n // BLOCK)
    slices = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    block = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    ours = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), "id", "v").select((block * slices + F.col("s")).alias("part"), F.lit(0).alias("kind"), "id", "v")
    theirs = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "v").select((F.col("g") * slices + F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).alias("part"), F.lit(1).alias("kind"), "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, waiting = None, None, []
        for batch in batches:
            tags = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if tags[a] // 2 != current:
                    yield from finish(held)
                    current, held, waiting = tags[a] // 2, None, []
                piece = batch.slice(a, b - a).select([2, 3])
                if tags[a] % 2 == 0:
                    waiting.append(piece)
                    continue
                if waiting:
                    first = waiting[0].column(1)[0].as_py()
                    parts = [vectors_of(w, len(first)) for w in waiting]
                    held, waiting = make(np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])), []
                if held is not None:
                    ids, x = vectors_of(piece, held.q.shape[1])
                    yield from stream(held, ids.astype(np.int64), x)
        yield from finish(held)

    return ours.unionByName(theirs).repartitionById(groups * slices, "part").sortWithinPartitions("part", "kind").mapInArrow(meet, schema)


def batch_knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "rowid", vector: str = "vector", query_key: str = "qid", query_vector: str = "vector", skip_self: bool = False) -> DataFrame:
    """(query_key, key, distance, rank) of the k nearest rows of every query."""
    k, metric = check_k(k, 10), metric_name(metric)
    near = _against(corpus, queries, partial(_Nearest, metric=metric, k=k, skip_self=skip_self), key, vector, query_key, query_vector)
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_join(corpus: DataFrame, queries: DataFrame, radius: float, metric: str = "cosine", key: str = "rowid", vector: str = "vector", query_key: str = "qid", query_vector: str = "vector") -> DataFrame:
    """(query_key, key, distance) of all pairs within ``radius``."""
    return _against(corpus, queries, partial(_Within, metric=metric_name(metric), radius=radius), key, vector, query_key, query_vector)
