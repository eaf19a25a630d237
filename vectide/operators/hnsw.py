"""A sharded proximity graph (HNSW): built, changed and searched by executors, one graph per shard.

Rows are spread over shards by the hash of their id. A shard's graph is built in one task
from a seeded generator, so builds repeat exactly, and is kept as rows (shard, layer, node_id,
neighbor_id, distance, vector): edges, and a row of layer -1 a node with its top layer as
neighbor_id and its stored vector. The rows of a shard lie together in one partition, or in
one file, so a search reads each shard in place and shuffles only the shards' k nearest.

``refresh`` brings shards up to changed rows: nodes that are gone leave, each node that lost a
neighbour is searched for anew and joined again, and new nodes are added. ``SHARD_ROWS`` and
``SHARD_BYTES`` bound a shard, so no group grows with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import VecConfig, check_ef, check_k, check_metric
from ..functions.kernels import KERNELS, store

SHARD_ROWS, SHARD_BYTES, LEAST_ROWS = 20_000, 64 << 20, 250
#: Share of changed nodes from which a shard is built anew.
REBUILD = 0.3
GRAPH = "shard int, layer int, node_id long, neighbor_id long, distance double, vector binary"
COLUMNS = ["shard", "layer", "node_id", "neighbor_id", "distance", "vector"]
TYPES = {"float32": np.float32, "int8": np.int8, "bit": np.uint8}


@dataclass
class Graph:
    """One shard's layers: for each layer, the neighbours of each node by position."""

    x: np.ndarray
    metric: str
    m: int
    layers: list[dict[int, list[tuple[float, int]]]] = field(default_factory=list)
    entry: int = -1

    def distances(self, q: np.ndarray, at: list[int]) -> list[float]:
        return KERNELS[self.metric](self.x[at], q).tolist() if at else []

    def beam(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes met by best-first search from the starts, nearest first."""
        links = self.layers[layer]
        seen = set(starts)
        front = sorted(zip(self.distances(q, starts), starts, strict=True))
        kept = [(-d, -i) for d, i in front]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while front:
            d, i = heapq.heappop(front)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = [j for _, j in links.get(i, ()) if j not in seen]
            seen.update(fresh)
            for dj, j in zip(self.distances(q, fresh), fresh, strict=True):
                if len(kept) < ef or dj < -kept[0][0]:
                    heapq.heappush(front, (dj, j))
                    heapq.heappush(kept, (-dj, -j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -i) for d, i in kept)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(ef, k), 0)[:k]

    def link(self, i: int, near: list[tuple[float, int]], layer: int) -> None:
        """Joins node i to its nearest in a layer; a neighbour with too many keeps its nearest."""
        most = 2 * self.m if layer == 0 else self.m
        links = self.layers[layer]
        links[i] = near[:most]
        for d, j in links[i]:
            own = links.setdefault(j, [])
            if all(n != i for _, n in own):
                own.append((d, i))
            if len(own) > most:
                own.sort()
                del own[most:]

    def add(self, i: int, level: int, ef: int) -> None:
        q = self.x[i]
        if self.entry < 0:
            self.layers = [{i: []} for _ in range(level + 1)]
            self.entry = i
            return
        at = [self.entry]
        for layer in range(len(self.layers) - 1, level, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        for layer in range(min(level, len(self.layers) - 1), -1, -1):
            near = self.beam(q, at, ef, layer)
            self.link(i, near, layer)
            at = [j for _, j in near]
        if level >= len(self.layers):
            self.layers += [{i: []} for _ in range(level + 1 - len(self.layers))]
            self.entry = i


    def remove(self, gone: set[int], ef: int) -> None:
        """Takes nodes out and joins those that lost a neighbour anew, from the entry down."""
        hurt = []
        for layer, links in enumerate(self.layers):
            for i in gone:
                links.pop(i, None)
            for j, near in links.items():
                kept = [(d, n) for d, n in near if n not in gone]
                if len(kept) < len(near):
                    links[j] = kept
                    hurt.append((layer, j))
        while self.layers and not self.layers[-1]:
            self.layers.pop()
        self.entry = min(self.layers[-1]) if self.layers else -1
        for layer, j in sorted(hurt, reverse=True):
            at = [self.entry]
            for above in range(len(self.layers) - 1, layer, -1):
                at = [self.beam(self.x[j], at, 1, above)[0][1]]
            near = {n: d for d, n in [*self.beam(self.x[j], at, ef, layer), *self.layers[layer][j]] if n != j}
            self.link(j, sorted((d, n) for n, d in near.items()), layer)

    def moved(self, place: dict[int, int], x: np.ndarray) -> Graph:
        """The same graph over other positions."""
        layers = [{place[i]: [(d, place[n]) for d, n in near] for i, near in links.items()} for links in self.layers]
        return Graph(x, self.metric, self.m, layers, place.get(self.entry, -1))

    def rows(self, shard: int, ids: np.ndarray) -> pd.DataFrame:
        """The graph as GRAPH rows."""
        tops: dict[int, int] = {i: layer for layer, links in enumerate(self.layers) for i in links}
        out = [(shard, layer, ids[i], ids[j], d, None) for layer, links in enumerate(self.layers) for i, near in links.items() for d, j in near]
        return pd.DataFrame(out + [(shard, -1, ids[i], top, 0.0, self.x[i].tobytes()) for i, top in tops.items()], columns=COLUMNS)

    @staticmethod
    def of(pdf: pd.DataFrame, config: VecConfig, metric: str | None = None) -> tuple[np.ndarray, Graph]:
        """The ids and the graph of one shard's rows."""
        tops = pdf[pdf["layer"] == -1].sort_values("node_id")
        ids, top = tops["node_id"].to_numpy(np.int64), tops["neighbor_id"].to_numpy(np.int64)
        g = Graph(np.frombuffer(b"".join(tops["vector"]), TYPES[config.type]).reshape(len(ids), -1), metric or config.metric, config.m)
        g.layers = [{i: [] for i in np.flatnonzero(top >= layer).tolist()} for layer in range(int(top.max()) + 1 if len(top) else 0)]
        links = pdf[pdf["layer"] >= 0]
        for layer, i, j, d in zip(links["layer"], np.searchsorted(ids, links["node_id"]).tolist(), np.searchsorted(ids, links["neighbor_id"]).tolist(), links["distance"], strict=True):
            g.layers[layer][i].append((d, j))
        g.entry = int(top.argmax()) if len(top) else -1
        return ids, g


def levels(r: np.random.Generator, n: int, m: int) -> list[int]:
    return np.floor(-np.log(1.0 - r.random(n)) / np.log(m)).astype(int).tolist()


def build_graph(x: np.ndarray, config: VecConfig, seed: int) -> Graph:
    """The graph over stored rows."""
    g = Graph(x, config.metric, config.m)
    for i, level in enumerate(levels(np.random.default_rng(seed), len(x), config.m)):
        g.add(i, level, config.ef_construction)
    return g


def stored(df_vectors: pd.Series, kind: str) -> np.ndarray:
    """A column of float arrays (or already stored blobs) as a storage block."""
    rows = df_vectors.tolist()
    if rows and isinstance(rows[0], (bytes, bytearray)):
        return np.stack([np.frombuffer(v, np.uint8) for v in rows])
    return store(np.stack([np.asarray(v, np.float32) for v in rows]), kind) if rows else np.zeros((0, 1), np.float32)


def with_shards(rows: DataFrame, shards: int, key: str = "rowid") -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def shard_count(rows: int, cores: int = 1, dims: int = 64) -> int:
    """As many shards as ``SHARD_ROWS`` and ``SHARD_BYTES`` ask for, and up to one a core while each has ``LEAST_ROWS``."""
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * dims)))
    return max(1, -(-rows // most), min(cores, rows // LEAST_ROWS))


def _placed(rows: DataFrame, shards: int, key: str, vector: str) -> DataFrame:
    return with_shards(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null"), shards, "id")


def build(rows: DataFrame, config: VecConfig, shards: int, seed: int = 42, key: str = "rowid", vector: str = "vector") -> DataFrame:
    """GRAPH rows of every shard's graph, each shard's rows together."""

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return build_graph(stored(pdf["v"], config.type), config, seed + int(key_[0])).rows(key_[0], pdf["id"].to_numpy(np.int64))

    return _placed(rows, shards, key, vector).groupBy("shard").applyInPandas(run, GRAPH)


def refresh(rows: DataFrame, built: DataFrame, config: VecConfig, shards: int, seed: int = 42, key: str = "rowid", vector: str = "vector") -> DataFrame:
    """The graphs of ``built`` brought up to ``rows``, which hold all rows of these shards."""

    def run(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard, left = key_[0], left.sort_values("id")
        ids, x = left["id"].to_numpy(np.int64), stored(left["v"], config.type)
        if not len(ids):
            return pd.DataFrame({c: [] for c in COLUMNS})
        old, g = Graph.of(right, config)
        at = {i: k for k, i in enumerate(ids.tolist())}
        same = {k for k, i in enumerate(old.tolist()) if i in at and g.x[k].tobytes() == x[at[i]].tobytes()}
        fresh = sorted(set(range(len(ids))) - {at[int(old[k])] for k in same})
        if len(old) - len(same) + len(fresh) > REBUILD * len(ids):
            return build_graph(x, config, seed + int(shard)).rows(shard, ids)
        g.remove(set(range(len(old))) - same, config.ef_construction)
        g = g.moved({k: at[int(old[k])] for k in same}, x)
        for i, level in zip(fresh, levels(np.random.default_rng([seed, int(shard), len(ids), len(fresh)]), len(fresh), config.m), strict=True):
            g.add(i, level, config.ef_construction)
        return g.rows(shard, ids)

    return _placed(rows, shards, key, vector).groupBy("shard").cogroup(built.groupBy("shard")).applyInPandas(run, GRAPH)


def edges(built: DataFrame) -> DataFrame:
    return built.where("layer >= 0").drop("vector")


def layers(built: DataFrame) -> DataFrame:
    return built.where("layer = -1").select("shard", "node_id", F.col("neighbor_id").cast("int").alias("max_layer"))


def search(built: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, config: VecConfig, ef: int | None = None, metric: str | None = None) -> DataFrame:
    """(qid, rowid, distance) of the k nearest found for each query. ``metric`` overrides the table's while walking its graph.

    ``built`` is read as it lies: every shard's rows together, as ``build``, ``refresh`` and a table's folder leave them.
    """
    ef = check_ef(ef, config.ef_search)
    k = check_k(k, ef)
    measure = check_metric(metric, config.type) if metric else config.metric
    shared = built.sparkSession.sparkContext.broadcast([(int(i), store(np.asarray(q, np.float32)[None], config.type)[0]) for i, q in queries])

    def walked(parts: list[pd.DataFrame]) -> pd.DataFrame:
        ids, g = Graph.of(pd.concat(parts, ignore_index=True), config, measure)
        out = [(i, ids[j], d) for i, q in shared.value for d, j in g.search(q, k, ef)]
        return pd.DataFrame(out, columns=["qid", "rowid", "distance"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts = None, []
        for pdf in batches:
            shard = pdf["shard"].to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(turns, turns[1:]):
                if a == b:
                    continue
                if shard[a] != current and parts:
                    yield walked(parts)
                    parts = []
                current = shard[a]
                parts.append(pdf.iloc[a:b])
        if parts:
            yield walked(parts)

    hits = built.mapInPandas(run, "qid long, rowid long, distance double")
    return hits.selectExpr("*", "row_number() over (partition by qid order by distance, rowid) rank").where(f"rank <= {k}").drop("rank")
