"""Versioned vector tables on plain Parquet.

A table is a directory: ``manifest.json`` names the files of the current version, and a
change writes new Parquet folders first and then replaces the manifest in one step, so a
reader keeps the version it opened and a failed write changes nothing. One writer at a time.

A delete writes only the ids that go, as a folder of tombstones that counts for the data
written before it; an update is a delete and an append. ``compact`` writes the live rows
anew, by itself once a quarter of all rows has gone. The folder may be on any file system
with an atomic rename.

Rows are (rowid, vector) in their storage type; ids given on insert are kept (a duplicate is
an error), others follow the greatest so far. The index, if any, is the sharded graph of
``operators.hnsw``; a change marks the shards it touches and the next ``optimize`` or indexed
search mends only those: gone nodes leave, their neighbours are joined anew, new ones are added.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import VecConfig, check_ef
from ..functions.kernels import store
from ..functions.parse import format_vec, parse_f32
from ..operators import hnsw
from ..operators.knn import knn
from .files import Place

#: Share of gone rows beyond which a change writes the live rows anew.
COMPACT = 0.25
STORED = {"float32": T.ArrayType(T.FloatType(), False), "int8": T.ArrayType(T.ByteType(), False), "bit": T.BinaryType()}


def encode(df: DataFrame, config: VecConfig, vector: str = "vector") -> DataFrame:
    """``df`` with its vectors (texts or float arrays) checked and in storage type."""
    kind, dims = config.type, config.dims

    @F.pandas_udf(STORED[kind])
    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            if x is None:
                raise ValueError("vec0: NULL vector not allowed")
            row = parse_f32(x) if isinstance(x, str) else np.asarray(x, np.float32)
            if len(row) != dims:
                raise ValueError(f"vec0: expected {dims} dims, got {len(row)}")
            s = store(row, kind)
            out.append(s.tobytes() if kind == "bit" else s)
        return pd.Series(out, dtype=object)

    return df.withColumn(vector, run(vector))


def decode_text(kind: str, dims: int):
    """A column function that formats stored vectors; bits come out as 0 and 1."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else format_vec(np.unpackbits(np.frombuffer(x, np.uint8))[:dims] if kind == "bit" else x) for x in v], dtype=object)

    return run


class VectorTable:
    """One table; make it with ``create`` or ``load``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, Place(spark, path)
        self._pending: dict | None = None
        self.manifest = {"gone": [], "removed": 0} | json.loads((self.path / "manifest.json").read())
        self.config = VecConfig(**self.manifest["config"])

    # Declaration and lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, *options: str, config: VecConfig | None = None) -> VectorTable:
        """From ``key=value`` options or a VecConfig; the directory must not hold a table."""
        config = config or VecConfig.parse(*options)
        where = Place(spark, path)
        if (where / "manifest.json").exists():
            raise FileExistsError(f"vec0: table {where.name} already exists")
        where.make()
        state = {"config": asdict(config), "data": [], "gone": [], "graph": None, "dirty": [], "shards": 1, "count": 0, "removed": 0, "next_id": 1}
        cls._write(where, state)
        return cls(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        return cls(spark, path)

    def rename(self, name: str) -> VectorTable:
        to = self.path.with_name(name)
        if to.exists():
            raise FileExistsError(f"vec0: {name} already exists")
        self.path.move(to)
        return VectorTable(self.spark, str(to))

    def drop(self) -> None:
        self.path.remove()

    @staticmethod
    def _write(where: Place, state: dict) -> None:
        (where / "manifest.json").write(json.dumps(state))

    # Versions

    @property
    def state(self) -> dict:
        return self._pending if self._pending is not None else self.manifest

    def begin(self) -> None:
        if self._pending is not None:
            raise RuntimeError("vec0: a transaction is open")
        self._pending = json.loads(json.dumps(self.manifest))

    def commit(self) -> None:
        if self._pending is not None:
            self._write(self.path, self._pending)
            self.manifest, self._pending = self._pending, None

    def rollback(self) -> None:
        self._pending = None

    @contextmanager
    def _change(self):
        """A change within the open transaction, or one of its own."""
        own = self._pending is None
        if own:
            self.begin()
        before = json.loads(json.dumps(self._pending))
        try:
            yield self._pending
        except BaseException:
            self._pending = None if own else before
            raise
        if own:
            self.commit()

    def refresh(self) -> None:
        """Sees what other writers have committed."""
        self.manifest = {"gone": [], "removed": 0} | json.loads((self.path / "manifest.json").read())

    def _store(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(str(self.path / name))
        return name

    def vacuum(self) -> None:
        """Removes folders that no committed version names."""
        used = {*self.manifest["data"], *(name for name, _ in self.manifest["gone"]), *(self.manifest["graph"] or {}).values()}
        for name in self.path.folders():
            if name not in used:
                (self.path / name).remove()

    # Reading

    def stored(self) -> DataFrame:
        """(rowid, vector) in storage type, without the rows that are gone."""
        schema = T.StructType([T.StructField("rowid", T.LongType()), T.StructField("vector", STORED[self.config.type])])
        data, gone = self.state["data"], self.state["gone"]
        read = lambda names, s=schema: self.spark.read.schema(s).parquet(*[str(self.path / n) for n in names])
        out, at = None, 0
        # Data folders between two tombstones are read together; a tombstone counts for those before it.
        for end in sorted({*(upto for _, upto in gone), len(data)}):
            if end > at:
                part = read(data[at:end])
                marks = [name for name, upto in gone if upto >= end]
                if marks:
                    part = part.join(read(marks, "rowid long"), "rowid", "left_anti")
                out = part if out is None else out.unionByName(part)
            at = max(at, end)
        return self.spark.createDataFrame([], schema) if out is None else out

    def scan(self, text: bool = False) -> DataFrame:
        """(rowid, vector, distance) with null distances; vectors as texts if asked."""
        rows = self.stored()
        if text:
            rows = rows.withColumn("vector", decode_text(self.config.type, self.config.dims)("vector"))
        return rows.withColumn("distance", F.lit(None).cast("double"))

    def point(self, rowid: int) -> DataFrame:
        """The row of one id, by a predicate that reaches the Parquet scan."""
        return self.scan().where(F.col("rowid") == rowid)

    def count(self) -> int:
        return self.state["count"]

    def query_block(self, query: str | Sequence[float] | None) -> np.ndarray | bytes | None:
        """A query in storage type, its size checked."""
        if query is None:
            return None
        q = parse_f32(query) if isinstance(query, str) else np.asarray(query, np.float32)
        if len(q) != self.config.dims:
            raise ValueError(f"vec0: query has {len(q)} dims, table has {self.config.dims}")
        s = store(q, self.config.type)
        return s.tobytes() if self.config.type == "bit" else s

    def match(self, query: str | Sequence[float] | None, k: int | None = None, ef_search: int | None = None, metric: str | None = None, prefilter: Column | None = None) -> DataFrame:
        """(rowid, distance) of the nearest rows, exactly; without k as many as ``ef_search``."""
        from ..config import check_metric

        measure = check_metric(metric, self.config.type) if metric else self.config.metric
        ef = check_ef(ef_search, self.config.ef_search)
        return knn(self.stored(), self.query_block(query), k, measure, prefilter=prefilter, ef_search=ef)

    def match_indexed(self, queries: Sequence[tuple[int, Sequence[float]]], k: int | None = None, ef_search: int | None = None, metric: str | None = None) -> DataFrame:
        """(qid, rowid, distance) found by the graph, which is brought up to date first."""
        self.optimize()
        return hnsw.search(self._graph(), queries, k, self.config, ef_search, metric)

    # Writing

    def insert(self, rows: DataFrame) -> None:
        """Appends vectors (texts or arrays) of a ``vector`` column; ids of a ``rowid`` column are kept."""
        with self._change() as state:
            if "rowid" in rows.columns:
                fresh = rows.select(F.col("rowid").cast("long").alias("rowid"), "vector")
            else:
                # Consecutive ids: offsets per partition, no global sort.
                parted = rows.select("vector").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.col("_at").bitwiseAND(F.lit(-(1 << 33))))
                sizes = sorted((r["_part"], r["n"]) for r in parted.groupBy("_part").agg(F.count("*").alias("n")).toLocalIterator())
                start, at = [], state["next_id"]
                for part, n in sizes:
                    start += [F.lit(part), F.lit(at)]
                    at += n
                base = F.create_map(*start)[F.col("_part")] if start else F.lit(0)
                fresh = parted.select((base + F.col("_at") - F.col("_part")).cast("long").alias("rowid"), "vector")
            name = self._store(encode(fresh, self.config), "data")
            added = self.spark.read.parquet(str(self.path / name))
            n, top, ids = added.agg(F.count("*"), F.max("rowid"), F.count_distinct("rowid")).first()
            # Ids from next_id on are new; only smaller ones are looked up.
            low = added.where(F.col("rowid") < state["next_id"])
            if ids != n or (state["count"] and not low.isEmpty() and not low.join(self.stored().select("rowid"), "rowid", "left_semi").isEmpty()):
                (self.path / name).remove()
                raise ValueError("vec0: rowid already exists")
            state["data"].append(name)
            state["count"] += n
            state["next_id"] = max(state["next_id"], (top or 0) + 1)
            self._touch(state, added)

    def delete(self, ids: DataFrame | Sequence[int] | None = None, where: Column | None = None) -> None:
        """Removes rows by ids, by a predicate, or all; an id that isn't there is no error."""
        with self._change() as state:
            rows = self.stored()
            if ids is None and where is None:
                state |= {"data": [], "gone": [], "count": 0, "removed": 0, "graph": None, "dirty": []}
                return
            chosen = rows.where(where) if where is not None else rows.join(self._ids(ids), "rowid", "left_semi")
            self._bury(state, chosen.select("rowid"))
            self.compact(COMPACT)

    def update(self, changes: DataFrame) -> None:
        """New vectors for ids of a (rowid, vector) frame; an id that isn't there is ignored, one named twice or a ``new_rowid`` that differs is an error."""
        if "new_rowid" in changes.columns and not changes.where("new_rowid <> rowid").isEmpty():
            raise ValueError("vec0: cannot change rowid")
        with self._change() as state:
            known = self.stored().select("rowid")
            fresh = encode(changes.select(F.col("rowid").cast("long").alias("rowid"), "vector"), self.config).join(known, "rowid", "left_semi")
            name = self._store(fresh, "data")
            written = self.spark.read.parquet(str(self.path / name))
            n, ids = written.agg(F.count("*"), F.count_distinct("rowid")).first()
            if n != ids:
                (self.path / name).remove()
                raise ValueError("vec0: rowid named twice in an update")
            self._bury(state, written.select("rowid"))
            state["data"].append(name)
            state["count"] += n
            self.compact(COMPACT)

    def _ids(self, ids: DataFrame | Sequence[int]) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col("rowid").cast("long").alias("rowid"))
        return self.spark.createDataFrame([(int(i),) for i in ids], "rowid long")

    def _bury(self, state: dict, ids: DataFrame) -> None:
        """Writes the ids of live rows as a tombstone for the data so far."""
        name = self._store(ids, "gone")
        marks = self.spark.read.parquet(str(self.path / name))
        self._touch(state, marks)
        n = marks.count()
        state["gone"].append([name, len(state["data"])])
        state["count"] -= n
        state["removed"] += n

    def compact(self, share: float = 0.0) -> None:
        """Writes the live rows anew if more than ``share`` of all rows written is gone."""
        with self._change() as state:
            if state["removed"] and state["removed"] > share * (state["count"] + state["removed"]):
                state["data"], state["gone"], state["removed"] = [self._store(self.stored(), "data")], [], 0

    def _touch(self, state: dict, rows: DataFrame) -> None:
        """Marks the shards of changed rows."""
        if state["graph"] is not None:
            named = hnsw.with_shards(rows.select("rowid"), state["shards"]).select("shard").distinct()
            state["dirty"] = sorted({*state["dirty"], *(r["shard"] for r in named.toLocalIterator())})

    # Index

    def optimize(self, seed: int = 42) -> None:
        """Builds the graph, or the shards of it that changes have touched."""
        state = self.state
        shards = hnsw.shard_count(max(state["count"], 1), dims=self.config.dims)
        if state["graph"] is not None and not state["dirty"] and shards == state["shards"]:
            return
        with self._change() as now:
            rows = self.stored()
            if now["graph"] is not None and shards == now["shards"]:
                touched = hnsw.with_shards(rows, shards).where(F.col("shard").isin(now["dirty"])).drop("shard")
                built = hnsw.refresh(touched, self._graph(now["dirty"]), self.config, shards, seed)
                kept = {s: name for s, name in now["graph"].items() if int(s) not in now["dirty"]}
            else:
                built, kept = hnsw.build(rows, self.config, shards, seed), {}
            name = f"graph-{uuid.uuid4().hex}"
            built.write.partitionBy("shard").parquet(str(self.path / name))  # a shard is one task's, so one file
            made = {n.removeprefix("shard="): name for n in (self.path / name).folders() if n.startswith("shard=")}
            now |= {"graph": kept | made, "dirty": [], "shards": shards}

    def _graph(self, shards: Sequence[int] | None = None) -> DataFrame:
        """The graph's rows, of some shards or all; a shard's file is small enough to be read whole by one task."""
        folders: dict[str, list[str]] = {}
        for s, name in (self.state["graph"] or {}).items():
            if shards is None or int(s) in shards:
                folders.setdefault(name, []).append(str(self.path / name / f"shard={s}"))
        out = None
        for name, paths in folders.items():
            part = self.spark.read.schema(hnsw.GRAPH).option("basePath", str(self.path / name)).parquet(*paths).select(hnsw.COLUMNS)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], hnsw.GRAPH) if out is None else out

    def views(self, name: str) -> None:
        """Temporary views ``<name>_config``, ``_data``, ``_graph`` and ``_layers`` over the parts."""
        self.optimize()
        built = self._graph()
        from ..operators.metrics import entry_point

        top = hnsw.layers(built)
        head = entry_point(top).first()
        rows = [*self.config.rows(), ("entry_point", str(head["entry_point"])), ("max_layer", str(head["max_layer"])), ("count", str(self.count()))]
        self.spark.createDataFrame(rows, "key string, value string").createOrReplaceTempView(f"{name}_config")
        self.stored().withColumnRenamed("rowid", "id").createOrReplaceTempView(f"{name}_data")
        hnsw.edges(built).createOrReplaceTempView(f"{name}_graph")
        top.createOrReplaceTempView(f"{name}_layers")
