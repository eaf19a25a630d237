"""Most similar vectors for every vector (problem 6): an inverted multi-index.

The two halves of each unit vector are quantised separately, which gives a grid of cells. A
query walks through pairs of half-centroids by summed distance, with a heap, until it has
met ``budget`` entries; the entries of these cells are reranked by exact cosine similarity.
Where only neighbours above a similarity count, the walk leaves out cells that by their
radius can't hold one, which loses nothing.

Fitting uses at most ``SAMPLE`` vectors; every vector is indexed. ``budget`` is calibrated:
for ``PROBES`` sample queries the true neighbours are found by a full pass, and the budget is
the number of entries after which the target share of them has been met, so recall is
measured, not assumed.

Distribution: cells are gathered into regions of about equal numbers of entries by bisecting
the occupied cells along their principal direction. Entries go to their region, a query to
each region that holds cells of its walk; queries of neighbouring cells are matched with the
union of their cells in one matrix product. A cell too large for a region is spread over
several by key, and its queries go to each. Only the best k of each region leave it. The
driver holds the centroids and one count per cell, at most ``MAX_HALF``**2 numbers, so cells
keep their size up to 50 million vectors.

Equal vectors are one entry with their smallest ids, so copies cost nothing and their ties
are exact. A cell is never cut off: a walk takes cells whole.

Results: vectors that are null, of another size, not finite or all zero are left out; among
equally similar ids the smaller comes first; repeated rows count once; extra columns are
ignored; with fewer than k other vectors all of them are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut, slots
from .vectors import DIMS, distinct_vectors, matrix, packed, unit, usable

SAMPLE, PROBES, TARGET, LEAST_BUDGET = 20_000, 384, 0.99, 512
MAX_HALF, CELL_ROWS = 1024, 48
REGION_ROWS = (4096, 16_384)


@dataclass
class Grid:
    """Half-centroids, entries per cell, the region of every occupied cell, and the calibrated budget."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    region: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    budget: int = 0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return _squared(x[:, :h], self.first), _squared(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        a, b = self.distances(x)
        return (a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)).astype(np.int32)

    def walk(self, x: np.ndarray, budget: int | None = None, least: float = -1.0) -> Iterator[list[int]]:
        """For each vector the occupied cells by summed half distances, until they hold ``budget`` entries; cells without a vector of similarity ``least`` may be left out."""
        budget, counts, width = budget or self.budget, self.counts, len(self.second)
        reach = self.radius + (2 - 2 * least) ** 0.5 + 1e-4 if least > -1 and len(self.radius) else None
        da, db = self.distances(x)
        oa, ob = da.argsort(axis=1), db.argsort(axis=1)
        for k in range(len(x)):
            a, b = da[k][oa[k]].tolist(), db[k][ob[k]].tolist()
            ia, ib = (oa[k] * width).tolist(), ob[k].tolist()
            heap, got, out = [(a[0] + b[0], 0, 0)], 0, []
            while heap and got < budget:
                d, i, j = heapq.heappop(heap)
                cell = ia[i] + ib[j]
                n = counts[cell]
                if n:
                    if reach is None or d <= reach[cell] ** 2:
                        out.append(cell)
                    got += n
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield out


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of one half; an empty one moves to the point that fits worst."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = _squared(x, c)
        own = d.argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        if (n == 0).any():
            far = d.min(axis=1).argsort()[::-1][: int((n == 0).sum())]
            c[n == 0] = x[far]
    return c


def regions(cells: np.ndarray, counts: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """A region for each occupied cell: halves along the principal direction until no region that can be split holds more than ``most`` entries."""
    out = np.zeros(len(cells), np.int32)
    todo, made = [np.arange(len(cells))], 0
    while todo:
        own = todo.pop()
        weight = counts[own].astype(np.float64)
        if weight.sum() <= most or len(own) == 1:
            out[own] = made
            made += 1
            continue
        x = points[own] - np.average(points[own], axis=0, weights=weight)
        v = x[np.abs(x).sum(axis=1).argmax()].astype(np.float64)
        for _ in range(12):
            v = x.T @ (weight * (x @ v))
            v /= max(np.linalg.norm(v), 1e-30)
        order = (x @ v).argsort(kind="stable")
        at = int(np.searchsorted(weight[order].cumsum(), weight.sum() / 2)) + 1
        at = min(max(at, 1), len(own) - 1)
        todo += [own[order[:at]], own[order[at:]]]
    return out


@dataclass
class Index:
    """The fitted grid and its entries: (vkey, x, cell, region)."""

    grid: Grid
    entries: DataFrame
    total: int


def fit(vectors: DataFrame, key: str, target: float = TARGET, k: int = 5, least: float = -1.0, seed: int = 11) -> Index:
    """An index over (key, vector) rows with distinct vectors; only neighbours at least so similar count in the calibration."""
    spark = vectors.sparkSession
    total = vectors.count()
    rows = vectors.select(F.col(key).alias("vkey"), "vector")
    chosen = rows.orderBy(F.xxhash64("vkey")).limit(SAMPLE).toPandas()  # bounded by SAMPLE
    x = unit(chosen["vector"].tolist())
    half = int(min(MAX_HALF, max(1, round((total / CELL_ROWS) ** 0.5)), max(1, len(x))))
    h = DIMS // 2 if not len(x) else x.shape[1] // 2
    if not len(x):
        x = np.zeros((1, 2 * h), np.float32)
    grid = Grid(kmeans(x[:, :h], half, seed), kmeans(x[:, h:], half, seed + 1))
    shared = spark.sparkContext.broadcast(grid)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = unit(pdf["vector"].tolist())
                a, b = shared.value.distances(u)
                i, j = a.argmin(axis=1), b.argmin(axis=1)
                far = np.sqrt(np.take_along_axis(a, i[:, None], 1) + np.take_along_axis(b, j[:, None], 1))[:, 0]
                yield pd.DataFrame({"vkey": pdf["vkey"], "x": packed(u), "cell": (i * b.shape[1] + j).astype(np.int32), "far": far})

    entries = cut(rows.mapInPandas(assign, "vkey long, x binary, cell int, far float"))
    counts = np.zeros(len(grid.first) * len(grid.second), np.int64)
    radius = np.zeros(len(counts), np.float32)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toLocalIterator():  # at most MAX_HALF ** 2 rows
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    entries = entries.drop("far")
    occupied = np.flatnonzero(counts)
    points = np.concatenate([grid.first[occupied // len(grid.second)], grid.second[occupied % len(grid.second)]], axis=1)
    most = int(min(REGION_ROWS[1], max(REGION_ROWS[0], total / 24)))
    region = np.full(len(counts), -1, np.int32)
    region[occupied] = regions(occupied, counts[occupied], points, most)
    parts = np.maximum(1, -(-np.bincount(region[occupied], weights=counts[occupied]).astype(np.int64) // most)).astype(np.int32)
    grid = Grid(grid.first, grid.second, counts, radius, region, (parts.cumsum() - parts).astype(np.int32), parts)
    grid.budget = _budget(entries, grid, x[:PROBES], target, k, total, least)
    return Index(grid, entries, total)


def _budget(entries: DataFrame, grid: Grid, probes: np.ndarray, target: float, k: int, total: int, least: float) -> int:
    """Entries a walk must meet so that ``target`` of the probes' true k nearest are among them."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(probes)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        best_s, best_c = np.full((len(q), k + 1), -2.0, np.float32), np.zeros((len(q), k + 1), np.int32)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                s = np.concatenate([best_s, q @ matrix(part["x"]).T], axis=1)
                c = np.concatenate([best_c, np.broadcast_to(part["cell"].to_numpy(np.int32), (len(q), len(part)))], axis=1)
                top = np.argpartition(-s, k, axis=1)[:, : k + 1]
                best_s, best_c = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), k + 1), "s": best_s.ravel(), "cell": best_c.ravel()})

    rows = entries.select("x", "cell").mapInPandas(nearest, "q int, s float, cell int").where("s > -2")
    true = rows.selectExpr("*", "row_number() over (partition by q order by s desc) r").where(f"r <= {k + 1}").toPandas()
    needed = []
    for q, g in true.groupby("q"):
        path = next(grid.walk(probes[q : q + 1], total))
        # A walk takes its last cell whole, so what counts is the entries met before a cell.
        reach = dict(zip(path, np.cumsum(grid.counts[path]) - grid.counts[path] + 1, strict=True))
        others = g.sort_values("s", ascending=False).iloc[1:]
        needed += [reach[c] for c in others.loc[others["s"] >= least, "cell"]]
    return int(min(total, max(LEAST_BUDGET, np.quantile(needed, target) if needed else 0)))


def routed(index: Index, asking: DataFrame | None = None, least: float = -1.0) -> DataFrame:
    """Entries (kind 0) and queries (kind 1), by region: (region, kind, cell, vkey, x, cells). ``asking`` holds the query keys, all if None."""
    entries = index.entries
    entries = entries.withColumn("asks", F.lit(True)) if asking is None else entries.join(asking.select("vkey", F.lit(True).alias("asks")), "vkey", "left")
    shared = index.entries.sparkSession.sparkContext.broadcast(index.grid)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                pdf = batch.iloc[at : at + 2000]
                home = grid.region[pdf["cell"].to_numpy()]
                part = grid.base[home] + pdf["vkey"].to_numpy() % grid.parts[home]
                yield pd.DataFrame({"region": part, "kind": 0, "cell": pdf["cell"], "vkey": pdf["vkey"], "x": pdf["x"], "cells": None})
                pdf = pdf[pdf["asks"].notna().to_numpy()]
                paths = list(grid.walk(matrix(pdf["x"]), None, least)) if len(pdf) else []
                cells = np.array([c for path in paths for c in path], np.int32)
                if not len(cells):
                    continue
                # The cells of each query by region, the regions of each query one after another.
                asker, region = np.repeat(np.arange(len(paths)), [len(path) for path in paths]), grid.region[cells]
                order = np.lexsort((region, asker))
                asker, region, cells = asker[order], region[order], cells[order]
                turns = np.flatnonzero((np.diff(asker) != 0) | (np.diff(region) != 0)) + 1
                first = np.concatenate([[0], turns])
                n = grid.parts[region[first]]
                row = np.repeat(np.arange(len(first)), n)
                spread = grid.base[region[first]][row] + np.arange(len(row)) - np.repeat(n.cumsum() - n, n)
                q = asker[first][row]
                lists = np.empty(len(first), object)
                lists[:] = np.split(cells, turns)
                yield pd.DataFrame({"region": spread, "kind": 1, "cell": pdf["cell"].to_numpy()[q], "vkey": pdf["vkey"].to_numpy()[q], "x": pdf["x"].to_numpy()[q], "cells": lists[row]})

    return entries.mapInPandas(send, "region int, kind int, cell int, vkey long, x binary, cells array<int>")


def by_region(rows: DataFrame, match, schema: str) -> DataFrame:
    """Runs ``match(queries, x, entries, y)`` on every group of queries and the entries of the cells they walk.

    ``queries`` and ``entries`` are frames with vkey, ``x`` and ``y`` their vectors. A region's
    entries are held in memory, its queries stream by.
    """
    group = 128

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, entries, x, starts = None, [], None, None, {}
        waiting: list[pd.DataFrame] = []

        def settle() -> None:
            nonlocal entries, x, starts
            entries = pd.concat(held, ignore_index=True) if held else None
            held.clear()
            if entries is not None:
                x = matrix(entries["x"])
                cells, first, n = np.unique(entries["cell"].to_numpy(), return_index=True, return_counts=True)
                starts = {c: (a, a + m) for c, a, m in zip(cells.tolist(), first.tolist(), n.tolist(), strict=True)}
                entries = entries[["vkey"]]

        def flush() -> Iterator[pd.DataFrame]:
            queries = pd.concat(waiting, ignore_index=True) if waiting else None
            waiting.clear()
            if queries is None or entries is None:
                return
            for at in range(0, len(queries), group):
                q = queries.iloc[at : at + group]
                asked = matrix(q["x"])
                cells = np.unique(np.concatenate(q["cells"].to_numpy())).tolist()
                spans = [starts[c] for c in cells if c in starts]
                if not spans:
                    continue
                take = np.concatenate([np.arange(a, b) for a, b in spans])
                near = entries.iloc[take].reset_index(drop=True)
                got = match(q.reset_index(drop=True), asked, near, x[take])
                if got is not None and len(got):
                    yield got

        for pdf in batches:
            regions, kinds = pdf["region"].to_numpy(), pdf["kind"].to_numpy()
            edges = np.flatnonzero(np.diff(regions) | np.diff(kinds)) + 1
            for a, b in zip([0, *edges], [*edges, len(pdf)], strict=True):
                if a == b:
                    continue
                if regions[a] != current:
                    yield from flush()
                    current, entries = regions[a], None
                    held.clear()
                part = pdf.iloc[a:b]
                if kinds[a] == 0:
                    held.append(part)
                else:
                    if held:
                        settle()
                    waiting.append(part)
                    if sum(map(len, waiting)) >= 16 * group:
                        yield from flush()
        yield from flush()

    n = max(slots(rows.sparkSession), 24)
    return rows.repartition(n, "region").sortWithinPartitions("region", "kind", "cell").mapInPandas(run, schema)


def nearest(index: Index, k: int, least: float = -1.0, asking: DataFrame | None = None) -> DataFrame:
    """(vkey, other, similarity): the k most similar entries of every entry (or of those asking), itself left out."""

    def match(q: pd.DataFrame, x: np.ndarray, near: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        s = x @ y.T
        own, other = q["vkey"].to_numpy(), near["vkey"].to_numpy()
        s[own[:, None] == other[None, :]] = -2
        m = min(k, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.broadcast_to(np.arange(m), s.shape)
        best = np.take_along_axis(s, top, 1)
        r, c = np.nonzero(best >= max(least - 1e-4, -1.5))
        if not len(r):
            return None
        cols = top[r, c]
        exact = np.einsum("ij,ij->i", x[r].astype(np.float64), y[cols].astype(np.float64))
        norm = np.linalg.norm(x[r].astype(np.float64), axis=1) * np.linalg.norm(y[cols].astype(np.float64), axis=1)
        return pd.DataFrame({"vkey": own[r], "other": other[cols], "similarity": exact / norm})

    hits = by_region(routed(index, asking, least), match, "vkey long, other long, similarity double").where(F.col("similarity") >= least)
    return hits.selectExpr("*", "row_number() over (partition by vkey order by similarity desc, other) r").where(f"r <= {k}").drop("r")


def neighbours(df: DataFrame, k: int = 5, least: float = -1.0, target: float = TARGET, every: int = 1) -> DataFrame:
    """(rowid, neighbour, similarity): the k most similar others of every usable vector whose rowid ``every`` divides."""
    rows = cut(usable(df))
    each = cut(distinct_vectors(rows, k + 1))
    index = fit(each, "vkey", target, k, least)
    ours = rows.where(F.col("rowid") % every == 0).select("rowid", F.xxhash64("vector").alias("vkey"))
    near = nearest(index, k, least, None if every == 1 else ours.select("vkey").distinct())
    ids = each.select(F.col("vkey").alias("other"), F.slice("ids", 1, k).alias("ids"))
    lists = near.join(ids, "other").groupBy("vkey").agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "ids")).alias("near"))  # at most k each
    own = each.select("vkey", F.col("ids").alias("same")).join(lists, "vkey", "left")
    members = ours.join(own, "vkey")
    flat = F.concat(
        F.transform("same", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id"))),
        F.flatten(F.transform(F.coalesce("near", F.array()), lambda e: F.transform(e["ids"], lambda i: F.struct(e["d"].alias("d"), i.alias("id"))))),
    )
    best = F.slice(F.array_sort(F.filter(flat, lambda e: e["id"] != F.col("rowid"))), 1, k)
    return members.select("rowid", F.explode(best).alias("e")).select("rowid", F.col("e.id").alias("neighbour"), (-F.col("e.d")).alias("similarity"))


def found(df: DataFrame, k: int = 5, least: float = 0.75) -> DataFrame:
    """(rowid_a, rowid_b) of pairs at least that similar of which one is among the other's k most similar."""
    near = neighbours(df, k, least).where(F.col("similarity") >= least)
    return near.select(F.least("rowid", "neighbour").alias("rowid_a"), F.greatest("rowid", "neighbour").alias("rowid_b")).distinct()
