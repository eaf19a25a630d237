"""Near-duplicate texts (problem 7): a MinHash LSH forest with exact verification.

Texts become sets of word shingles. Each of ``TREES`` prefix tries labels a text by a sequence
of ``DEPTH`` min-hashes, packed into one 64-bit label of which each further min-hash takes a
few lower bits: sorted labels are the trie, and a prefix is shortened by dropping low bits.

Two texts meet in a trie whose labels share a prefix. Matched prefixes are shortened from
``DEPTH`` min-hashes (or the ``deepest`` worth a try) on, level by level, until the recall reaches ``TARGET``. The recall of a
level is measured: for ``PROBES`` sample texts all texts at or above the threshold are found
exactly while the labels are made, with the level at which they meet; the share that theory
gives for a pair right at the threshold counts as ``PRIOR`` further pairs. Each meeting is
verified by the exact Jaccard similarity of the full shingle sets.

Texts with equal shingle sets are one *class*: only classes are labelled, met and verified, so
a group of copies that holds a third of all rows costs one entry a task. Labels are shuffled
once, by their prefix, and sorted; runs of one prefix stream by. A run of more than ``RUN``
classes leaves its task as blocks, and pairs of blocks are spread over all tasks; nothing is
capped. Sets are only built for classes that met another, found by a bounded Bloom filter.

Results: null, empty and shorter texts belong to no pair; repeated rows count once; ids whose
texts are equal form pairs as well. In a class of more than ``EXPAND`` ids, ids of one and the
same text are tied by the smallest of them: to each other id of that text, and by pairs to
other texts of the class and to other classes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from ..operators.orphans import bloom, filter_bits, membership
from ..session import cut, slots
from .words import Hasher, mix, shingle_sets, words

TREES, DEPTH, TARGET = 64, 8, 0.99
#: Bits of a label that each min-hash takes, from the first to the last; together 64.
BITS = (20, 16, 12, 10, 2, 2, 1, 1)
#: Sample texts that measure the recall, and the weight of what theory says, in pairs.
PROBES, PRIOR = 512, 50
#: Classes of one prefix that are paired in place; a longer run is spread in blocks of so many.
RUN = 2048
#: Above so many ids of one shingle set, ids of equal texts go through the smallest of them.
EXPAND = 200


def recall(similarity: float, trees: int, depth: int) -> float:
    """Probability that a pair of that similarity shares a prefix of that depth in some trie."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def deepest(threshold: float, trees: int = TREES) -> int:
    """The longest prefix worth a try: beyond it theory lets more than half of the pairs at the threshold go."""
    return max(d for d in range(1, DEPTH + 1) if d == 1 or recall(threshold, trees, d) >= 0.5)


def prefix_length(threshold: float, met: dict[int, int], trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix that reaches the target; ``met`` counts the probes' true pairs by the level at which they meet (0 for none)."""
    total, depth = sum(met.values()), min(depth, deepest(threshold, trees))
    while depth > 1:
        reached = sum(n for level, n in met.items() if level >= depth)
        if (reached + PRIOR * recall(threshold, trees, depth)) / (total + PRIOR) >= target:
            break
        depth -= 1
    return depth


def below(depth: int) -> int:
    """Low bits of a label that a prefix of that depth drops."""
    return 64 - sum(BITS[:depth])


@lru_cache(maxsize=8)
def _family(count: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def labels(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """The label of each set in each trie. A level's bits hash the trie and all min-hashes down to it; levels beyond ``depth`` are zero.

    A min-hash is the least of ``low * a + high`` (mod 2**32) over the halves of the shingle
    hashes, which single-word arithmetic computes many at a time.
    """
    a = np.ascontiguousarray(_family(trees * DEPTH).reshape(trees, DEPTH)[:, :depth]).ravel()
    low = np.full((len(sets), trees * depth), np.iinfo(np.uint32).max, np.uint32)
    room = np.empty((128, trees * depth), np.uint32)
    with np.errstate(over="ignore"):
        for k, s in enumerate(sets):
            lo, hi = s.astype(np.uint32)[:, None], (s >> np.uint64(32)).astype(np.uint32)[:, None]
            for at in range(0, len(s), 128):  # keeps the block in cache, whatever the text's length
                block = room[: len(lo[at : at + 128])]
                np.multiply(lo[at : at + 128], a, out=block)
                np.add(block, hi[at : at + 128], out=block)
                np.minimum(low[k], block.min(axis=0), out=low[k])
        grid = low.reshape(len(sets), trees, depth).astype(np.uint64)
        key = np.broadcast_to(np.arange(trees, dtype=np.uint64), (len(sets), trees))
        out = np.zeros((len(sets), trees), np.uint64)
        for k, bits in enumerate(BITS[:depth]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, k])
            out = (out << np.uint64(bits)) | (key >> np.uint64(64 - bits))
        out <<= np.uint64(sum(BITS[depth:]))
    return out.view(np.int64)


def level(a: np.ndarray, b: np.ndarray) -> int:
    """The greatest depth to which two texts' labels agree in any trie."""
    apart = (a ^ b).view(np.uint64)
    return max(sum(int((apart >> np.uint64(below(d)) == 0).any()) for d in range(1, DEPTH + 1)), 0)


class Probes:
    """Sample texts as an inverted index of their shingles, to find all texts at or above the threshold."""

    def __init__(self, sets: list[np.ndarray], threshold: float) -> None:
        self.threshold, self.sizes, self.keys, self.labels = threshold, np.array([len(s) for s in sets], np.int64), set_keys(sets), labels(sets, depth=deepest(threshold))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = flat.argsort(kind="stable")
        self.shingles, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.some = np.zeros(1 << 22, bool)  # tells most shingles at once that no probe has them
        self.some[flat & np.uint64((1 << 22) - 1)] = True

    def levels(self, own: list[np.ndarray], keys: list[int], made: np.ndarray) -> list[list[int]]:
        """For each set the level at which it meets each probe that is similar to it and of another class."""
        out: list[list[int]] = [[] for _ in own]
        if not len(self.shingles) or not own:
            return out
        flat, doc = np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own])
        likely = self.some[flat & np.uint64((1 << 22) - 1)]
        flat, doc = flat[likely], doc[likely]
        if not len(flat):
            return out
        lo, hi = np.searchsorted(self.shingles, flat, "left"), np.searchsorted(self.shingles, flat, "right")
        n = hi - lo
        hits = np.repeat(lo - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        pair, both = np.unique(np.repeat(doc, n) * len(self.sizes) + self.owner[hits], return_counts=True)
        d, p = pair // len(self.sizes), pair % len(self.sizes)
        either = np.array([len(s) for s in own])[d] + self.sizes[p] - both
        for k in np.flatnonzero(both >= self.threshold * either - 1e-9):
            if keys[d[k]] != self.keys[p[k]]:
                out[d[k]].append(level(made[d[k]], self.labels[p[k]]))
        return out


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """A hash of each set that isn't empty."""
    n = np.array([len(s) for s in sets], np.uint64)
    starts = np.concatenate([[0], np.cumsum(n[:-1])]).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(np.concatenate(sets)), starts) if len(sets) else np.zeros(0, np.uint64)
        return mix(mix(sums) + n).view(np.int64).tolist()


def forest(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, set_key, text_key, keys, met): the class of each text; once a class and task its labels and the levels at which it meets similar probes."""
    chosen = texts.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("text").toPandas()  # bounded by PROBES
    hasher = Hasher()
    seeds = [s for s in shingle_sets([words(t) for t in chosen["text"]], size, hasher) if len(s)]
    depth = deepest(threshold)
    shared = texts.sparkSession.sparkContext.broadcast(Probes(list({k: s for k, s in zip(set_keys(seeds), seeds, strict=True)}.values()), threshold))

    def lists(rows: list, kind: pa.DataType) -> pa.Array:
        """A list column; None is null."""
        offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
        some = [np.asarray(r) for r in rows if r is not None and len(r)]
        values = pa.array(np.concatenate(some) if some else np.zeros(0, np.int64), kind)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([r is None for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, probes = Hasher(), set(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets([words(t) for t in batch.column(2).to_pylist()], size, hasher)
                kept = np.flatnonzero([len(s) > 0 for s in sets])
                sets = [sets[k] for k in kept]
                if not sets:
                    continue
                keys = set_keys(sets)
                first = {x: k for k, x in reversed(list(enumerate(keys))) if x not in seen}
                seen.update(first)
                own = [sets[k] for k in first.values()]
                made = labels(own, depth=depth)
                met = probes.levels(own, list(first), made)
                place = {k: j for j, k in enumerate(first.values())}
                at_first = [place.get(k) for k in range(len(keys))]
                ids = batch.take(pa.array(kept))
                yield pa.record_batch(
                    [
                        ids.column(0), pa.array(keys, pa.int64()), ids.column(1),
                        lists([None if j is None else made[j] for j in at_first], pa.int64()), lists([None if j is None else met[j] for j in at_first], pa.int32()),
                    ],
                    names=["id", "set_key", "text_key", "keys", "met"],
                )

    return texts.select("id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "id long, set_key long, text_key long, keys array<long>, met array<int>")


def _both(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), a < b, within one block of classes or between two."""
    p, q = np.triu_indices(len(x), 1) if y is None else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
    a, b = x[p], (x if y is None else y)[q]
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def meetings(rows: DataFrame, depth: int) -> DataFrame:
    """(a, b), a < b: distinct classes whose labels share a prefix of that depth in some trie."""
    full, drop = 1 << 16, np.int64(below(depth))
    names = ["a", "b", "run", "block", "items"]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        last, held, block = None, [], 0

        def pairs() -> pd.DataFrame:
            out = pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])}).drop_duplicates()
            found.clear()
            return out.assign(run=None, block=None, items=None)

        def end_of_run(final: bool) -> Iterator[pd.DataFrame]:
            """Pairs a short run; of a long one gives away whole blocks, and the rest at its end."""
            nonlocal held, block, n
            run = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            if block == 0 and len(run) <= RUN:
                held = [run]
                if final and len(run) > 1:
                    found.append(_both(run))
                    n += len(found[-1][0])
                return
            at = 0
            while len(run) - at >= RUN or final and at < len(run):
                yield pd.DataFrame([(None, None, int(last), block, run[at : at + RUN])], columns=names)
                block, at = block + 1, at + RUN
            held = [run[at:]]

        for pdf in batches:
            key, item = pdf["key"].to_numpy() >> drop, pdf["set_key"].to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            size = ends - starts
            inner = np.arange(len(starts)) > 0
            inner[-1] = False
            two = starts[inner & (size == 2)]
            a, b = item[two], item[two + 1]
            found.append((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]))
            n += len(found[-1][0])
            for k in np.flatnonzero(~inner | (size > 2)):
                if key[starts[k]] != last:
                    yield from end_of_run(True)
                    last, held, block = key[starts[k]], [], 0
                held.append(item[starts[k] : ends[k]])
                if sum(map(len, held)) > 2 * RUN:
                    yield from end_of_run(False)
                if n >= full:
                    yield pairs()
                    n = 0
        yield from end_of_run(True)
        if found:
            yield pairs()

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, same in zip(pdf["x"], pdf["y"], pdf["same"], strict=True):
                a, b = _both(np.asarray(x), None if same else np.asarray(y))
                for at in range(0, len(a), full):
                    yield pd.DataFrame({"a": a[at : at + full], "b": b[at : at + full]})

    n_parts = slots(rows.sparkSession)
    spread = rows.where("keys is not null").select("set_key", F.explode("keys").alias("key"))
    sent = spread.repartition(n_parts, F.shiftright("key", int(drop))).sortWithinPartitions("key")
    raw = cut(sent.mapInPandas(match, "a long, b long, run long, block int, items array<long>"))
    out = raw.where("a is not null").select("a", "b")
    blocks = raw.where("run is not null").select("run", "block", "items")
    if not blocks.isEmpty():
        ours, theirs = blocks.toDF("run", "i", "x"), blocks.toDF("run", "j", "y")
        each = ours.join(theirs, "run").where("i <= j").select("run", "i", "j", "x", F.when(F.col("i") < F.col("j"), F.col("y")).alias("y"), (F.col("i") == F.col("j")).alias("same"))
        wide = max(n_parts, 2 * rows.sparkSession.sparkContext.defaultParallelism)
        out = out.unionByName(each.repartition(wide, "run", "i", "j").select("x", "y", "same").mapInPandas(between, "a long, b long"))
    return out.distinct()


def class_links(texts: DataFrame, rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of classes a < b at or above the threshold."""
    counted = rows.select(F.explode("met").alias("level")).groupBy("level").count().collect()  # at most DEPTH + 1 rows
    met = cut(meetings(rows, prefix_length(threshold, {x["level"]: x["count"] for x in counted})))
    wanted = met.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    one = cut(rows.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.min("id").alias("id")))
    possible = membership(texts.sparkSession, bloom(one, "id", filter_bits(one.count())))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            if not len(pdf):
                continue
            sets = shingle_sets([words(t) for t in pdf["text"]], size, hasher)
            yield pd.DataFrame({"id": pdf["id"], "shingles": [s.view(np.int64) for s in sets]})

    sets = texts.where(possible("id")).mapInPandas(build, "id long, shingles array<long>").join(one, "id").dropDuplicates(["set_key"]).select("set_key", "shingles")
    pairs = met.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)], dtype=np.int64)
            either = pdf["sa"].map(len).to_numpy(np.int64) + pdf["sb"].map(len).to_numpy(np.int64) - both
            keep = both >= threshold * either - 1e-9
            yield pd.DataFrame({"a": pdf["a"][keep], "b": pdf["b"][keep], "similarity": both[keep] / np.maximum(either[keep], 1)})

    return pairs.mapInPandas(verify, "a long, b long, similarity double")


def prepared(chunks: DataFrame, size: int, threshold: float, key: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, the distinct (id, set_key, text_key) membership, and the verified class links.

    The forest is read three times, so it is persisted; a lost executor's part is computed anew.
    """
    texts = chunks.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rows = forest(texts, size, threshold).persist()
    links = cut(class_links(texts, rows, size, threshold))
    members = cut(rows.select("id", "set_key", "text_key").distinct())
    rows.unpersist()
    return texts, members, links


def found(chunks: DataFrame, size: int = 3, threshold: float = 0.5) -> DataFrame:
    """(id_a, id_b), id_a < id_b: chunks whose shingle sets have at least the threshold's Jaccard similarity."""
    _, members, links = prepared(chunks, size, threshold)
    counts = members.groupBy("set_key").agg(F.count("*").alias("n"))
    reps = members.groupBy("set_key", "text_key").agg(F.min("id").alias("rep"))
    named = members.join(counts, "set_key").join(reps, ["set_key", "text_key"])
    # In a large class a text is spoken for by its smallest id.
    ends = named.where((F.col("n") <= EXPAND) | (F.col("id") == F.col("rep"))).select("set_key", "id")
    shared = ends.join(counts.where("n > 1").select("set_key"), "set_key")
    within = shared.alias("x").join(shared.alias("y"), F.expr("x.set_key = y.set_key and x.id < y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    tied = named.where((F.col("n") > EXPAND) & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    across = links.join(ends.select(F.col("set_key").alias("a"), F.col("id").alias("i")), "a").join(ends.select(F.col("set_key").alias("b"), F.col("id").alias("j")), "b")
    between = across.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    return within.unionByName(tied).unionByName(between)


def groups(chunks: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, group_id, n_links): each id that has a near-duplicate, the smallest id of its group, and its number of similar ids."""
    _, members, links = prepared(chunks, size, threshold)
    members = members.select("id", "set_key").distinct()
    counts = members.groupBy("set_key").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(counts.select(F.col("set_key").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("set_key")).agg(F.sum("m").alias("others"))
    roots = components(links, "a", "b").select(F.col("node").alias("set_key"), "root")
    rows = members.join(counts, "set_key").join(other, "set_key", "left").join(roots, "set_key", "left")
    rows = rows.select("id", F.coalesce("root", "set_key").alias("root"), "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).where("n_links > 0")
    least = rows.groupBy("root").agg(F.min("rep").alias("group_id"))
    return rows.join(least, "root").select("id", "group_id", "n_links")
