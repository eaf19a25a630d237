"""References to records that do not exist, were deleted, or arrive later (problem 3).

A Bloom filter over the parent keys is built block by block on the executors, then
broadcast. A key it does not hold is *proved* missing and never shuffled to the parents;
only filter-positive keys meet the exact join. Before either step the references are
collapsed to distinct (field, key, month) rows with their earliest load time, by a map-side
partial aggregate, so that a key holding a third of all rows is one row per task.

The filter's size is bounded by ``MAX_FILTER_BITS`` whatever the number of parents: beyond
it the share of false positives rises, which costs join rows but never a result.

Nulls: a null key is no reference; a null ``loaded_at`` on either side never makes a
reference late; a null month stays null. Empty tables give empty results, an empty parent
table makes every key missing. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: 64 MB of filter at most, and only for as many keys; with 10 bits a key that covers 53 million keys at 1 % false positives.
MAX_FILTER_BITS = 1 << 29
BITS_PER_KEY = 10
#: All bits of a key lie in one block of so many.
BLOCK_BITS = 1 << 16
HASHES = 6


@dataclass(frozen=True)
class Reference:
    """``child.field`` names ``parent.key``. ``live`` keeps referring rows only where its column is null."""

    child: str
    field: str
    parent: str
    key: str
    live: str | None = None


#: What refers to what in the stored vector index and the chunk pipeline.
REFERENCES = (
    Reference("wiki_chunks", "article_id", "wiki_articles", "id"),
    Reference("v_graph", "node_id", "v_data", "id"),
    Reference("v_graph", "neighbor_id", "v_data", "id"),
    Reference("v_data", "id", "v_layers", "node_id", live="deleted_at"),
)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over int64 keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def block_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The block of the filter that holds all bits of a key."""
    return (_mix(keys, 2) & np.uint64(max(bits // BLOCK_BITS, 1) - 1)).astype(np.int64)


def positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each key within its block, by double hashing; ``bits`` is a power of two."""
    a, b = _mix(keys, 0), _mix(keys, 1) | np.uint64(1)
    inside = np.uint64(min(bits, BLOCK_BITS) - 1)
    with np.errstate(over="ignore"):
        return [((a + np.uint64(i) * b) & inside).astype(np.int64) for i in range(HASHES)]


def filter_bits(keys: int) -> int:
    """A power of two near ``BITS_PER_KEY`` a key, at least 2**13, at most MAX_FILTER_BITS."""
    return min(MAX_FILTER_BITS, 1 << max(13, int(max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def bloom(parents: DataFrame, key: str, bits: int) -> np.ndarray:
    """The filter of a table's keys, as packed bytes.

    A key sets bits of one block only, so each distinct key is sent to its block once and a
    block is made by one task; the driver receives the ``bits / 8`` bytes of the blocks.
    """
    size = min(bits, BLOCK_BITS)

    @F.pandas_udf("long")
    def block(keys: pd.Series) -> pd.Series:
        return pd.Series(block_of(keys.to_numpy(np.int64), bits))

    def build(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(size, dtype=bool)
        for at in positions(pdf["key"].to_numpy(np.int64), bits):
            own[at] = True
        return pd.DataFrame({"block": [key_[0]], "bits": [np.packbits(own).tobytes()]})

    keys = parents.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in keys.withColumn("block", block("key")).groupBy("block").applyInPandas(build, "block long, bits binary").toLocalIterator():
        out[row["block"] * size // 8 : (row["block"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def might_contain(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """False only for keys that are certainly absent."""
    found, bits = np.ones(len(keys), dtype=bool), len(packed) * 8
    start = block_of(keys, bits) * min(bits, BLOCK_BITS)
    for at in positions(keys, bits):
        at += start
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found


def membership(spark: SparkSession, packed: np.ndarray):
    """A column function: whether a long key may be in the broadcast filter."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def possible(keys: pd.Series) -> pd.Series:
        return pd.Series(might_contain(keys.to_numpy(np.int64), shared.value))

    return possible


def references(child: DataFrame, ref: Reference) -> DataFrame:
    """Distinct (ref_field, ref_key, ref_month) of one field, with the earliest load time."""
    rows = child.where(F.col(ref.live).isNull()) if ref.live else child
    return (
        rows.where(F.col(ref.field).isNotNull())
        .groupBy(F.lit(ref.child).alias("ref_table"), F.lit(ref.field).alias("ref_field"), F.date_format("written_at", "yyyy-MM").alias("ref_month"), F.col(ref.field).cast("long").alias("ref_key"))
        .agg(F.min("loaded_at").alias("ref_loaded"))
    )


def parent_state(parent: DataFrame, key: str) -> DataFrame:
    """One row a parent key: its earliest load time and whether a tombstone exists."""
    gone = F.max(F.col("deleted_at").isNotNull()) if "deleted_at" in parent.columns else F.lit(False)
    return parent.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("ref_key")).agg(F.min("loaded_at").alias("parent_loaded"), gone.alias("gone"))


def failing(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(ref_table, ref_field, ref_month, ref_key, ref_state) of every reference that fails.

    References to the same parent are checked together: one filter, one join for each.
    """
    out = []
    for parent, key in dict.fromkeys((r.parent, r.key) for r in refs):
        own = [r for r in refs if (r.parent, r.key) == (parent, key)]
        asked = reduce(DataFrame.unionByName, (references(tables[r.child], r) for r in own))
        keys = tables[parent].agg(F.approx_count_distinct(key, 0.02)).first()[0]
        possible = membership(asked.sparkSession, bloom(tables[parent], key, filter_bits(int(keys * 1.05))))
        marked = asked.withColumn("possible", possible("ref_key"))
        absent = marked.where(~F.col("possible")).withColumn("ref_state", F.lit("missing"))
        found = marked.where("possible").join(parent_state(tables[parent], key), "ref_key", "left")
        state = (
            F.when(F.col("gone").isNull(), "missing")
            .when(F.col("gone"), "deleted")
            .when(F.col("parent_loaded") > F.col("ref_loaded"), "late")
        )
        cols = ["ref_table", "ref_field", "ref_month", "ref_key", "ref_state"]
        out += [absent.select(cols), found.withColumn("ref_state", state).where("ref_state is not null").select(cols)]
    return reduce(DataFrame.unionByName, out)


def counts(found: DataFrame) -> DataFrame:
    """Failing references per table, field, month and state."""
    return found.groupBy("ref_table", "ref_field", "ref_month", "ref_state").agg(F.count("*").alias("n_keys"))
