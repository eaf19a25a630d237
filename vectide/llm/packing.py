"""Filling fixed containers with whole documents (problem 8): sum-of-squares online packing.

Lengths are tokens of a public tokenizer whose file is a parameter. Documents arrive in hash
order. For each, the fill level is chosen whose use makes the sum of squared counts of
partially filled containers smallest; the counts are one array with an entry per level, so a
document costs one vector operation over at most ``capacity`` levels.

Scale: tokenising is a narrow stage; only (doc_id, n_tokens) is shuffled, to shards of about
``SHARD_ROWS`` documents by the hash of doc_id (``applyInPandas``; a shard's size is set by
the row count, not by any source). Each shard leaves some partly filled containers.

Results: a document above the capacity becomes full pieces and a rest that is packed like a
document; null and empty texts have no tokens and no container (null); repeated rows of one
doc_id count once; extra columns are ignored; a null doc_id is kept once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
SHARD_ROWS = 50_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SCHEMA = "doc_id long, piece int, container_id long, start_token long, n_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str, step: int = 100_000) -> int:
    """Tokens of a text. Very long texts are encoded in stretches that end at a blank, which bounds the encoder's memory."""
    encode = encoder(path).encode_ordinary
    if len(text) <= step:
        return len(encode(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + step)
        if end < len(text):
            blank = text.rfind(" ", at + 1, end)
            end = blank if blank > at else end
        n += len(encode(text[at:end]))
        at = end
    return n


def token_counts(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count_tokens(t, path) if t else 0 for t in pdf["text"]]})

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_tokens long")


class Packer:
    """Sum-of-squares packing into containers of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The container for an item of 1 to ``capacity``.

        Moving one container from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h] + 1), where a new and a full container count nothing. Among
        equals the fullest level is taken.
        """
        if size == self.capacity:
            return self.new()
        counts, cap = self.counts, self.capacity
        before, after = counts[: cap - size + 1], counts[size : cap + 1]
        change = np.where(before > 0, after - before + 1, np.iinfo(np.int64).max)
        change[0] = after[0]  # a new container: 2 N[size] + 1, halved as the others are
        if before[-1] > 0:
            change[-1] = -before[-1] + 1
        level = cap - size - int(change[::-1].argmin())
        box = self.open[level].pop() if level else self.new()
        if level:
            counts[level] -= 1
        if level + size < cap:
            counts[level + size] += 1
            self.open[level + size].append(box)
        return box


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, container_id, start_token, n_tokens) of every document."""
    sizes = token_counts(documents, path).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    shards = max(1, -(-documents.count() // SHARD_ROWS))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0]) << 32
        packer, rows = Packer(capacity), []
        for doc, n in pdf.sort_values(["order", "doc_id"])[["doc_id", "n_tokens"]].itertuples(index=False):
            doc = None if pd.isna(doc) else int(doc)
            n, piece, start = int(n), 0, 0
            if n == 0:
                rows.append((doc, 0, None, 0, 0))
            while n > 0:
                part = min(n, capacity)
                rows.append((doc, piece, shard + packer.place(part), start, part))
                n, piece, start = n - part, piece + 1, start + part
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "container_id", "start_token", "n_tokens"])
        return out.astype({"container_id": "Int64", "doc_id": "Int64"})

    hashed = sizes.withColumn("order", F.xxhash64("doc_id")).withColumn("shard", F.pmod("order", F.lit(shards)))
    return hashed.groupBy("shard").applyInPandas(run, SCHEMA)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, documents, tokens, and the share of room that is used."""
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
