"""Cutting oversized texts into balanced pieces at natural boundaries (problem 2).

Method: the least piece count that can hold the text under the limit is computed, equal
targets are placed, each target is snapped to the strongest boundary near it, and a piece is
added whenever one would pass the limit. Every piece after the first opens with about
``overlap`` characters of the piece before, from a word start where one is near.

Only texts above the limit leave the JVM; they are handled one row at a time in Arrow
batches, so neither a shuffle nor any state between rows is needed.

Results: a null text gives no piece; an empty or short text gives itself as piece 0; a text
without any boundary is cut hard; repeated rows of one id give that id's pieces once
(``split_chunks``); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 1200, 120
#: How far from its target a cut may move, as a share of the target distance.
REACH = 0.2
#: Boundaries and their strength; a cut lies behind the match. A space in a sentence is weakest.
BOUNDARIES = (
    (re.compile(r"\n[ \t]*\n\s*"), 6.0),
    (re.compile(r"\n"), 4.0),
    (re.compile(r"[.!?…][\"'”’)\]]*\s+"), 3.0),
    (re.compile(r"[;:]\s+"), 1.8),
    (re.compile(r",\s+"), 1.4),
    (re.compile(r"\s+"), 1.0),
)


def boundaries(text: str, lo: int, hi: int) -> dict[int, float]:
    """Cut positions in [lo, hi] with the strength of the strongest boundary that ends there."""
    found: dict[int, float] = {}
    start = max(0, lo - 64)
    for pattern, strength in BOUNDARIES:
        for m in pattern.finditer(text, start, hi):
            if lo <= m.end() <= hi:
                found[m.end()] = max(found.get(m.end(), 0.0), strength)
    return found


def snap(text: str, target: int, lo: int, hi: int) -> int:
    """The best cut in [lo, hi]: strength less the distance from the target, which may cost up to 1.2."""
    span = max(target - lo, hi - target, 1)
    near = boundaries(text, lo, hi)
    return min(near, key=lambda p: (1.2 * abs(p - target) / span - near[p], p)) if near else target


def opening(text: str, cut: int, floor: int, overlap: int) -> int:
    """Where the piece behind ``cut`` opens: about ``overlap`` characters earlier, at a word start if one is near."""
    want = max(floor, cut - overlap)
    if want == cut or want == floor:
        return want
    near = [m.end() for m in re.finditer(r"\s+", text[want - 1 : min(cut, want + overlap // 3)])]
    return min(cut, want - 1 + near[0]) if near else want


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(open, own, end) of each piece: it shows text[open:end], of which text[own:end] is new."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    room = limit - overlap
    count = 1 + -(-(n - limit) // room)
    while True:
        step = n / count
        out, last = [], 0
        for i in range(1, count + 1):
            opens = opening(text, last, out[-1][1] if out else 0, overlap) if i > 1 else 0
            # The rest must fit into the pieces left, and this piece under the limit.
            most = min(n, opens + limit)
            least = max(last + 1, n - (limit + (count - i - 1) * room) if i < count else n)
            if least > most:
                break
            if i == count:
                end = n
            else:
                target = min(max(round(i * step), least), most)
                reach = max(1, int(step * REACH))
                end = snap(text, target, max(least, target - reach), min(most, target + reach))
            if end - opens > limit:
                break
            out.append((opens, last, end))
            last = end
        else:
            return out
        count += 1


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "id", text: str = "content") -> DataFrame:
    """(id, piece_index, piece, overlap_chars) of every text, whole ones included."""
    base = chunks.select(F.col(key).alias("id"), F.col(text).alias("text"))
    whole = base.where(F.length("text") <= limit).select("id", F.lit(0).alias("piece_index"), F.col("text").alias("piece"), F.lit(0).alias("overlap_chars"))
    return whole.unionByName(pieces(chunks, limit, overlap, key, text)).dropDuplicates(["id", "piece_index"])


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "id", text: str = "content") -> DataFrame:
    """As ``split_chunks``, of the texts above the limit alone; repeated rows stay repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, t[o:e], s - o) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, (o, s, e) in enumerate(cuts(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["id", "piece_index", "piece", "overlap_chars"])

    return (
        chunks.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .where(F.length("text") > limit)
        .mapInPandas(run, f"id {dict(chunks.dtypes)[key]}, piece_index int, piece string, overlap_chars int")
    )


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids whose text came out as more than one piece."""
    return pieces(chunks, limit, overlap).where("piece_index = 1").select("id").distinct()
