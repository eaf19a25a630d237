"""Per-document text statistics and outlier scores (problem 5).

Each text gives five statistics: word count, mean word length, share of symbols among
characters that aren't blank, share of lines that end in punctuation, and share of common
words in its best language. Per language, exact ranks of every statistic come from one
range-partitioned sort: partitions are sorted by (language, statistic, value), each reports
how many values it holds, and the running totals of the partitions before are its offsets.
The ranks give empirical tail probabilities; an outlier score adds up how far -ln(tail) exceeds
1, which it does by chance for a third of all values. ``scored`` is that method over the whole
table (the query ``p5_method``).

The score is relative: where a third of a language's texts are lists or tables, their
statistics are no tails, and no score tells a list from a table. So ``found`` goes by the shape of
the lines alone, and kinds that are common in a language are found as well.

Equal values may be split between partitions (the sort key ends with a hash of the id), so a
value that a third of all rows share fills no single task; ties that cross a border are
corrected from the partitions' first and last values. The driver sees a few numbers per
partition and (language, statistic).

Results: a null text is left out; a blank one has zero statistics and no kind; repeated rows
of one id count once; a text without any common word is ranked in the language ``FALLBACK``;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut, slots
from .words import words

STATS = ("n_words", "mean_word_len", "symbol_share", "punct_line_share", "common_share")
#: Which tail speaks against prose: both, both, high, low, low.
SIDES = ("both", "both", "high", "low", "low")
FALLBACK = "en"
MAX_COMMON = 100_000
#: Values of one partition of the sort, which a task holds at once.
RANKED = 2_000_000

_SYMBOL = re.compile(r"[^\w\s]|_")
_PUNCT = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*\Z")
_BULLET = re.compile(r"\s*(?:[-*+•–—·▪◦‣]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)])\s+\S")
_CONTENTS = re.compile(r"\S\s*(?:\.\s?){3,}\s*\d+\s*\Z")
_ENTRY = re.compile(r"\s*[^:\n]{1,60}:\s+\S[^\n]*\Z")
_CELLS = (re.compile(r"\t"), re.compile(r" {2,}"), re.compile(r";(?=\S)"), re.compile(r"\s*\|\s*"), re.compile(r",(?=\S)"))


def statistics(text: str, common: dict[str, frozenset[str]]) -> tuple[int, float, float, float, float, str]:
    """The five statistics and the language with the most common words (the first by name among equals)."""
    ws = words(text)
    n = len(ws)
    solid = sum(map(len, text.split()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    hits, lang = 0, ""
    tally = Counter(ws)
    for name, known in common.items():
        k = sum(tally[w] for w in known & tally.keys())
        if k > hits:
            hits, lang = k, name
    return (
        n,
        sum(map(len, ws)) / n if n else 0.0,
        len(_SYMBOL.findall(text)) / solid if solid else 0.0,
        sum(1 for x in lines if _PUNCT.search(x)) / len(lines) if lines else 0.0,
        hits / n if n else 0.0,
        lang,
    )


def _table_share(lines: list[str], chars: int) -> float:
    """Share of characters on lines that one separator cuts into a steady number of cells."""
    best = 0.0
    for cells in _CELLS:
        cuts = [len(cells.findall(x.strip())) for x in lines]
        some = [c for c in cuts if c]
        if len(some) < 2:
            continue
        usual = Counter(some).most_common(1)[0][0]
        # A space-aligned table may have empty cells, so one cell more or less still fits.
        fit = sum(len(x) for x, c in zip(lines, cuts, strict=True) if c and abs(c - usual) <= 1)
        steady = sum(1 for c in some if abs(c - usual) <= 1) / len(some)
        if steady >= 0.7:
            best = max(best, fit / chars)
    return best


def kind_of(text: str, stats: tuple, common: frozenset[str]) -> str:
    """``prose``, ``list``, ``table`` or ``junk``, from the shape of the lines."""
    n, mean, symbols, _, share, _ = stats
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return "blank"
    chars = sum(len(x) for x in lines)
    if n == 0 or mean > 16 or symbols > 0.6 and n < 20:
        return "junk"
    ws = words(text)
    if n >= 12 and share < 0.25 and (len({x.strip() for x in lines}) < 0.5 * len(lines) if len(lines) > 2 else len(set(ws)) / n < 0.3):
        return "junk"
    if len(lines) >= 2:
        bullets = sum(len(x) for x in lines if _BULLET.match(x)) / chars
        if share < 0.27 and sum(len(x) for x in lines if _CONTENTS.search(x)) >= 0.5 * chars:
            return "list"
        if share < 0.22 and bullets < 0.5 and _table_share(lines, chars) >= 0.6:
            return "table"
        # Items and entries: short lines, no sentence among them.
        entries = sum(len(x) for x in lines if _ENTRY.match(x) and not _PUNCT.search(x)) / chars
        plain = sum(len(x) for x in lines if not _PUNCT.search(x) and len(x.split()) <= 14) / chars
        short = len(lines) >= 3 and (bullets >= 0.6 or entries >= 0.6 or plain >= 0.75)
        if short and mean >= 1.9 and share < (0.31 if bullets >= 0.6 else 0.26) and (share >= 0.02 or symbols < 0.12 and readable(ws)):
            return "list"
    if mean < 1.9 or share < 0.12 and n >= 8:
        return "junk"
    return "prose"


_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôû]")


def readable(ws: list[str]) -> bool:
    """Whether most words have vowels in the share that speech needs, and numbers are few."""
    letters = [w for w in ws if not w.isdigit()]
    good = sum(1 for w in letters if 0.2 <= len(_VOWELS.findall(w)) / len(w) <= 0.8)
    return bool(letters) and good >= 0.7 * len(letters) and len(letters) >= 0.6 * len(ws)


def measured(chunks: DataFrame, common_words: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(id, the five statistics, lang, shape) once an id. The word list is a fixed table whose size is checked."""
    if (n := common_words.count()) > MAX_COMMON:
        raise ValueError(f"{n} common words; a list of at most {MAX_COMMON} is broadcast")
    lists: dict[str, set[str]] = {}
    for row in common_words.where("lang is not null and word is not null").toLocalIterator():
        lists.setdefault(row["lang"], set()).add(row["word"].lower())
    shared = chunks.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in sorted(lists.items())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                s = statistics(t, common)
                out.append((i, *s, kind_of(t, s, common.get(s[5], frozenset()))))
            yield pd.DataFrame(out, columns=["id", *STATS, "lang", "shape"])

    rows = chunks.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(run, "id long, n_words int, mean_word_len double, symbol_share double, punct_line_share double, common_share double, lang string, shape string").dropDuplicates(["id"])


def ranks(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, stat, below, upto, total): for each value how many of its language are less, and how many at most equal.

    ``rows`` has (id, lang, stat, value). The sorted rows are cut off in the shared folder, so
    that both passes see the same partitions.
    """
    n = partitions or max(slots(rows.sparkSession), -(-rows.count() // RANKED))
    ordered = rows.withColumn("salt", F.xxhash64("id")).repartitionByRange(n, "lang", "stat", "value", "salt").sortWithinPartitions("lang", "stat", "value", "salt").drop("salt")
    kept = cut(ordered)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple, list] = {}
        for pdf in batches:
            for (lang, stat), g in pdf.groupby(["lang", "stat"], sort=False):
                v = g["value"].to_numpy()
                a = out.get((lang, stat))
                if a is None:
                    out[lang, stat] = [len(v), v[0], int((v == v[0]).sum()), v[-1], int((v == v[-1]).sum())]
                else:
                    a[2] += int((v == a[1]).sum())
                    a[4] = int((v == v[-1]).sum()) + (a[4] if v[-1] == a[3] else 0)
                    a[0] += len(v)
                    a[3] = v[-1]
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([(part, *k, *a) for k, a in out.items()], columns=["part", "lang", "stat", "n", "first", "n_first", "last", "n_last"])

    heads = kept.mapInPandas(summarise, "part int, lang string, stat int, n long, first double, n_first long, last double, n_last long")
    by: dict[tuple, list] = {}
    for r in heads.toLocalIterator():  # one row a partition and (language, statistic) that it holds
        by.setdefault((r["lang"], r["stat"]), []).append((r["part"], r["n"], r["first"], r["n_first"], r["last"], r["n_last"]))
    offsets: dict[tuple, tuple] = {}
    for k, parts in by.items():
        parts.sort()
        before, total = 0, sum(p[1] for p in parts)
        for j, (part, size, first, _, last, _) in enumerate(parts):
            # Rows of the same value in partitions before (they are not less) and behind (they are at most equal).
            equal_before, i = 0, j - 1
            while i >= 0 and parts[i][4] == first:
                equal_before += parts[i][5]
                if parts[i][2] != first:
                    break
                i -= 1
            equal_after, i = 0, j + 1
            while i < len(parts) and parts[i][2] == last:
                equal_after += parts[i][3]
                if parts[i][4] != last:
                    break
                i += 1
            offsets[part, *k] = (before, total, first, equal_before, last, equal_after)
            before += size
    shared = rows.sparkSession.sparkContext.broadcast(offsets)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        whole = pd.concat([b for b in batches] or [pd.DataFrame({"id": [], "lang": [], "stat": [], "value": []})], ignore_index=True)
        for (lang, stat), g in whole.groupby(["lang", "stat"], sort=False):
            before, total, first, equal_before, last, equal_after = shared.value[part, lang, stat]
            v = g["value"].to_numpy()
            below = before + np.searchsorted(v, v, "left") - np.where(v == first, equal_before, 0)
            upto = before + np.searchsorted(v, v, "right") + np.where(v == last, equal_after, 0)
            yield pd.DataFrame({"id": g["id"].to_numpy(), "stat": stat, "below": below, "upto": upto, "total": total})

    return kept.mapInPandas(rank, "id long, stat int, below long, upto long, total long")


def scored(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """(id, the statistics, lang, shape, tails, score) of every text that isn't blank.

    ``tails`` holds, for each statistic, the share of its language that is at least as
    extreme on the side that speaks against prose; the score adds up their logarithms.
    """
    rows = cut(measured(chunks, common_words).where("shape <> 'blank'"))
    named = rows.withColumn("group", F.when(F.col("lang") == "", FALLBACK).otherwise(F.col("lang")))
    values = F.array(*[F.col(c).cast("double") for c in STATS])
    long = named.select("id", F.col("group").alias("lang"), F.posexplode(values).alias("stat", "value"))
    ranked = ranks(long)
    low, high = F.col("upto") / F.col("total"), 1 - F.col("below") / F.col("total")
    side = F.array(*[F.lit(s) for s in SIDES])[F.col("stat")]
    tail = F.when(side == "low", low).when(side == "high", high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    tails = ranked.select("id", "stat", tail.alias("tail")).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("stat", "tail"))), lambda x: x["tail"]).alias("tails"),
        F.sum(F.greatest(F.lit(0.0), -F.log("tail") - 1)).alias("score"),
    )
    return rows.join(tails, "id")


def found(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """(id, content_kind) of the texts whose lines are items, cells or nothing to read, however common they are in their language."""
    return measured(chunks, common_words).where("shape not in ('prose', 'blank')").select("id", F.col("shape").alias("content_kind"))


def stats(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """(id, the five statistics) of every text, rounded to six places."""
    return measured(chunks, common_words).select("id", "n_words", *[F.round(c, 6).alias(c) for c in STATS[1:]])
