"""Texts cut off by field limits or in transfer (problem 10).

Each text gives its length (in characters and UTF-8 bytes, without a mark of omission) and
the kind of its ending. Per source a log-normal length distribution, right-censored at
candidate limits, is fitted by maximum likelihood (EM) to the source's length histogram;
candidate limits are lengths that hold more texts than chance could put there, by the Poisson
tail over the lengths around, for all lengths up to the greatest. At a limit,
and at the few lengths below it that a byte limit can leave, the fit gives the posterior that
a text of that length was censored.

What an ending tells is learned from these posteriors: a second EM (``evidence``) over the
counts of (posterior, ending) estimates how often each ending occurs in cut and in whole texts
and how often texts are cut where no limit is. Its only other input are ``GUESS`` pseudo-texts
an ending. A text's odds are those of its posterior, or of its source's own rate of cuts
elsewhere, times the likelihood ratio of its ending. A text that ends with a closed sentence or
code block is whole by the problem's definition, whatever its length.

``method`` is that alone. A text cut in transfer stands at no limit, so lengths can't tell it
from a whole text with an unusual end. ``found`` therefore adds the problem's other definition:
a text that ends within a sentence, or with a mark of omission, is cut; the fit decides all
endings that leave it open, and learns the rates of cuts from both.

Scale: one narrow pass reads the texts; histograms are pre-aggregated map-side and hold one
row per distinct length, so a source that holds a third of all rows fills no task. The driver
sees one count per kind of ending and twentieth of posterior. The table of limits is broadcast
only below ``MAX_LIMITS`` rows, the common words below ``MAX_COMMON``.

Results: null and blank texts are no cases; a null source is a source of its own; repeated
rows count once in ``found``; extra columns are ignored; a source with few texts has no limit
and goes by the ending alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

MAX_LIMITS = MAX_COMMON = 100_000
#: A length is a candidate if chance puts so many texts on some length of the source with at most this probability.
CHANCE = 0.001

_MARK = re.compile(r"[ \t\n]*(?:\[[ ]?(?:\.{2,}|…)[ ]?\]|\((?:\.{3,}|…)\)|(?<!\.)\.{3,}|…)\s*\Z")
_CLOSED = re.compile(r"[.!?:;。][\"'”’»)\]*_`]*\Z")
_ITEM = re.compile(r"\s*(?:[-*+•–·]|\(?(?:\d{1,3}|[a-zA-Z])[.)]|#{1,6})\s+\S")
_ROW = re.compile(r"\t|\s\|\s|\S {3,}\S|^\|.*\|$")
_PATH = re.compile(r"\S*/\S*\.\w+\Z|\S+://\S+\Z")
_SIGNED = re.compile(r"(?:[^\W\d_][^\n]{0,30},\n[^\n]{1,40}|(?:—|--|–)\s?[^\n]{1,40})\Z")

#: Endings that may be of cut and of whole texts, with the pseudo-texts of either that the estimate starts from.
GUESS = {"open": (4, 0.5), "mark": (4, 0.5), "stub": (4, 0.5), "code": (0.5, 2), "item": (0.5, 2), "row": (0.5, 2), "title": (0.5, 2), "signed": (0.5, 2), "pointer": (0.5, 2)}
#: Endings that are cuts by definition in ``found``.
CUT = frozenset({"open", "mark"})
#: Texts of cut rate ``RATE`` that every source's own rate starts from.
RATE, WEIGHT = 0.02, 20


def ending(text: str, common: frozenset[str] = frozenset()) -> tuple[str, int]:
    """What the end of a text looks like, and the length of the text without a mark of omission. A title or name holds no common word."""
    if m := _MARK.search(text):
        if text[: m.start()].strip():
            return "mark", m.start()
    body = text.rstrip()
    at = body.rfind("\n\n")
    last = body[at + 2 :] if at >= 0 else body
    line = last[last.rfind("\n") + 1 :]
    fences = body.count("\n```") + body.startswith("```")
    if fences % 2:
        kind = "code"
    elif line.strip() in ("```", "~~~"):
        kind = "fence"
    elif _SIGNED.match(last.lstrip()) and len(last.split()) <= 7:
        kind = "signed"
    elif _PATH.search(line.strip()):
        kind = "pointer"
    elif _ITEM.match(line):
        kind = "closed" if _CLOSED.search(line) else "item"
    elif _ROW.search(line):
        kind = "row"
    elif _CLOSED.search(body):
        kind = "closed"
    else:
        words = re.findall(r"[^\W_]+", last.lower())
        short = len(words) <= 8 and len(last) <= 80 and not any(w in common for w in words) and not re.search(r"[.!?;,]\s", last)
        above = last[: -len(line) - 1].rsplit("\n", 1)[-1] if len(last) > len(line) else ""
        # A few words that are no sentence may be a title, but not at the end of paragraphs.
        kind = ("stub" if at >= 0 else "title") if short else "item" if above and _ITEM.match(above) and not _CLOSED.search(above) and len(words) <= 8 else "open"
    return kind, len(text)


def endings(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, kind, chars, bytes) of every text that isn't blank."""
    if (size := common_words.count()) > MAX_COMMON:
        raise ValueError(f"{size} common words; a list of at most {MAX_COMMON} is broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(r["word"].lower() for r in common_words.where("word is not null").toLocalIterator()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for pdf in batches:
            out = []
            for i, s, key, t in zip(pdf["doc_id"], pdf["source"], pdf["text_key"], pdf["text"], strict=True):
                if t and not t.isspace():
                    kind, n = ending(t, common)
                    out.append((i, s, key, kind, n, len(t[:n].encode())))
            yield pd.DataFrame(out, columns=["doc_id", "source", "text_key", "kind", "chars", "bytes"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("text_key"), "text").where("text is not null")
    return rows.mapInPandas(run, "doc_id long, source string, text_key long, kind string, chars int, bytes int")


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def by_chance(n: int, mean: float, tried: int) -> float:
    """Bound of the probability that one of ``tried`` lengths holds at least ``n`` texts where ``mean`` are expected."""
    term = math.exp(min(0.0, n * math.log(max(mean, 1e-9)) - mean - math.lgamma(n + 1)))
    return min(1.0, tried * term / max(1 - mean / (n + 1), 1e-3)) if n > mean else 1.0


def fit(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length by EM: ``censored`` texts are known only to exceed their limit."""
    x = np.log(lengths)
    n, s1, s2 = counts.sum(), (counts * x).sum(), (counts * x * x).sum()
    total = n + censored.sum()
    mu = (s1 + (censored * np.log(limits)).sum()) / max(total, 1)
    sd = max(0.3, math.sqrt(max(s2 / max(n, 1) - (s1 / max(n, 1)) ** 2, 0.0)))
    for _ in range(rounds if len(limits) else 1):
        z = (np.log(limits) - mu) / sd
        rate = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(_normal_tail(z), 1e-12)
        e1 = mu + sd * rate
        e2 = mu * mu + sd * sd + sd * rate * (np.log(limits) + mu)
        mu = (s1 + (censored * e1).sum()) / total
        sd = math.sqrt(max((s2 + (censored * e2).sum()) / total - mu * mu, 1e-4))
    return float(mu), float(sd)


def source_limits(unit: str, lengths: np.ndarray, counts: np.ndarray) -> list[tuple[str, int, int, float, float, float]]:
    """(unit, size, texts there, posterior, mu, sigma) of each candidate limit in one source's histogram, and of the three lengths below it if it is in bytes."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    total, cum = counts.sum(), np.concatenate([[0], counts.cumsum()])
    candidates, chance = [], {}
    for k in np.flatnonzero((counts > 1) & (lengths >= 32)):
        size = lengths[k]
        reach = max(8, int(size * 0.12))
        lo, hi = np.searchsorted(lengths, [size - reach, size + reach + 1])
        around = (cum[hi] - cum[lo] - counts[k]) / (2.0 * reach)
        # A length without any text around is no evidence that none is expected there.
        chance[k] = by_chance(int(counts[k]), max(around, 0.5 / reach), int(lengths[-1]))
        if chance[k] <= CHANCE:
            candidates.append(k)
    out: list[tuple[str, int, int, float, float, float]] = []
    if not candidates:
        return out
    at = np.array(candidates)
    free = np.ones(len(lengths), dtype=bool)
    free[at] = False
    mu, sd = fit(np.maximum(lengths[free], 1).astype(float), counts[free].astype(float), lengths[at].astype(float), counts[at].astype(float))
    # A byte limit drops the part of a character that doesn't fit, so up to three bytes may be missing.
    doubt: dict[int, float] = {}
    for k in candidates:
        for less in range(4 if unit == "bytes" else 1):
            size = int(lengths[k]) - less
            doubt[size] = min(doubt.get(size, 1.0), chance[k])
    for k in np.flatnonzero(np.isin(lengths, list(doubt))):
        size = float(lengths[k])
        z = (math.log(size) - mu) / sd
        expected = total * math.exp(-0.5 * z * z) / (size * sd * math.sqrt(2 * math.pi))
        posterior = max(0.0, 1.0 - expected / counts[k]) * (1 - doubt[int(lengths[k])])
        out.append((unit, int(size), int(counts[k]), min(posterior, 0.999), mu, sd))
    return out


def evidence(counts: list[tuple[str, float, int]], certain: frozenset[str] = frozenset(), rounds: int = 200) -> tuple[dict[str, float], float]:
    """Log likelihood ratio, cut against whole, of each ending, and the rate of cuts where no limit is, by EM.

    ``counts`` has (ending, posterior, texts), posterior 0 where there is no limit; endings in ``certain`` are cuts.
    """
    names = [k for k in GUESS if k not in certain]
    start = np.array([GUESS[k] for k in names], np.float64)
    rows = [(names.index(k), q, n) for k, q, n in counts if k in names]
    kind, q, n = (np.array([r[j] for r in rows], t) for j, t in enumerate((np.int64, np.float64, np.float64)))
    # Texts with a definite ending are known: they count for the rate, and beside the others of their side.
    definite = sum(c for k, p, c in counts if k not in names and p == 0)
    cuts = sum(c for k, p, c in counts if k in certain and p == 0)
    known = np.array([sum(c for k, _, c in counts if k in certain), sum(c for k, _, c in counts if k not in names and k not in certain)], np.float64)
    like, rate = start / (start.sum(axis=0) + known), RATE
    for _ in range(rounds):
        prior = np.maximum(q, rate)
        cut, whole = prior * like[kind, 0], (1 - prior) * like[kind, 1]
        share = cut / (cut + whole)
        mass = start.copy()
        np.add.at(mass, kind, np.stack([share * n, (1 - share) * n], axis=1))
        like = mass / (mass.sum(axis=0) + known)
        off = q == 0
        rate = float(((share * n)[off].sum() + cuts + WEIGHT * RATE) / (n[off].sum() + definite + WEIGHT))
    return {k: float(np.log(like[j, 0] / like[j, 1])) for j, k in enumerate(names)}, rate


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, size, texts, posterior, mu, sigma): the candidate limits of every source. Equal texts of a source are one observation."""
    sizes = rows.dropDuplicates(["source", "text_key"]).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("u")).select("source", "u.*")
    hist = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = source_limits(key[1], pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame([(key[0], *f) for f in found], columns=["source", "unit", "size", "texts", "posterior", "mu", "sigma"])

    return hist.groupBy("source", "unit").applyInPandas(run, "source string, unit string, size int, texts long, posterior double, mu double, sigma double")


def judged(documents: DataFrame, common_words: DataFrame, certain: frozenset[str] = CUT) -> DataFrame:
    """(doc_id, source, kind, chars, bytes, posterior, log_odds, truncated) of every text that isn't blank. Odds are null where the ending is definite."""
    rows = cut(endings(documents, common_words))
    known = cut(limits(rows))
    few = known.count() <= MAX_LIMITS
    for unit in ("chars", "bytes"):
        own = known.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.col("posterior").alias(f"at_{unit}"))
        rows = rows.join(F.broadcast(own) if few else own, ["source", unit], "left")
    rows = cut(rows.withColumn("posterior", F.greatest(F.coalesce("at_chars", F.lit(0.0)), F.coalesce("at_bytes", F.lit(0.0)))))
    step = F.when(F.col("posterior") > 0, F.ceil(F.col("posterior") * 20)).otherwise(0)
    counts = rows.groupBy("kind", step.alias("step")).agg(F.avg("posterior").alias("q"), F.count("*").alias("n")).collect()  # at most 21 a kind of ending
    ratio, rate = evidence([(x["kind"], x["q"], x["n"]) for x in counts], certain)
    told = F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv])[F.col("kind")]
    sure, off = F.col("kind").isin(*certain) if certain else F.lit(False), F.col("posterior") == 0
    share = F.when(sure, 1.0).when(told.isNull(), 0.0).otherwise(1 / (1 + F.exp(-told) * (1 - rate) / rate))
    own = rows.groupBy("source").agg(((F.sum(F.when(off, share).otherwise(0.0)) + WEIGHT * rate) / (F.count_if(off) + WEIGHT)).alias("own_rate"))
    prior = F.greatest("posterior", "own_rate")
    odds = F.log(prior / (1 - prior)) + told
    return rows.join(own, "source").withColumn("log_odds", odds).select("doc_id", "source", "kind", "chars", "bytes", "posterior", "log_odds", (sure | F.coalesce(F.col("log_odds") > 0, F.lit(False))).alias("truncated"))


def method(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, kind, posterior, log_odds, truncated): what the fit and the learned endings alone say of every text."""
    return judged(documents, common_words, frozenset()).select("doc_id", "kind", "posterior", "log_odds", "truncated").distinct()


def found(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id) of the texts judged to be cut off."""
    return judged(documents, common_words).where("truncated").select("doc_id").distinct()


def rates(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per source: texts, those cut off, and their share."""
    rows = judged(documents, common_words).dropDuplicates(["doc_id"])
    n = F.sum(F.col("truncated").cast("long"))
    return rows.groupBy("source").agg(F.count("*").alias("n_texts"), n.alias("n_truncated"), (n / F.count("*")).alias("share"))
