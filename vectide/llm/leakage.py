"""Evaluation texts inside training text (problem 9), by pigeonhole edit matching.

A passage of ``WINDOW`` words that occurs with at most ``budget`` wrong words contains, when
the item is cut into pieces laid end to end, at least one piece without error; see
``piece_words``. Exact piece hits are found by one Aho-Corasick pass
over each document's normalised words, then verified with Myers' bit-parallel distance over
the words around the hit.

``leaks`` reports each (document, item) with the longest verbatim run of words and the least
edit distance of a whole window; ``found`` keeps runs of at least ``WINDOW`` words.

The piece dictionary is broadcast only below ``MAX_PIECES`` pieces; above that the document
words are matched by a shuffle join on piece hashes instead (``hits_by_join``), with equal
results. Documents are never collected; each is handled whole in its own Arrow batch.

Null or empty texts hold nothing; items shorter than a window never count; repeated
documents give their row once; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.orphans import bloom, filter_bits, membership
from .words import words

WINDOW = 12
BUDGET = 1
MAX_PIECES = 500_000


def piece_words(window: int, budget: int) -> int:
    """Length of the pieces laid end to end over an item.

    A window of w words that starts anywhere covers at least ``(w + 1) // L - 1`` whole pieces
    of L words. With budget + 1 pieces covered, ``budget`` errors leave one piece exact.
    """
    size = (window + 1) // (budget + 2)
    if size < 1:
        raise ValueError("the window is too short for that budget")
    return size


def piece_table(items: Iterable[tuple[int, str]], size: int, window: int = WINDOW) -> dict[str, list[tuple[int, int, str, str]]]:
    """Piece text to the (item, word offset, word before, word behind) at which it stands."""
    out: dict[str, list[tuple[int, int, str, str]]] = defaultdict(list)
    for item, text in items:
        w = words(text)
        if len(w) >= window:
            for at in range(0, len(w) - size + 1, size):
                out[" " + " ".join(w[at : at + size]) + " "].append((item, at, w[at - 1] if at else "", w[at + size] if at + size < len(w) else ""))
    return dict(out)


def run_around(a: list[str], i: int, b: list[str], j: int, size: int) -> tuple[int, int]:
    """The verbatim run that holds the piece of ``size`` words at a[i] and b[j]: how far it reaches back, and its length."""
    back, most = 0, min(i, j)
    while back < most and a[i - back - 1] == b[j - back - 1]:
        back += 1
    n, most = size, min(len(a) - i, len(b) - j)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return back, back + n


def promising(a: list[str], i: int, b: list[str], j: int, back: int, n: int, window: int, budget: int) -> bool:
    """Whether a window within the budget may hold this run: always for budgets above 1, else by the words past one error at either end.

    With one error the window's other right words follow at once, shifted by a wrong, an
    extra or a missing word.
    """
    if n >= window or budget > 1:
        return True
    if not budget:
        return False
    most = window - 1 - n
    for x, y, step in ((i - back + n, j - back + n, 1), (i - back - 1, j - back - 1, -1)):
        for dx, dy in ((1, 1), (1, 0), (0, 1)):
            p, q, k = x + dx * step, y + dy * step, 0
            while k < most and 0 <= p < len(a) and 0 <= q < len(b) and a[p] == b[q]:
                p, q, k = p + step, q + step, k + 1
            if k == most:
                return True
    return False


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance between the pattern and any stretch of the text, bit-parallel over the pattern's words."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        at[w] |= 1 << k
    vp, vn, score, best = mask, 0, m, m
    for w in text:
        eq = at.get(w, 0)
        x = eq | vn
        d = ((((eq & vp) + vp) ^ vp) | eq) & mask
        hp = (vn | ~(d | vp)) & mask
        hn = d & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        best = min(best, score)
        hp = (hp << 1) & mask
        vp = ((hn << 1) | ~(x | hp)) & mask
        vn = hp & x
    return best


def verify(doc: list[str], item: list[str], runs: list[tuple[int, int, int, int]], window: int, budget: int) -> tuple[int, int]:
    """(longest verbatim run, least window distance) over promising runs (document word, item word, reach back, length).

    A run of a window's length is distance 0. Else the windows of the item that hold the run
    are measured against the document words around it, by Myers' distance.
    """
    best, distance = 0, window
    for i, j, back, n in runs:
        best = max(best, n)
        if n >= window:
            distance = 0
        elif distance > 1:
            start, end = j - back, j - back + n
            # Just outside the run stands an error on either side, so with a budget of 1 a window goes past one end only.
            first, last = max(0, end - window), min(start, len(item) - window)
            for s in range(first, last + 1) if budget > 1 else {first, last} if first <= last else ():
                lo = max(0, i - (j - s) - budget)
                distance = min(distance, myers(item[s : s + window], doc[lo : lo + window + 2 * budget]))
    return best, distance


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, max_pieces: int = MAX_PIECES) -> DataFrame:
    """(doc_id, item_id, run_words, window_edits) of every document that holds a piece of an item whose window is within the budget."""
    size = piece_words(window, budget)
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, run_words int, window_edits int"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and length(text) > 0")
    evals = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates(["item_id"])
    volume = evals.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if volume // (2 * size) > max_pieces:
        return hits_by_join(docs, evals, size, window, budget)
    rows = [(r["item_id"], r["text"]) for r in evals.toLocalIterator()]  # bounded by max_pieces
    shared = spark.sparkContext.broadcast((piece_table(rows, size, window), {i: words(t) for i, t in rows}))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        table, item_words = shared.value
        auto = ahocorasick.Automaton()
        for k, piece in enumerate(table):
            auto.add_word(piece, (k, piece))
        if table:
            auto.make_automaton()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not table:
                    break
                w = words(text)
                joined = " " + " ".join(w) + " "
                found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
                seen, at = 0, 0  # word index of a hit, by counting separators from the last hit on
                for end, (_, piece) in auto.iter(joined):
                    start = end - len(piece) + 1
                    at, seen = (at + joined.count(" ", seen, start), start) if start >= seen else (joined.count(" ", 0, start), start)
                    before, behind = w[at - 1] if at else None, w[at + size] if at + size < len(w) else None
                    for item, offset, left, right in table[piece]:
                        other = item_words[item]
                        back, n = run_around(w, at, other, offset, size) if left == before or right == behind else (0, size)
                        if promising(w, at, other, offset, back, n, window, budget):
                            found[item].append((at, offset, back, n))
                for item, runs in found.items():
                    run, edits = verify(w, item_words[item], runs, window, budget)
                    if edits <= budget:
                        out.append((doc_id, item, run, edits))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "window_edits"])

    return docs.mapInPandas(scan, schema).groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.min("window_edits").alias("window_edits"))


def hits_by_join(docs: DataFrame, items: DataFrame, size: int, window: int, budget: int) -> DataFrame:
    """The same by a shuffle: hashes of the document's word runs meet the pieces' hashes, then document and item meet by id."""

    def grams(column: str, step: int):  # every run of ``size`` words, or the pieces laid end to end
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for key, text in zip(pdf[column], pdf["text"], strict=True):
                    w = words(text)
                    if column == "doc_id" or len(w) >= window:
                        out += [(key, at, " ".join(w[at : at + size])) for at in range(0, len(w) - size + 1, step)]
                yield pd.DataFrame(out, columns=[column, f"{column}_at", "gram"])

        return run

    left = docs.mapInPandas(grams("doc_id", 1), "doc_id long, doc_id_at int, gram string").withColumn("h", F.xxhash64("gram"))
    right = items.mapInPandas(grams("item_id", size), "item_id long, item_id_at int, gram string").withColumn("h", F.xxhash64("gram"))
    # Runs of words that no item holds are told by a filter and aren't shuffled.
    pieces = right.select("h").distinct()
    possible = membership(docs.sparkSession, bloom(pieces, "h", filter_bits(pieces.count())))
    left = left.where(possible("h"))
    hits = left.join(right.select("h", "item_id", "item_id_at"), "h").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("doc_id_at", "item_id_at")).alias("hits"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, item = words(r.text), words(r.item_text)
                runs = [(h["doc_id_at"], h["item_id_at"], *run_around(w, h["doc_id_at"], item, h["item_id_at"], size)) for h in r.hits]
                run, edits = verify(w, item, [x for x in runs if promising(w, x[0], item, x[1], x[2], x[3], window, budget)], window, budget)
                if edits <= budget:
                    out.append((r.doc_id, r.item_id, run, edits))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "window_edits"])

    full = hits.join(docs.dropDuplicates(["doc_id"]), "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")
    return full.mapInPandas(check, "doc_id long, item_id long, run_words int, window_edits int")


def found(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) where at least ``window`` consecutive words of the item stand in the document."""
    return leaks(documents, items, window).where(F.col("run_words") >= window).select("doc_id", "item_id")


def documents_touched(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document touched: its items in order, and the longest run."""
    return leaks(documents, items).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("run_words").alias("longest_run"))
