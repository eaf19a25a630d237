"""Markup residue in texts (problem 1): a recurrent block labeller.

A text is cut into leaves (``markup_leaves``). A numpy bidirectional LSTM reads for each leaf
its shape, the hashed path of open constructs, hashed words at its ends and the characters
around it, and labels every leaf with the whole leaf sequence of the document as context.
The labels give the clean text and the structured blocks. Training is in ``markup_train``;
the weights lie beside this file and are a fixed few tens of kilobytes.

Every text is read whole and every leaf is labelled with the whole document as context: a long
sequence is computed ``SPAN`` leaves at a time, and both directions carry their state on.

Results: a null text gives null, an empty one itself without blocks; a text without signs is
returned unchanged; a text whose signs all stand for themselves is unchanged too. Repeated
rows give their id once in ``found``; extra columns are ignored.
"""

from __future__ import annotations

import html
import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .markup_leaves import SHAPE_NAMES, Leaf, leaves

LABELS = ("text", "literal", "heading", "list", "code", "formula", "table", "inline", "drop")
TEXT, LITERAL, HEADING, LIST, CODE, FORMULA, TABLE, INLINE, DROP = range(9)
WEIGHTS = "markup_weights.npz"
SPAN = 1024
SHAPE_ID = {name: i for i, name in enumerate(SHAPE_NAMES)}
PATHS, WORDS = 64, 512
#: Character classes seen before and behind a leaf: edge, newline, blank, letter, digit, other.
KINDS = 6


def _kind(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c == "\n" else 2 if c.isspace() else 3 if c.isalpha() else 4 if c.isdigit() else 5


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, buckets: int) -> int:
    return 1 + zlib.crc32(word.encode()) % (buckets - 1)


_FIRST = re.compile(r"\s*(\w+|[^\w\s]+)")
_LAST = re.compile(r"(\w+|[^\w\s]+)\s*\Z")


def features(text: str, items: list[Leaf]) -> np.ndarray:
    """One row a leaf: shape, path, first and last word bucket, own name bucket, four character classes, length class, line start, repeats."""
    out = np.zeros((len(items), 12), dtype=np.int32)
    seen: dict[str, int] = {}
    total: dict[str, int] = {}
    own = [text[x.start : x.end] for x in items]
    for x, s in zip(items, own, strict=True):
        if x.shape != "text":
            total[s[:12]] = total.get(s[:12], 0) + 1
    for k, (x, s) in enumerate(zip(items, own, strict=True)):
        row = out[k]
        row[0] = SHAPE_ID[x.shape]
        row[1] = _bucket(">".join(x.path[-3:]), PATHS) if x.path else 0
        if x.shape == "text":
            a, b = _FIRST.match(s[:80]), _LAST.search(s[-80:])
            row[2] = _bucket(a[1].lower(), WORDS) if a else 0
            row[3] = _bucket(b[1].lower(), WORDS) if b else 0
        else:
            row[4] = _bucket(re.match(r"[^\s{\"=]*", s[:24])[0].lower(), WORDS)
            n = seen[s[:12]] = seen.get(s[:12], 0) + 1
            row[11] = 1 + n % 2 + 2 * (min(total[s[:12]], 3) - 1) if total[s[:12]] else 0
        row[5], row[6] = _kind(text, x.start - 1), _kind(text, x.end)
        row[7], row[8] = _kind(s, 0), _kind(s, len(s) - 1)
        row[9] = min(len(s).bit_length(), 11)
        row[10] = 1 if x.start == 0 or text[x.start - 1] == "\n" else 0
    return out


#: Feature column, number of values and width of its learned vectors.
EMBED = ((0, len(SHAPE_NAMES), 14), (1, PATHS, 8), (2, WORDS, 6), (3, WORDS, 6), (4, WORDS, 8), (5, KINDS, 3), (6, KINDS, 3), (7, KINDS, 3), (8, KINDS, 3), (9, 12, 3), (10, 2, 1), (11, 8, 3))
WIDTH = sum(w for _, _, w in EMBED)
HIDDEN = 24


def shapes() -> dict[str, tuple[int, ...]]:
    """Names and sizes of all parameters."""
    out = {f"e{c}": (n, w) for c, n, w in EMBED}
    for d in "fb":
        out |= {f"x{d}": (WIDTH, 4 * HIDDEN), f"h{d}": (HIDDEN, 4 * HIDDEN), f"c{d}": (4 * HIDDEN,)}
    return out | {"o": (2 * HIDDEN + WIDTH, len(LABELS)), "ob": (len(LABELS),)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def embed(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([p[f"e{c}"][x[..., c]] for c, _, _ in EMBED], axis=-1)


def scan(p: dict[str, np.ndarray], d: str, pre: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hidden states of one direction over (time, batch, 4 * HIDDEN) inputs, and its last state; masked steps keep the state."""
    steps, batch = mask.shape
    h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
    out = np.zeros((steps, batch, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ p[f"h{d}"]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        new = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        on = mask[t][:, None]
        c = np.where(on, new, c)
        h = np.where(on, gates[:, 2 * HIDDEN :] * np.tanh(c), h)
        out[t] = h
    return out, (h, c)


def best(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels (time, batch) of padded leaf rows (time, batch, features), ``SPAN`` steps at a time."""
    spans = [slice(at, at + SPAN) for at in range(0, len(x), SPAN)]
    back: list[np.ndarray] = []
    state = None
    for at in reversed(spans):
        out, state = scan(p, "b", embed(p, x[at]) @ p["xb"] + p["cb"], mask[at], state)
        back.append(out)
    found, state = [], None
    for at in spans:
        e = embed(p, x[at])
        front, state = scan(p, "f", e @ p["xf"] + p["cf"], mask[at], state)
        found.append((np.concatenate([front, back.pop(), e], axis=-1) @ p["o"] + p["ob"]).argmax(axis=-1))
    return np.concatenate(found)


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(pkgutil.get_data(__package__, WEIGHTS))) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def label(rows: list[np.ndarray], p: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """Labels of each document's leaves. Documents of like length are run together."""
    p = p or weights()
    out = [np.zeros(len(r), np.int8) for r in rows]
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    i = 0
    while i < len(order):
        longest = len(rows[order[i]])
        j = i + 1
        while j < len(order) and j - i < 512 and len(rows[order[j]]) <= max(longest * 1.25, longest + 4) and (j - i) * len(rows[order[j]]) < 60_000:
            j += 1
        steps = len(rows[order[j - 1]])
        x = np.zeros((steps, j - i, rows[0].shape[1]), np.int32)
        mask = np.zeros((steps, j - i), bool)
        for b, k in enumerate(order[i:j]):
            x[: len(rows[k]), b] = rows[k]
            mask[: len(rows[k]), b] = True
        y = best(p, x, mask)
        for b, k in enumerate(order[i:j]):
            out[k][:] = y[: len(rows[k]), b]
        i = j
    return out


def is_marked(items: list[Leaf], labels: np.ndarray) -> bool:
    """Whether any sign was labelled as markup."""
    return any(y > LITERAL and x.shape != "text" for x, y in zip(items, labels, strict=True))


_BREAKS = {"p", "div", "br", "hr", "table", "tr", "ul", "ol", "pre", "blockquote"}


def render(text: str, items: list[Leaf], labels: np.ndarray) -> tuple[str, list[tuple[str, str]]]:
    """The clean text and its blocks (kind, text), from the labels.

    Headings stand on their own line, list items open with "- ", table cells are separated
    by tabs, code and formulas are kept as they stand, dropped matter leaves nothing.
    """
    if not is_marked(items, labels):
        return text, [("text", text)] if text else []
    parts: list[tuple[str, str]] = []

    def put(kind: str, piece: str) -> None:
        if parts and parts[-1][0] == kind:
            parts[-1] = (kind, parts[-1][1] + piece)
        elif piece:
            parts.append((kind, piece))

    title = False  # a heading sign has opened the line
    for x, y in zip(items, labels, strict=True):
        s = text[x.start : x.end]
        kind = LABELS[y] if HEADING <= y <= TABLE else "text"
        if y == DROP:
            continue
        if x.shape == "text" and title:
            line, end, rest = s.partition("\n")
            put("heading", line.strip() + end)
            put(kind if "\n" in s and kind != "heading" else "text", rest)
            title = not end
        elif x.shape == "text" or y in (TEXT, LITERAL):
            put(kind if y != LITERAL else "text", s)
        elif y == HEADING and x.shape in ("hash", "equals"):
            title = x.start == 0 or text[x.start - 1] == "\n"
        elif y == HEADING and x.shape == "rule" and parts and parts[-1][0] != "heading":
            body, _, line = parts.pop()[1].rstrip("\n").rpartition("\n")
            put("text", body + "\n" if body else "")
            put("heading", line + "\n")
        elif y == FORMULA:
            put("formula", s)
        elif x.shape == "entity":
            put("text", html.unescape(s))
        elif x.shape == "tag":
            name = re.match(r"</?([A-Za-z0-9]+)", s)[1].lower()
            if name == "li" and s[1] != "/":
                put("list", "\n- ")
            elif name in ("td", "th") and s[1] == "/":
                put("table", "\t")
            elif name in _BREAKS or re.fullmatch(r"h[1-6]", name):
                put(kind, "\n")
        elif x.shape == "command" and s == "\\item" or x.shape == "task" or y == LIST and x.shape in ("stars", "hash", "sign"):
            put("list", "- ")
        elif x.shape == "pipe" and y == TABLE or x.shape == "wikitable" and s in ("||", "!!"):
            put("table", "\t")
        elif x.shape == "escape" and y == INLINE:
            put("text", s[1:] if s[1] in "%&_#$" else " ")
        elif x.shape in ("image", "target", "external", "footnote", "url") and y == INLINE:
            put("text", m[1] if (m := re.match(r"!\[([^\[\]]*)\]", s)) else "")
    clean = "".join(piece for _, piece in parts)
    clean = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", clean)).strip("\n")
    return clean, [(k, v) for k, v in parts if v.strip()]


def process(texts: list[str]) -> Iterator[tuple[str, list[Leaf], np.ndarray]]:
    """Each text with its leaves and their labels."""
    items = [leaves(t) for t in texts]
    rows = [features(t, x) for t, x in zip(texts, items, strict=True)]
    yield from zip(texts, items, label(rows) if rows else [], strict=True)


def cleaned(texts: list[str]) -> list[tuple[str, list[tuple[str, str]], bool]]:
    """Clean text, blocks and whether it was marked. Markup that stood escaped in entities comes to light once and is cleaned too."""
    out, again = [], []
    for t, items, y in process(texts):
        marked = is_marked(items, y)
        out.append((*render(t, items, y), marked))
        if marked and any(x.shape == "entity" and t[x.start : x.end] in ("&lt;", "&amp;", "&#60;", "&#x3c;") for x in items):
            again.append(len(out) - 1)
    for k, (t, items, y) in zip(again, process([out[k][0] for k in again]), strict=True):
        if is_marked(items, y):
            out[k] = (*render(t, items, y), True)
    return out


def clean(chunks: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(id, clean_text, blocks, marked) of every distinct id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, (body, blocks, marked) in zip(pdf["id"], cleaned([t or "" for t in pdf["text"]]), strict=True):
                out.append((i, body, [{"kind": k, "text": v} for k, v in blocks], marked))
            frame = pd.DataFrame(out, columns=["id", "clean_text", "blocks", "marked"])
            frame.loc[pdf["text"].isna().to_numpy(), "clean_text"] = None
            yield frame

    rows = chunks.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {dict(chunks.dtypes)[key]}, clean_text string, blocks array<struct<kind:string,text:string>>, marked boolean"
    return rows.mapInPandas(run, schema).dropDuplicates(["id"])


def found(chunks: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Ids of the texts in which the labeller marks at least one sign as markup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [is_marked(items, y) for _, items, y in process([t or "" for t in pdf["text"]])]
            yield pdf.loc[np.array(got, dtype=bool), ["id"]]

    return chunks.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {dict(chunks.dtypes)[key]}").distinct()
