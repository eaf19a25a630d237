"""Text form of vectors: ``[x,y,z]`` to float32 or int8, and back.

The grammar: blanks, ``[``, then numbers between any run of blanks and commas, up to ``]``;
whatever follows is ignored. A number is the longest prefix that C reads as one, so hex
floats, ``inf`` and ``nan`` count and Java's type suffixes don't.
"""

from __future__ import annotations

import re

import numpy as np

_NUMBER = re.compile(
    r"[ \t\n\r\v\f]*([+-]?(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan(?:\(\w*\))?))", re.I
)
_INTEGER = re.compile(r"[ \t\n\r\v\f]*([+-]?\d+)")
_GAP = re.compile(r"[ \t\n\r,]*")
_BLANK = " \t\n\r"


class VectorError(ValueError):
    """A text that isn't a vector, or vectors that don't fit together."""


def _numbers(text: str, number: re.Pattern, prefix: str, bad: str):
    body = text.lstrip(_BLANK)
    if not body.startswith("["):
        raise VectorError(f"{prefix}: expected '[' at start, got '{body[:10]}'")
    at = 1
    while True:
        at = _GAP.match(body, at).end()
        if at >= len(body):
            raise VectorError(f"{prefix}: unterminated vector, expected ']'")
        if body[at] == "]":
            return
        m = number.match(body, at)
        if not m:
            raise VectorError(f"{prefix}: {bad} '{body[at : at + 20]}'")
        at = m.end()
        yield m[1], body[at : at + 20]


def _to_float(word: str) -> float:
    low = word.lower()
    if "x" in low:
        return float.fromhex(word)
    return float("nan") if "nan" in low else float(word)


def parse_f32(text: str) -> np.ndarray:
    """The float32 elements of a vector text."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.array([_to_float(w) for w, _ in _numbers(text, _NUMBER, "vec", "invalid float value")], dtype=np.float64).astype(np.float32)
    if not len(out):
        raise VectorError("vec: empty vector not allowed")
    return out


def parse_i8(text: str) -> np.ndarray:
    """The int8 elements of a vector text; a value out of range is an error."""
    out = []
    for word, _ in _numbers(text, _INTEGER, "vec", "invalid int8 value"):
        if not -128 <= int(word) <= 127:
            raise VectorError(f"vec: int8 value {word} out of range [-128, 127]")
        out.append(int(word))
    if not out:
        raise VectorError("vec: empty vector not allowed")
    return np.array(out, dtype=np.int8)


def format_vec(values) -> str:
    """Elements with seven significant digits, without blanks."""
    return "[" + ",".join(f"{float(v):.7g}" for v in values) + "]"
