"""Cutting a text into leaves for the markup labeller: signs that may be markup, and the text between them.

Each leaf carries the path of constructs that are open where it stands (elements, templates,
tables, environments, fences), so that the labeller reads structure as well as words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# The shapes a leaf may have, tried in this order at every position.
SHAPES = (
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"),
    ("tagcut", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w-]+=\"[^<>\"]*\"?)*(?=\s*\Z)|<[A-Za-z][A-Za-z0-9]*\s+[\w-]+=\"[^<>\"\n]*\"?"),
    ("entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("fence", r"^(?:```+|~~~+)[^\n`]*$"),
    ("hash", r"^\#{1,6}(?=[ \t]+\S)"),
    ("equals", r"^={2,6}(?=[^=\n]+={2,6}[ \t]*$)|(?<=[^=\n])={2,6}(?=[ \t]*$)|^={2,6}(?=[ \t]\S)"),
    ("rule", r"^(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$"),
    ("mdrule", r"^\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*$|^:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+$"),
    ("wikitable", r"^\{\|[^\n]*|^\|\}|^\|-[^\n|]*$|^\|\+|^!(?=[ \t]*\w)|!!|\|\|"),
    ("image", r"!\[[^\[\]\n]*\](?:\([^()\s]*\)?|\[[^\[\]\n]*\])"),
    ("footnote", r"\[\^[^\[\]\s]+\]:?"),
    ("task", r"(?:^|(?<=[ \t]))[-*+][ \t]\[[ xX]\](?=[ \t])"),
    ("external", r"\[(?:[a-z]+:)?//[^\s\[\]]+"),
    ("target", r"\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\)"),
    ("linkopen", r"\[\["),
    ("linkclose", r"\]\]"),
    ("braceopen", r"\{\{"),
    ("braceclose", r"\}\}"),
    ("quotes", r"'{2,5}"),
    ("begin", r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}"),
    ("command", r"\\[A-Za-z]+\*?"),
    ("escape", r"\\[%&_#${},;!\\\[\]()~^ ]"),
    ("dollar", r"\$\$?"),
    ("tick", r"`+"),
    ("strike", r"~~"),
    ("stars", r"\*{1,3}"),
    ("under", r"(?<![A-Za-z0-9])_{1,3}(?=\w)|(?<=[^\W_])_{1,3}(?![A-Za-z0-9_])|__[A-Z]{3,}__"),
    ("quote", r"^>+(?=[ \t])"),
    ("pipe", r"\|"),
    ("url", r"https?://[^\s<>\[\]|]+"),
    ("noise", r"(?:(?!<!--|</?[A-Za-z]|\[\[|\{\{|&#?\w+;)[^\w\s]){4,}"),
    ("sign", r"[<>\[\]{}\\~^=&#]"),
)
SHAPE_NAMES = ("text", *(name for name, _ in SHAPES))
# No shape begins with a letter (but for addresses) or a blank, which settles most positions at once.
_LEAF = re.compile(r"(?=[^\w\s]|_|https?://)(?:" + "|".join(f"(?P<{name}>{pattern})" for name, pattern in SHAPES) + ")", re.M | re.S)
#: A text without any of these has no leaf but its own text.
HINT = re.compile(r"[<>\[\]{}\\`*_#=~^$&|]|''|^!|!!|-{3}", re.M)


class Leaf(NamedTuple):
    shape: str
    start: int
    end: int
    path: tuple[str, ...]


def leaves(text: str) -> list[Leaf]:
    """All leaves in order; together they are the text. The path holds at most eight open constructs."""
    out: list[Leaf] = []
    path: list[str] = []
    last = 0

    def close(name: str) -> None:
        if name in path:
            del path[len(path) - 1 - path[::-1].index(name) :]

    if not HINT.search(text):
        return [Leaf("text", 0, len(text), ())] if text else []
    for m in _LEAF.finditer(text):
        shape, start, end = m.lastgroup, m.start(), m.end()
        if start > last:
            out.append(Leaf("text", last, start, tuple(path[-8:])))
        last = end
        here = tuple(path[-8:])
        if shape == "tag":
            name = re.match(r"</?([A-Za-z0-9]+)", m[0])[1].lower()
            if m[0][1] == "/":
                close(name)
            elif not m[0].endswith("/>") and name not in ("br", "hr", "img"):
                path.append(name)
        elif shape == "fence":
            close("fence") if "fence" in path else path.append("fence")
        elif shape == "begin":
            close("env") if m[0].startswith("\\end") else path.append("env")
        elif shape == "braceopen" or shape == "linkopen":
            path.append(shape)
        elif shape == "braceclose":
            close("braceopen")
        elif shape == "linkclose":
            close("linkopen")
        elif shape == "wikitable" and m[0].startswith("{|"):
            path.append("wikitable")
        elif shape == "wikitable" and m[0] == "|}":
            close("wikitable")
        elif shape == "tick" and path[-1:] != ["fence"]:
            close("tick") if "tick" in path else path.append("tick")
        elif shape == "dollar":
            close("dollar") if "dollar" in path else path.append("dollar")
        out.append(Leaf(shape, start, end, here))
    if last < len(text):
        out.append(Leaf("text", last, len(text), tuple(path[-8:])))
    return out
