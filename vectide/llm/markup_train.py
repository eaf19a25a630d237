"""Training of the markup labeller on generated texts: ``python -m vectide.llm.markup_train``.

The labelled sample is bounded: ``DOCUMENTS`` generated texts. They hold plain sentences of
invented words with pieces of HTML, Markdown, wiki and LaTeX markup whose label is known as
they are put in, and with signs that stand for themselves: expressions of a few families
between invented words, and lines of plain type or random signs. Nothing of any table is
read, and no sentence is fixed. ``python -m vectide.llm.markup_train families`` trains without
some families and measures on them.
"""

from __future__ import annotations

import random
import string
import sys
from pathlib import Path

import numpy as np

from . import markup as M
from .markup_leaves import leaves

DOCUMENTS, HELD_OUT, EPOCHS, SEED = 20_000, 2_000, 12, 7
Piece = tuple[str, int]
T, X, H, I, C, FO, B, S, D = range(9)
_SMALL = "the a of and in to was is by from with near every one when its for that at as der die und ist von in el la de y en que una los".split()


#: Families of signs that stand for themselves: within sentences, and whole lines.
ATOMS = ("compare", "money", "path", "bracket", "tuple", "nested", "empty", "angle", "about", "primes", "power", "marks", "pipe", "arrow", "name", "quote")
LINES = ("bullets", "contents", "columns", "crumbs", "scatter", "letters", "broken", "coded", "signs")
MARKUPS = tuple(range(46))
#: Families that ``families`` leaves out of training and measures on, beside the last form of every other family of signs:
#: signs of five kinds, and HTML paragraphs, tables and indices, pictures, infoboxes and item lists. A shape that no other family has is kept in training.
UNSEEN = frozenset({"angle", "marks", "crumbs", "scatter", "contents", 3, 5, 12, 29, 30, 44})


class Maker:
    """Texts of a seed. Families in ``without`` aren't used; ``last`` says whether the last form of a family is used as well ("any"), "never" or "only"."""

    def __init__(self, seed: int, without: frozenset = frozenset(), last: str = "any") -> None:
        self.r, self.without, self.last = random.Random(seed), without, last

    def form(self, forms: list[str]) -> str:
        forms = {"any": forms, "never": forms[:-1] or forms, "only": forms[-1:]}[self.last]
        return self.r.choice(forms)

    def word(self) -> str:
        r = self.r
        if r.random() < 0.35:
            return r.choice(_SMALL)
        w = "".join(r.choice("bcdfghklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "ou", "ei", "ö", "é"]) for _ in range(r.randint(1, 4)))
        return r.choice([w, w + r.choice("nrstml"), w.capitalize()])

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def number(self, hi: int = 999) -> str:
        return str(self.r.randint(1, hi))

    def name(self) -> str:
        return self.word().capitalize()

    def snake(self) -> str:
        return f"{self.word().lower()}_{self.word().lower()}" + (f"_{self.number(99)}" if self.r.random() < 0.2 else "")

    def title(self) -> str:
        return self.words(1, 4).capitalize()

    def sentence(self) -> str:
        r = self.r
        s = self.words(4, 18)
        if r.random() < 0.25:
            s += r.choice([", ", "; ", " - ", ": ", " (", " — "]) + self.words(1, 6)
        if r.random() < 0.15:
            s += " " + self.snake() + " " + self.words(1, 4)
        if r.random() < 0.3:
            s += " " + self.number(2000)
        return s.capitalize() + r.choice("....!?")

    # Signs that stand for themselves.
    def atom(self, family: str) -> str:
        """One expression with signs of a family; what stands around it are invented words."""
        r, w, n = self.r, self.word, self.number
        v, u, gap = r.choice(string.ascii_letters), r.choice(string.ascii_letters), r.choice(["", " ", " "])
        value = lambda: r.choice([n(9), n(), f"{n(9)}.{n(99)}", f"-{n()}", f"0.{n(99):0>2}"])
        if family == "compare":
            if r.random() < 0.2:  # two comparisons without blanks look like a tag
                return f"{v}<{u} {self.words(1, 3)} {r.choice(string.ascii_letters)}>{r.choice([w(), r.choice(string.ascii_letters)])}"
            return f"{r.choice([v, w(), value()])}{gap}{self.form(['<', '>', '<', '>', '<=', '>=', '==', '!=', '='])}{gap}{r.choice([u, value()])}"
        if family == "money":
            return self.form([f"${n()}", f"{n()}$", f"${n()}-${n()}", f"US${n(9)}.{n(99):0>2}", f"€{n()}"])
        if family == "path":
            names = [r.choice([w().lower(), self.snake()]) for _ in range(r.randint(1, 4))]
            return self.form([f"{r.choice('CDEX')}:\\" + "\\".join(names), "\\\\" + "\\".join(names), "~/" + "/".join(names), "/" + "/".join(names)])
        if family == "bracket":
            return self.form(["[{}]", "({})", "[{}"]).format(r.choice([n(), w().lower(), "...", self.words(1, 3), f"{n(9)}, {n(9)}"]))
        if family == "tuple":
            return self.form(["[{}]", "{{{}}}", "({})"]).format(", ".join(value() for _ in range(r.randint(2, 5))))
        if family == "nested":
            a, z = self.form(["[]", "{}", "()"])
            row = lambda: a + r.choice([", ", ","]).join(value() for _ in range(r.randint(1, 3))) + z
            return a + r.choice([", ", ","]).join(row() for _ in range(r.randint(1, 3))) + z
        if family == "empty":
            return self.form(["{}", "[]", "()", "<>", "{ }", "[ ]"])
        if family == "angle":
            return self.form([f"<{n()}>", f"<{n()}", f"<<{n()}>>", f"<{n()}-{n()}>"])
        if family == "about":
            return self.form([f"~{value()}", f"{value()} ~ {value()}", f"~{n()}{gap}%", f"{n()}:{n()}", f"{v}~{u}"])
        if family == "primes":
            return self.form([f"{n()}''", f"{n()}' {n(11)}''", f"{n()}'", f"{n()}°{n(59)}'{n(59)}''"])
        if family == "power":
            return self.form([f"{value()}{gap}**{gap}{n(9)}", f"{v}^{n(9)}", f"{n()}{gap}*{gap}{n()}", f"{v}*{u}", f"10^{n(9)}", f"{n()}{gap}×{gap}{n()}"])
        if family == "marks":
            return self.form([f"{w()} & {w()}", "&c.", f"#{n()}", f"No. #{n()}", f"{w()} && {w()}", f"{n()}% & {n()}%", f"@{w()}"])
        if family == "pipe":
            return self.form([f"{n()} | {n()}", f"{w()} | {w()}", f"{v}|{u}", f"{w()} || {w()}"])
        if family == "arrow":
            return f"{r.choice([v, w(), n()])}{gap}{self.form(['->', '=>', '<-', '-->', '<->', '<=>'])}{gap}{r.choice([u, w(), n()])}"
        if family == "name":
            return self.form([self.snake(), self.snake().upper(), f"{self.snake()}[{n(9)}]", f"{self.snake()} = {value()}", f"{v}_{n(9)}"])
        return self.form([f"'{self.words(1, 5)}'", f'"{self.words(1, 4)}"', f"{w()}*", f"{w()}'s '{w()}'"])  # quote

    def lines(self, family: str) -> str:
        """Lines of plain type, or of random signs."""
        r, w, n = self.r, self.word, self.number
        if family == "bullets":
            marks = r.choice([["*"], ["-"], ["+"], ["•"], ["–"], ["*", "-", "+"]])
            return "\n" + "\n".join(f"{r.choice(marks)} {self.words(1, 5)}" for _ in range(r.randint(1, 12)))
        if family == "contents":
            return "\n" + "\n".join(f"{self.title()} {'.' * r.randint(4, 24)} {n()}" for _ in range(r.randint(3, 12)))
        if family == "columns":
            sep = r.choice([" / ", "    ", "\t", ";", ",", "  |  "])
            return "\n" + "\n".join(sep.join(r.choice([self.name(), n(), f"{n(99)}.{n()}", "n/a"]) for _ in range(4)) for _ in range(r.randint(3, 10)))
        if family == "crumbs":
            return r.choice([" > ", " / ", " | ", " » "]).join(self.name() for _ in range(r.randint(4, 30)))
        if family == "scatter":
            return " ".join(r.choice([r.choice("&!?()%;:=+"), f"0.{n()}", n(99999), n(9)]) for _ in range(r.randint(6, 80)))
        if family == "letters":
            return " ".join(r.choice(string.ascii_letters + string.punctuation) for _ in range(r.randint(12, 160)))
        if family == "broken":
            return "".join(r.choice(["Ã©", "â€™", "Ã¶", "Ã¼", "â€œ", "ï¿½", "Ð", "Â", "x", "q", " "]) for _ in range(r.randint(30, 200)))
        if family == "coded":
            return "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(r.randint(60, 300))) + r.choice(["", "=", "=="])
        unit = "".join(r.choice(string.punctuation) for _ in range(r.randint(2, 7)))  # signs
        return "".join(unit if r.random() < 0.6 else r.choice(string.punctuation) * r.randint(3, 12) for _ in range(r.randint(3, 90))) + (n(99999) if r.random() < 0.3 else "")

    def literal(self) -> list[Piece]:
        r = self.r
        family = r.choice([f for f in (*ATOMS, *ATOMS, "path", *LINES, *LINES[:1]) if f not in self.without])
        if family in LINES:
            return [(self.lines(family), X)]
        out = self.words(1, 7).capitalize() if r.random() < 0.8 else ""
        for _ in range(r.randint(1, 3)):
            out += r.choice([" ", " ", " ", " (", ", "]) * bool(out) + self.atom(family) + r.choice([" ", " ", ", ", ") "]) + self.words(1, 6)
        return [(out + r.choice([".", ".", "", "?"]), X)]

    def inline(self, pieces: list[Piece]) -> list[Piece]:
        """The pieces within a sentence."""
        joint = self.r.choice([" ", " ", " ", ""])
        return [(self.words(2, 10).capitalize() + joint, T), *pieces, (self.r.choice([" ", " ", ". ", ", "]) + self.words(2, 10) + ".", T)]

    def markup(self) -> list[Piece]:
        r, n, ws = self.r, self.number, self.words
        kind = r.choice([k for k in MARKUPS if k not in self.without])
        if kind == 0:
            a, b = r.randint(1, 6), r.randint(1, 6)
            a = a if r.random() < 0.6 else b
            return [(f"<h{b}>", H), (self.title(), H), (f"</h{a}>", H), ("\n", T)]
        if kind == 1:
            t = r.choice(["b", "i", "em", "strong", "u", "span", "sup", "sub", "small", "B", "font", "tt"])
            attr = f' style="color:{self.word()}"' if r.random() < 0.25 else ""
            p = [(f"<{t}{attr}>", S), (ws(1, 3), T), (f"</{t}>", S)]
            if r.random() < 0.2:
                del p[r.choice([0, 2])]
            return self.inline(p)
        if kind == 2:
            p = [(f'<a href="/{self.word()}/{self.word()}" title="{self.name()}">', S), (ws(1, 2), T), ("</a>", S)]
            if r.random() < 0.2:
                p = [p[0], *p, p[2]]
            if r.random() < 0.1:
                p = [(p[0][0][: r.randint(6, 18)], S), *p]
            return self.inline(p)
        if kind == 3:
            out: list[Piece] = []
            for _ in range(r.randint(1, 4)):
                out += [("<p>", S), (self.sentence(), T), ("</p>", S), (r.choice(["", "\n"]), T)]
            return out
        if kind == 4:
            code = f"SELECT {self.snake()} FROM {self.snake()} LIMIT {n()};"
            return [("\n", T), ("<pre>", C), ("<code>", C), (code, C), ("</code>", C), ("</pre>", C), ("\n", T)]
        if kind == 5:
            out = [("\n", T), (f'<table class="{self.word()}">', B)]
            for _ in range(r.randint(1, 6)):
                out += [("<tr>", B), ("<td>", B), (self.name(), B), ("</td>", B), ("<td>", B), (n(), B), ("</td>", B), ("</tr>", B)]
            return [*out, ("</table>", B), ("\n", T)]
        if kind == 6:
            t = r.choice(["ul", "ol", "UL"])
            out = [("\n", T), (f"<{t}>", I)]
            for _ in range(r.randint(1, 6)):
                out += [("<li>", I), (ws(1, 4), I), ("</li>", I)]
            return [*out, (f"</{t.lower()}>", I), ("\n", T)]
        if kind == 7:
            s = f"<!-- {ws(1, 5)} -->"
            return [(s if r.random() < 0.8 else s[: r.randint(5, len(s) - 3)], D)] if r.random() < 0.8 else self.inline([(r.choice(["-->", " -->"]), D)])
        if kind == 8:
            return self.inline([(r.choice(["<br>", "<br/>", "<br />", "<BR/>", "<hr>", "<nowiki/>", "</div>", "</span>", "<div>", "</p>", "</td>", "</b>"]), S)])
        if kind in (9, 10):
            e = r.choice(["&lt;", "&gt;", "&quot;", "&amp;", "&nbsp;", "&mdash;", "&#8217;", "&#x2013;", "&ouml;", "&#39;", "&eacute;", "&hellip;"])
            p: list[Piece] = [(e, S)]
            if r.random() < 0.3:
                p = [("&lt;", S), ("i", T), ("&gt;", S), (ws(1, 2), T), ("&lt;", S), ("/i", T), ("&gt;", S)]
            return self.inline(p)
        if kind == 11:
            p = [(f'<ref{r.choice(["", f" name={self.name()}", f""" name="{self.name()}" """])}>'.replace(" >", ">"), D), (f"{self.name()}, p. {n()}", D), ("</ref>", D)]
            return p if r.random() < 0.7 else [(f"<ref name={self.name()} />", D)]
        if kind == 12:
            tag = r.choice(["sub", "sup"])
            return [(self.name(), T), (f"<{tag}>", S), (n(), T), (f"</{tag}>", S), (" " + ws(1, 4), T)]
        # Markdown
        if kind in (13, 14):
            return [("\n\n" if r.random() < 0.5 else "", T), ("#" * r.randint(1, 6), H), (" " + self.title(), H), ("\n\n", T)]
        if kind == 15:
            t = self.title()
            return [("\n\n", T), (t + "\n", H), (r.choice("=-") * max(3, len(t)), H), ("\n\n", T)]
        if kind == 16:
            m = r.choice(["**", "*", "__", "_", "***"])
            return [(" ".join(["", ws(1, 5), ""]), T), (m, S), (ws(1, 3), T), (m, S), (" " + ws(1, 5) + ".", T)]
        if kind == 17:
            return [(" " + ws(2, 6) + " ", T), ("`", C), (r.choice([self.word(), self.snake()]), C), ("`", C), (" " + ws(1, 6) + ".", T)]
        if kind == 18:
            f = r.choice(["```", "~~~"])
            return [("\n\n", T), (f + r.choice(["", "sql", "py"]), C), (f"\n{self.snake()} = {n()}\nSELECT {self.snake()} FROM {self.word()} LIMIT {n()};\n", C), (f, C), ("\n\n", T)]
        if kind == 19:
            return self.inline([("[", S), (ws(1, 2), T), (f"](/{self.word()}/{self.word()}.md)", S)])
        if kind == 20:
            return [("\n\n", T), (f"![{ws(1, 5)}](img/{self.word()}.png)", S), ("\n\n", T)]
        if kind == 21:
            return self.inline([(f"[^{n(9)}]", D)])
        if kind == 22:
            out = [("\n\n", T)]
            for _ in range(r.randint(1, 4)):
                out += [(">", S), (" " + self.sentence() + "\n", T)]
            return out
        if kind == 23:
            out = [("\n\n", T)]
            for _ in range(r.randint(1, 4)):
                out += [(r.choice(["- [ ]", "- [x]"]), I), (" " + ws(1, 5), I), ("\n", T)]
            return out
        if kind == 24:
            return self.inline([("~~", S), (ws(1, 2), T), ("~~", S)])
        if kind == 25:
            out = [("\n\n", T), ("|", B), (" name ", B), ("|", B), (" count ", B), ("|", B), ("\n", B), ("|---|---:|", B), ("\n", B)]
            for _ in range(r.randint(1, 6)):
                out += [("|", B), (f" {self.name()} ", B), ("|", B), (f" {n()} ", B), ("|", B), ("\n", B)]
            return [*out, ("\n", T)]
        # Wiki
        if kind == 26:
            q = r.choice(["'''", "''", "'''''"])
            return [(r.choice(["", "\n", " " + self.word() + " "]), T), (q, S), (ws(1, 2), T), (q, S), (" " + ws(3, 8), T)]
        if kind == 27:
            p = [("[[", S), (ws(1, 2) + (f" ({self.word()})" if r.random() < 0.2 else ""), T)]
            if r.random() < 0.5:
                p += [("|", S), (ws(1, 2), T)]
            return self.inline([*p, ("]]", S)])
        if kind == 28:
            return [("\n", T), ("[[", D), (f"{r.choice(['Category', 'Kategorie'])}:{ws(1, 4)}", D), ("]]", D)]
        if kind == 29:
            options = [x for name in ("thumb", r.choice(["left", "right", "center"]), f"{n()}px") if r.random() < 0.8 for x in (("|", D), (name, D))]
            return [("[[", D), (f"{r.choice(['File', 'Image', 'Datei'])}:{self.name()}.{r.choice(['jpg', 'png', 'svg'])}", D), *options, ("|", D), (ws(1, 4), D), ("]]", D), ("\n", T)]
        if kind == 30:
            out = [("{{", D), (f"Infobox {self.word()}\n", D)]
            for k in range(r.randint(1, 4)):
                out += [("|", D), (f" {self.word()} ", D), ("=", D), (f" {self.name()}\n", D)]
            return [*out, ("}}", D), ("\n", T)]
        if kind == 31:
            p = [("{{", D), (r.choice(["cite book", "lang", "cite web", "small", "cn"]), D), ("|", D), (self.word(), D)]
            if r.random() < 0.6:
                p += [("=", D), (self.name(), D), ("|", D), ("year", D), ("=", D), (n(2000), D)]
            if r.random() < 0.3:
                p += [("{{", D), ("small", D), ("|", D), (self.name(), D), ("}}", D)]
            return [*p, ("}}", D), (" ", T)]
        if kind == 32:
            out = [("\n", T), ('{| class="wikitable"', B), ("\n", B), ("!", B), (" Name ", B), ("!!", B), (" Size\n", B)]
            for _ in range(r.randint(1, 5)):
                out += [("|-", B), ("\n", B), ("|", B), (f" {self.name()} ", B), ("||", B), (f" {n()}\n", B)]
            return [*out, ("|}", B), ("\n", T)]
        if kind in (33, 34):
            e = "=" * r.randint(2, 4)
            return [("\n", T), (e, H), (f" {self.title()} ", H), (e, H), ("\n", T)]
        if kind == 35:
            out = [("\n", T)]
            for _ in range(r.randint(1, 4)):
                m = r.choice(["*", "**", "#", ""])
                out += [(m, I), ((": " if not m else " "), I), ("[[", S), (self.name(), T), ("]]", S), ("\n", T)]
            return out
        if kind == 36:
            return self.inline([(f"[//{self.word()}.example/{self.name()}", S), (" " + ws(1, 3), T), ("]", S)])
        if kind == 37:
            return [(r.choice(["__NOTOC__", "__TOC__"]), D), ("\n", T)]
        # LaTeX
        if kind in (38, 39):
            return [("\n", T), (r.choice(["\\section", "\\subsection*", "\\chapter", "\\subsection", "\\paragraph"]), H), ("{", H), (self.title(), H), ("}", H), ("\n", T)]
        if kind == 40:
            p = [(r.choice(["\\textbf", "\\emph", "\\textit", "\\texttt"]), S), ("{", S), (ws(1, 2), T), ("}", S)]
            if r.random() < 0.25:
                p = [("{", S), (r.choice(["\\it", "\\bf"]), S), (" " + ws(1, 2), T), ("}", S)]
            return self.inline(p)
        if kind == 41:
            t = r.choice(["", "~"])
            p = [(t, D)] if t else []
            return [(ws(2, 5) + ("" if t else " "), T), *p, ("\\cite", D), ("{", D), (f"{self.word()}{n(2000)}", D), ("}", D), (". ", T)]
        if kind == 42:
            return [("\\footnote", D), ("{", D), (f"{ws(1, 4)}, {n()}", D), ("\\,", D), ("km.", D), ("}", D), (" ", T)]
        if kind == 43:
            v, u = r.choice("abcixy"), r.choice("ijkl")
            k = r.randrange(4)
            if k == 0:
                return self.inline([("$", FO), (v, FO), ("_", FO), (f"{u} ", FO), (r.choice(["\\leq", "\\geq", "\\in", "\\to"]), FO), (f" {n()}", FO), ("$", FO)])
            if k == 1:
                greek = [("$", FO), (r.choice(["\\alpha", "\\beta", "\\theta", "\\lambda", "\\mu", "\\pi", "\\sigma"]), FO), ("$", FO)]
                return self.inline([(n(99), T), (r.choice(["\\%", "\\&", "\\#"]), S), (" " + ws(1, 4) + " ", T), *(greek if r.random() < 0.7 else [])])
            if k == 2:
                return [("\n", T), ("$$", FO), (f" {v} ", FO), ("=", FO), (" ", FO), ("\\frac", FO), ("{", FO), (f"{u}+{n(9)}", FO), ("}", FO), ("{", FO), ("\\sqrt", FO), ("{", FO), (u, FO), ("^", FO), ("2", FO), ("}}", FO), (" ", FO), ("$$", FO), ("\n", T)]
            return [("\n", T), ("\\[", FO), (" ", FO), ("\\sum", FO), ("_", FO), ("{", FO), (u, FO), ("=", FO), ("1", FO), ("}", FO), ("^", FO), ("{", FO), (n(99), FO), ("}", FO), (f" {v}", FO), ("_", FO), (u, FO), ("^", FO), ("2 ", FO), ("\\]", FO), ("\n", T)]
        if kind == 44:
            out = [("\n", T), ("\\begin{itemize}", I), ("\n", I)]
            for _ in range(r.randint(1, 5)):
                out += [("\\item", I), (" " + ws(1, 4) + "\n", I)]
            return [*out, ("\\end{itemize}", I), ("\n", T)]
        v, u = r.choice("abcdmnv"), r.choice("ijkl")
        return [("\n", T), ("\\begin{equation}", FO), ("\\label", FO), ("{", FO), (f"eq:{v}{u}", FO), ("}", FO), (f"\nd({v},{u}) ", FO), ("=", FO), (" ", FO), ("\\lVert", FO), (f" {v}-{u} ", FO), ("\\rVert", FO), ("_", FO), ("2\n", FO), ("\\end{equation}", FO), ("\n", T)]

    def residue(self, pieces: list[Piece]) -> list[Piece]:
        """What a careless cleaner leaves: the pieces from some place on, up to some place, or without one of them."""
        r, at = self.r, self.r.randrange(1, len(pieces))
        rest = r.choice([pieces[at:], pieces[:at], pieces[:at] + pieces[at + 1 :]])
        signs = "".join(s for s, y in rest if y > X)
        return [(self.sentence() + r.choice([" ", "\n"]), T), *rest] if any(c in signs for c in "<>[]{}|\\`*_#=~$&") else pieces

    def document(self) -> tuple[str, np.ndarray]:
        """A text and the label of each of its characters."""
        r = self.r
        pieces: list[Piece] = []
        plan = r.random()
        only = r.choice(["literal", "markup", "both", "both"]) if plan < 0.97 else "none"
        for _ in range(r.randint(1, 6)):
            for _ in range(r.randint(0, 3)):
                pieces.append((self.sentence() + r.choice([" ", " ", "\n", "\n\n"]), T))
            if only != "none" and r.random() < 0.75:
                pick = self.literal if only == "literal" or only == "both" and r.random() < 0.4 else self.markup
                part = pick()
                if pick == self.markup and len(part) > 2 and r.random() < 0.22:
                    part = self.residue(part)
                pieces += [*part, (r.choice([" ", "\n", ""]), T)]
        text = "".join(s for s, _ in pieces)
        marks = np.repeat([y for _, y in pieces], [len(s) for s, _ in pieces]).astype(np.int8) if pieces else np.zeros(0, np.int8)
        return text, marks


def sample(count: int, seed: int, without: frozenset = frozenset(), last: str = "any") -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and labels of generated texts; a text run has the commonest label of its characters."""
    maker, out = Maker(seed, without, last), []
    while len(out) < count:
        text, marks = maker.document()
        items = leaves(text)
        if len(items) < 2 or len(items) > 400:
            continue
        y = np.array([np.bincount(marks[x.start : x.end]).argmax() for x in items], np.int8)
        signs = np.array([x.shape != "text" for x in items])
        y[signs & (y == T)] = X
        y[~signs & (y == X)] = T
        out.append((M.features(text, items), y))
    return out


def backward(p: dict, g: dict, d: str, e: np.ndarray, mask: np.ndarray, dh_out: np.ndarray) -> np.ndarray:
    """Gradients of one direction into ``g``; returns the gradient of the inputs. The forward pass is repeated to keep its gates."""
    n = M.HIDDEN
    steps, batch = mask.shape
    order = list(range(steps)) if d == "f" else list(range(steps - 1, -1, -1))
    pre = e @ p[f"x{d}"] + p[f"c{d}"]
    h, c, keep = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32), []
    for t in order:
        z = pre[t] + h @ p[f"h{d}"]
        s = M.sigmoid(z[:, : 3 * n])
        u = np.tanh(z[:, 3 * n :])
        on = mask[t][:, None]
        c2 = np.where(on, s[:, n : 2 * n] * c + s[:, :n] * u, c)
        tc = np.tanh(c2)
        h2 = np.where(on, s[:, 2 * n :] * tc, h)
        keep.append((t, h, c, s, u, tc, on))
        h, c = h2, c2
    de, dh, dc = np.zeros_like(e), np.zeros_like(h), np.zeros_like(c)
    for t, h0, c0, s, u, tc, on in reversed(keep):
        dh = dh + dh_out[t]
        a = np.where(on, dh, 0)
        do = a * tc
        dct = np.where(on, dc, 0) + a * s[:, 2 * n :] * (1 - tc * tc)
        di, df, du = dct * u, dct * c0, dct * s[:, :n]
        dz = np.concatenate([di * s[:, :n] * (1 - s[:, :n]), df * s[:, n : 2 * n] * (1 - s[:, n : 2 * n]), do * s[:, 2 * n :] * (1 - s[:, 2 * n :]), du * (1 - u * u)], axis=1)
        g[f"h{d}"] += h0.T @ dz
        g[f"x{d}"] += e[t].T @ dz
        g[f"c{d}"] += dz.sum(axis=0)
        de[t] = dz @ p[f"x{d}"].T
        dh = np.where(on, dz @ p[f"h{d}"].T, dh)
        dc = np.where(on, dct * s[:, n : 2 * n], dc)
    return de


def gradients(p: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of a padded batch, and its gradients."""
    e = M.embed(p, x)
    f, _ = M.scan(p, "f", e @ p["xf"] + p["cf"], mask)
    b, _ = M.scan(p, "b", e @ p["xb"] + p["cb"], mask)
    z = np.concatenate([f, b, e], axis=-1)
    s = z @ p["o"] + p["ob"]
    s = np.exp(s - s.max(axis=-1, keepdims=True))
    s /= s.sum(axis=-1, keepdims=True)
    t, k = np.nonzero(mask)
    loss = -np.log(s[t, k, y[t, k]] + 1e-9).mean()
    ds = s.copy()
    ds[t, k, y[t, k]] -= 1
    ds = (ds * mask[..., None] / mask.sum()).astype(np.float32)
    g = {name: np.zeros_like(v) for name, v in p.items()}
    g["o"] = np.tensordot(z, ds, ([0, 1], [0, 1]))
    g["ob"] = ds.sum(axis=(0, 1))
    dz = ds @ p["o"].T
    n = M.HIDDEN
    de = dz[..., 2 * n :] + backward(p, g, "f", e, mask, dz[..., :n]) + backward(p, g, "b", e, mask, dz[..., n : 2 * n])
    at = 0
    for col, _, width in M.EMBED:
        np.add.at(g[f"e{col}"], x[t, k, col], de[t, k, at : at + width])
        at += width
    return float(loss), g


def start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {k: (r.normal(0, 0.3 if k[0] == "e" else s[0] ** -0.5, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in M.shapes().items()}
    for d in "fb":
        p[f"c{d}"][M.HIDDEN : 2 * M.HIDDEN] = 1.0
    return p


def train(documents: int = DOCUMENTS, epochs: int = EPOCHS, seed: int = SEED, batch: int = 48, say=print, without: frozenset = frozenset()) -> dict[str, np.ndarray]:
    """Adam over batches of documents of like length."""
    data = sample(documents, seed, without, "never" if without else "any")
    data.sort(key=lambda d: len(d[0]))
    r = np.random.default_rng(seed)
    p = start(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    for epoch in range(epochs):
        rate, losses = 4e-3 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-4, []
        for k in r.permutation(len(groups)):
            rows = groups[k]
            steps = max(len(a) for a, _ in rows)
            x, y, mask = np.zeros((steps, len(rows), rows[0][0].shape[1]), np.int32), np.zeros((steps, len(rows)), np.int64), np.zeros((steps, len(rows)), bool)
            for i, (a, b) in enumerate(rows):
                x[: len(a), i], y[: len(a), i], mask[: len(a), i] = a, b, True
            for c, width in ((2, 0.1), (3, 0.1), (4, 0.05)):  # words unseen in training occur too
                x[..., c] = np.where(r.random(x.shape[:2]) < width, 0, x[..., c])
            loss, g = gradients(p, x, y, mask)
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for name, a in g.items():
                a = a * min(1.0, 2.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.999 * v[name] + 0.001 * a * a
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        say(f"epoch {epoch}: loss {np.mean(losses):.4f}")
    return p


def families(p: dict[str, np.ndarray], count: int = HELD_OUT, seed: int = SEED + 2) -> tuple[float, float]:
    """Recall and precision of being marked, over texts whose only signs weren't trained on: half of them markup, a quarter signs of the ``UNSEEN`` families, a quarter last forms of the others."""
    every = frozenset((*ATOMS, *LINES, *MARKUPS))
    maker, forms, rows, marked = Maker(seed, every - UNSEEN), Maker(seed + 1, UNSEEN | frozenset(LINES), "only"), [], []
    while len(rows) < count:
        part = maker.markup() if len(rows) % 2 else (maker if len(rows) % 4 else forms).literal()
        text = maker.sentence() + maker.r.choice([" ", "\n"]) + "".join(x for x, _ in part) + maker.r.choice([" ", "\n"]) + maker.sentence()
        items = leaves(text)
        if any(x.shape != "text" for x in items):
            rows.append(M.features(text, items))
            marked.append(len(rows) % 2 == 0)
    got = np.array([((y > X) & (x[:, 0] > 0)).any() for x, y in zip(rows, M.label(rows, p), strict=True)])
    want = np.array(marked)
    return float((got & want).sum() / want.sum()), float((got & want).sum() / max(got.sum(), 1))


def accuracy(p: dict[str, np.ndarray], count: int = HELD_OUT, seed: int = SEED + 1) -> tuple[float, float]:
    """Share of leaves labelled right, and share of texts whose being marked is told right, on other generated texts."""
    data = sample(count, seed)
    got = M.label([x for x, _ in data], p)
    leaf = float(np.mean(np.concatenate([a == y for a, (_, y) in zip(got, data, strict=True)])))
    text = float(np.mean([((a > X) & (x[:, 0] > 0)).any() == ((y > X) & (x[:, 0] > 0)).any() for a, (x, y) in zip(got, data, strict=True)]))
    return leaf, text


if __name__ == "__main__":
    if "families" in sys.argv:
        print("families never trained on: recall %.4f, precision %.4f" % families(train(without=UNSEEN)))
        sys.exit()
    made = train()
    print("held out: leaves %.4f, texts %.4f" % accuracy(made))
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else Path(__file__).with_name(M.WEIGHTS), **{k: x.astype(np.float16) for k, x in made.items()})
