"""Folding of calc() and the shortest spelling of lengths, times and angles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .text import js_number, parse_unit
from .values import Part, parse, rewritten, text_of

# Units of one dimension, in terms of one of them.
LENGTH = {"in": 96.0, "px": 1.0, "pt": 4 / 3, "pc": 16.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}
TIME = {"s": 1000.0, "ms": 1.0}
ANGLE = {"turn": 360.0, "deg": 1.0, "grad": 0.9, "rad": 57.29577951308232}
DIMENSIONS = (LENGTH, TIME, ANGLE)
#: Units that a shorter one is looked for, and the candidates.
SHORTER = {"in": ["in", "px", "pt", "pc"], "px": ["in", "px", "pt", "pc"], "pt": ["in", "px", "pt", "pc"], "pc": ["in", "px", "pt", "pc"], "s": ["s", "ms"], "ms": ["s", "ms"], "turn": ["turn", "deg"], "deg": ["turn", "deg"]}
LENGTHS = {"em", "ex", "ch", "rem", "vw", "vh", "vmin", "vmax", "cm", "mm", "in", "pt", "pc", "px", "q", "cap", "ic", "lh", "rlh", "vb", "vi"}


def drop_zero(number: str) -> str:
    """A number without a leading zero, a plus sign or zeros that say nothing."""
    number = number.lstrip("+")
    x = js_number(float(number))
    return re.sub(r"^(-?)0\.", r"\1.", x)


def shortest_length(number: str, unit: str) -> str:
    """The shortest of the exact spellings of a dimension; of equals the later candidate."""
    best = drop_zero(number) + unit
    table = next((d for d in DIMENSIONS if unit.lower() in d), None)
    if not table or unit.lower() not in SHORTER:
        return best
    for other in SHORTER[unit.lower()]:
        if other != unit.lower():
            x = float(number) * table[unit.lower()] / table[other]
            text = drop_zero(js_number(float(f"{x:.12g}"))) + other
            back = float(parse_unit(text)[0]) * table[other] / table[unit.lower()]
            if abs(back - float(number)) <= 1e-9 * abs(float(number)) and len(text) < len(best):
                best = text
    return best


@dataclass
class Sum:
    """A sum of terms by unit ("" for a number), and of parts that cannot be folded."""

    terms: dict[str, float]
    others: list[tuple[float, str]]


class Unfoldable(Exception):
    pass


TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(?P<unit>[a-z%]*)|(?P<op>[-+*/()])|(?P<name>[a-z-][\w-]*\())", re.I)


class Parser:
    """Recursive descent over + - * / and parentheses; other functions are kept whole."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> re.Match | None:
        return TOKEN.match(self.text, self.at)

    def take(self, ops: str) -> str:
        m = self.peek()
        if m and m["op"] and m["op"] in ops:
            self.at = m.end()
            return m["op"]
        return ""

    def whole(self) -> Sum:
        out = self.sum()
        if self.text[self.at :].strip():
            raise Unfoldable
        return out

    def sum(self) -> Sum:
        out = self.product()
        while op := self.take("+-"):
            out = combine(out, self.product(), 1 if op == "+" else -1)
        return out

    def product(self) -> Sum:
        out = self.atom()
        while op := self.take("*/"):
            other = self.atom()
            if op == "/":
                k = scalar(other)
                if not k:
                    raise Unfoldable
                out = scaled(out, 1 / k)
            elif (k := scalar(other)) is not None:
                out = scaled(out, k)
            elif (k := scalar(out)) is not None:
                out = scaled(other, k)
            else:
                raise Unfoldable
        return out

    def atom(self) -> Sum:
        sign = 1
        while op := self.take("+-"):
            sign = -sign if op == "-" else sign
        m = self.peek()
        if not m:
            raise Unfoldable
        if m["num"]:
            self.at = m.end()
            return Sum({m["unit"]: sign * float(m["num"])}, [])
        if m["op"] == "(" or (m["name"] or "").lower() in ("calc(", "-webkit-calc(", "-moz-calc("):
            self.at = m.end()
            out = self.sum()
            if not self.take(")"):
                raise Unfoldable
            return scaled(out, sign)
        if m["name"]:
            depth, end = 1, m.end()
            while depth and end < len(self.text):
                depth += {"(": 1, ")": -1}.get(self.text[end], 0)
                end += 1
            if depth:
                raise Unfoldable
            name, self.at = self.text[m.start() : end].strip(), end
            return Sum({}, [(sign, name)])
        raise Unfoldable


def scalar(x: Sum) -> float | None:
    return x.terms.get("", 0.0) if not x.others and set(x.terms) <= {""} else None


def scaled(x: Sum, k: float) -> Sum:
    return Sum({u: v * k for u, v in x.terms.items()}, [(n * k, t) for n, t in x.others])


def combine(x: Sum, y: Sum, sign: int) -> Sum:
    terms = dict(x.terms)
    for unit, v in y.terms.items():
        into = unit
        for own in terms:
            table = next((d for d in DIMENSIONS if unit.lower() in d and own.lower() in d), None)
            if own == unit or table:
                into = own
                v *= 1 if own == unit else table[unit.lower()] / table[own.lower()]
                break
        terms[into] = terms.get(into, 0.0) + sign * v
    return Sum(terms, x.others + [(sign * n, t) for n, t in y.others])


def rounded(x: float, precision: int) -> str:
    return js_number(round(x, precision) + 0.0)


def spelled(x: Sum, precision: int) -> str:
    """The folded sum, in a calc() unless one term says it all."""
    terms = [(v, rounded(abs(v), precision) + u) for u, v in x.terms.items()]
    terms = [t for t in terms if float(rounded(abs(t[0]), precision))] or (terms[:1] if not x.others else [])
    every = terms + [(n, t if abs(n) == 1 else f"{rounded(abs(n), precision)}*{t}") for n, t in x.others if n]
    if len(every) == 1 and not (x.others and every[0][0] in (-1,)):
        sign = "-" if every[0][0] < 0 and float(rounded(abs(every[0][0]), precision)) else ""
        if not x.others:
            return sign + every[0][1]
        if every[0][0] == 1:
            return every[0][1]
    lone = every[0][0] < 0 and every[0][1][0].isalpha()  # a sign before a function is no sign
    first = ("-1*" if lone else "-" if every[0][0] < 0 else "") + every[0][1]
    return "calc(" + first + "".join(f" {'-' if n < 0 else '+'} {t}" for n, t in every[1:]) + ")"


def fold_calc(value: str, precision: int = 5) -> str:
    """calc() folded as far as its units allow; what cannot be parsed stays as it is."""

    def change(p: Part) -> Part | None:
        if p.kind == "function" and p.value.lower() in ("calc", "-webkit-calc", "-moz-calc"):
            try:
                out = spelled(Parser(text_of(p.parts)).whole(), precision)
            except Unfoldable:
                return p
            return Part("word", out.replace("calc(", p.value + "(", 1) if out.startswith("calc(") else out)
        return None

    if "calc(" not in value.lower():
        return value
    return text_of(rewritten(parse(value), change))
