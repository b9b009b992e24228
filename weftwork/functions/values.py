"""Property values as trees: words, functions, strings, dividers, spaces, comments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass
class Part:
    """kind: word, function, string, div, space or comment. A function's value is its name."""

    kind: str
    value: str
    parts: list[Part] = field(default_factory=list)
    quote: str = ""

    def __str__(self) -> str:
        if self.kind == "function":
            return f"{self.value}({text_of(self.parts)})"
        if self.kind == "string":
            return f"{self.quote}{self.value}{self.quote}"
        if self.kind == "comment":
            return f"/*{self.value}*/"
        return self.value


def text_of(parts: list[Part]) -> str:
    return "".join(map(str, parts))


TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|$))|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|(?P<div>[,/:])|(?P<open>[^\s,/:()"']*\()|(?P<close>\))|(?P<word>(?:\\.|[^\s,/:()"'\\]|\\$)+)""", re.S)
URL = re.compile(r"""\s*([^"'\s()][^()"']*?)\s*\)""", re.S)


def parse(text: str) -> list[Part]:
    """The parts of a value; spaces beside a divider belong to none. An unquoted url() is one word."""
    top: list[Part] = []
    stack = [top]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            stack[-1].append(Part("word", text[at]))
            at += 1
            continue
        kind, got = m.lastgroup, m[0]
        at = m.end()
        if kind == "open":
            f = Part("function", got[:-1])
            stack[-1].append(f)
            if got[:-1].lower() == "url" and (u := URL.match(text, at)):
                f.parts = [Part("word", u[1])]
                at = u.end()
            else:
                stack.append(f.parts)
        elif kind == "close":
            if len(stack) > 1:
                stack.pop()
            else:
                stack[-1].append(Part("word", ")"))
        elif kind == "string":
            closed = len(got) > 1 and got[-1] == got[0]
            stack[-1].append(Part("string", got[1:-1] if closed else got[1:], quote=got[0]))
        elif kind == "comment":
            stack[-1].append(Part("comment", got[2:-2] if got.endswith("*/") else got[2:]))
        else:
            stack[-1].append(Part(kind, " " if kind == "space" else got))
    return tidy(top)


def tidy(parts: list[Part]) -> list[Part]:
    """Without spaces at the ends and beside dividers; in calculations the space around + and - stays."""
    out: list[Part] = []
    for p in parts:
        if p.kind == "function":
            p.parts = tidy(p.parts)
        if p.kind == "space" and (not out or out[-1].kind in ("space", "div")):
            continue
        if p.kind == "div" and out and out[-1].kind == "space":
            out.pop()
        out.append(p)
    if out and out[-1].kind == "space":
        out.pop()
    return out


def walk(parts: list[Part]) -> Iterator[Part]:
    for p in parts:
        yield p
        yield from walk(p.parts)


def rewritten(parts: list[Part], change: Callable[[Part], Part | None], inside: Callable[[Part], bool] = lambda p: True) -> list[Part]:
    """A copy in which `change` has replaced parts, outermost first; what it replaces is not
    entered, and neither is a function for which `inside` is false."""
    out = []
    for p in parts:
        new = change(p)
        if new is not None:
            out.append(new)
        elif p.kind == "function" and inside(p):
            out.append(Part("function", p.value, rewritten(p.parts, change, inside)))
        else:
            out.append(p)
    return out


def words(parts: list[Part]) -> list[Part]:
    return [p for p in parts if p.kind not in ("space", "comment")]


def commas(parts: list[Part]) -> list[list[Part]]:
    """The parts between top-level commas."""
    out: list[list[Part]] = [[]]
    for p in parts:
        if p.kind == "div" and p.value == ",":
            out.append([])
        else:
            out[-1].append(p)
    return [tidy(x) for x in out]


def rows(text: str) -> list[tuple[int, int, str, str]]:
    """(ord, depth, kind, value) of every part, in order: the value as a flat table."""
    out: list[tuple[int, int, str, str]] = []

    def down(parts: list[Part], depth: int) -> None:
        for p in parts:
            out.append((len(out), depth, p.kind, p.value))
            down(p.parts, depth + 1)

    down(parse(text), 0)
    return out
