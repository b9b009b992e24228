"""Shorthand declarations to longhands."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.colors import is_color
from ..functions.text import parse_unit
from ..functions.values import Part, parse, words

# Keyword sets of the shorthands.
GLOBAL = ["inherit", "initial", "unset", "revert", "revert-layer"]
WIDTH_UNITS = set("% cap ch cm em ex fr ic in lh mm pc pt px Q rem rlh vb vh vi vmax vmin vw".split())
WIDTH_WORDS = {*GLOBAL, "auto", "min-content", "max-content", "fit-content"}
SIDES = ["top", "right", "bottom", "left"]
DIRECTION = {*GLOBAL, "row", "row-reverse", "column", "column-reverse"}
WRAP = {*GLOBAL, "nowrap", "wrap", "reverse"}  # not wrap-reverse, which makes the value invalid
OUTLINE_STYLE = {*GLOBAL, *"auto none dotted dashed solid double groove ridge inset outset".split()}
LINE = {*GLOBAL, "none", "underline", "overline", "line-through", "blink"}
LINE_STYLE = {*GLOBAL, "solid", "double", "dotted", "dashed", "wavy"}
INVALID_ALONE = {"left", "right", "baseline"}

Longhands = list[tuple[str, str]]


def _number(p: Part) -> tuple[str, str] | None:
    return parse_unit(p.value) if p.kind == "word" else None


def _bare(p: Part) -> bool:
    got = _number(p)
    return bool(got) and got[1] == ""


def _width(p: Part) -> bool:
    got = _number(p)
    return p.kind == "function" or bool(got) and got[1] in WIDTH_UNITS or p.kind == "word" and p.value in WIDTH_WORDS


def _basis(p: Part) -> bool:
    return p.value == "content" or p.kind == "word" and p.value == "0" or _width(p)


def box(prop: str) -> Callable[[list[Part]], Longhands]:
    """One to four values for the sides, the opposite's where one is missing."""

    def expand(own: list[Part]) -> Longhands:
        v = [str(p) for p in own[:4]]
        v += [v[0], v[0], v[1] if len(v) > 1 else v[0]][len(v) - 1 :]
        return [(f"{prop}-{side}", x) for side, x in zip(SIDES, v, strict=True)]

    return expand


def pair(first: str, second: str) -> Callable[[list[Part]], Longhands]:
    return lambda own: [(first, str(own[0])), (second, str(own[1] if len(own) > 1 else own[0]))]


def place_content(own: list[Part]) -> Longhands:
    if len(own) == 1 and own[0].value in INVALID_ALONE:
        return []
    return pair("align-content", "justify-content")(own)


def flex(own: list[Part]) -> Longhands:
    def longhands(grow: str, shrink: str, basis: str) -> Longhands:
        return [("flex-grow", grow), ("flex-shrink", shrink), ("flex-basis", basis)]

    numbers = [_bare(p) for p in own]
    if len(own) == 1:
        if own[0].value == "none":
            return longhands("0", "0", "auto")
        if numbers[0]:
            return longhands(own[0].value, "1", "0%")
        if _basis(own[0]):
            return longhands("1", "1", str(own[0]))
    elif len(own) == 2 and numbers[0]:
        if numbers[1]:
            return longhands(own[0].value, own[1].value, "0%")
        if _basis(own[1]):
            return longhands(own[0].value, "1", str(own[1]))
    elif len(own) == 3 and numbers[0] and numbers[1] and _basis(own[2]):
        return longhands(own[0].value, own[1].value, "0%" if own[2].value == "0" else str(own[2]))
    return []


def sorted_into(own: list[Part], slots: list[tuple[str, Callable[[Part], bool], str]]) -> Longhands:
    """Each word in the first slot that takes it; none if a word fits nowhere or a slot is taken."""
    found: dict[str, str] = {}
    for p in own:
        if p.kind != "word":
            continue
        slot = next((name for name, takes, _ in slots if takes(p)), None)
        if slot is None or slot in found:
            return []
        found[slot] = p.value
    return [(name, found.get(name, default)) for name, _, default in slots]


def flex_flow(own: list[Part]) -> Longhands:
    return sorted_into(own[:2], [("flex-direction", lambda p: p.value in DIRECTION, "row"), ("flex-wrap", lambda p: p.value in WRAP, "nowrap")])


def outline(own: list[Part]) -> Longhands:
    width = lambda p: p.value in ("thin", "medium", "thick") or bool(_number(p))
    style = lambda p: p.value in OUTLINE_STYLE
    return sorted_into(own[:3], [("outline-color", is_color, "currentColor"), ("outline-style", style, "none"), ("outline-width", width, "medium")])


def text_decoration(own: list[Part]) -> Longhands:
    """The last colour and style count; a line that repeats makes the value invalid."""
    lines, color, style = [], "currentColor", "solid"
    for p in own[:3]:
        if p.kind != "word":
            continue
        if p.value in LINE:
            if p.value in lines:
                return []
            lines.append(p.value)
        elif is_color(p):
            color = p.value
        elif p.value in LINE_STYLE:
            style = p.value
    return [("text-decoration-color", color), ("text-decoration-line", " ".join(sorted(lines)) or "none"), ("text-decoration-style", style)]


SHORTHANDS: dict[str, Callable[[list[Part]], Longhands]] = {
    "margin": box("margin"),
    "padding": box("padding"),
    "overflow": pair("overflow-x", "overflow-y"),
    "place-items": pair("align-items", "justify-items"),
    "place-self": pair("align-self", "justify-self"),
    "place-content": place_content,
    "flex": flex,
    "flex-flow": flex_flow,
    "outline": outline,
    "text-decoration": text_decoration,
}


def expanded(prop: str, value: str) -> Longhands:
    """The longhands of a declaration; itself if it is none of SHORTHANDS or has a variable
    at the top; nothing if the value is invalid. A background that is one colour is its colour."""
    own = words(parse(value))
    if prop == "background" and len(own) == 1 and is_color(own[0]):
        return [("background-color", str(own[0]))]
    if prop not in SHORTHANDS or not own or any(p.kind == "function" and p.value == "var" for p in own):
        return [(prop, value)]
    return SHORTHANDS[prop](own)
