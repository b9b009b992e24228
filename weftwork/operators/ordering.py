"""The order of rules: shorthands before longhands, pseudo-classes, at-rules by their conditions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cmp_to_key

from ..sources.css import Node

# The order of pseudo-classes, of shorthands by depth, and of conditions.
PSEUDOS = [":link", ":visited", ":focus-within", ":focus", ":focus-visible", ":hover", ":active"]
DEPTHS = [
    "all",
    """animation animation-range background border border-image border-radius column-rule columns contain-intrinsic-size container flex flex-flow font
    font-synthesis gap grid grid-area inset list-style margin mask mask-border offset outline overflow overscroll-behavior padding place-content
    place-items place-self position-try scroll-margin scroll-padding scroll-timeline text-decoration text-emphasis text-wrap transition view-timeline""",
    """border-color border-style border-width font-variant grid-column grid-row grid-template inset-block inset-inline margin-block margin-inline
    padding-block padding-inline scroll-margin-block scroll-margin-inline scroll-padding-block scroll-padding-inline""",
    "border-block border-inline",
    "border-top border-right border-bottom border-left",
    "border-block-start border-block-end border-inline-start border-inline-end",
]
DEPTH = {name: k for k, names in enumerate(DEPTHS) for name in names.split()}
WEIGHT = {">": 10, ">=": 20, "<": 30, "<=": 40, "=": 50, "width": 1, "height": 2, "device-width": 101, "device-height": 102}
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
PROPERTY = r"(?P<property>(?:(?:min|max)-)?(?:device-)?(?:width|height))\s*"
LENGTH = r"(?P<length>-?\d*\.?\d+)(?P<unit>ch|em|ex|px|rem)?\s*"
OPERATOR = r"(?P<operator><=?|>=?|=)\s*"
FORMS = [re.compile(PROPERTY + r":\s*" + LENGTH), re.compile(LENGTH + OPERATOR + PROPERTY), re.compile(PROPERTY + OPERATOR + LENGTH)]
PIXELS = {"ch": 8.0, "ex": 8.0, "em": 16.0, "rem": 16.0, "px": 1.0}

Condition = tuple[str, str, float]  # property, operator, pixels


def pseudo_rank(selector: str) -> int:
    """1-based place of the first of PSEUDOS that ends the selector; 0 if none does."""
    return next((k for k, p in enumerate(PSEUDOS, 1) if selector.strip().endswith(p)), 0)


def conditions(params: str) -> list[Condition]:
    """The size conditions of a query, in order. One at the very beginning is left out, and so is
    one without a unit unless it is 0."""
    found = []
    for form, pattern in enumerate(FORMS):
        for m in pattern.finditer(params):
            prop, op = m["property"], m.groupdict().get("operator")
            if form == 0:
                side, _, rest = prop.partition("-")
                if side not in ("min", "max"):
                    raise ValueError(f"Unexpected property '{prop}' found when sorting media queries")
                prop, op = rest, ">=" if side == "min" else "<="
            elif prop not in WEIGHT:
                raise ValueError(f"Unexpected property '{prop}' found when sorting media queries.")
            elif form == 1:
                op = FLIP[op]
            if m["length"] != "0" and m["unit"] is None or not m.start():
                continue
            found.append((m.start(), (prop, op, 0.0 if m["length"] == "0" else float(m["length"]) * PIXELS[m["unit"]])))
    return [c for _, c in sorted(found, key=lambda x: x[0])]


def collated(text: str) -> tuple:
    """A key that orders as English collation does for ASCII: letters before case, punctuation first."""
    return [(1, c.lower()) if c.isalpha() else (0, str("_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789".find(c)).zfill(3)) for c in text], [c.isupper() for c in text]


def compare_queries(x: tuple[str, list[Condition], str], y: tuple[str, list[Condition], str]) -> int:
    """Of (name, conditions, params): by name, then by conditions pair by pair, then by their number, then by params."""
    order = lambda a, b: (a > b) - (a < b)
    if by_name := order(collated(x[0]), collated(y[0])):
        return by_name
    for (p, op, size), (q, other, length) in zip(x[1], y[1], strict=False):
        if by := order(WEIGHT[p] + WEIGHT[op], WEIGHT[q] + WEIGHT[other]):
            return by
        if by := order(size, length):
            return by if ">" in op else -by
    return order(len(x[1]), len(y[1])) or order(collated(x[2]), collated(y[2]))


def first_declaration(node: Node) -> Node | None:
    if node.kind == "decl":
        return node
    return next((c for c in node.children or () if c.kind == "decl"), None)


def by_shorthand(nodes: list[Node]) -> list[Node]:
    """Broader shorthands first, at all levels. A node without a declaration compares as equal
    to any other, so the order is that of a stable comparison sort."""

    def compare(x: Node, y: Node) -> int:
        a, b = first_declaration(x), first_declaration(y)
        if not a or not b:
            return 0
        a, b = DEPTH.get(a.name, 99), DEPTH.get(b.name, 99)
        return (a > b) - (a < b)

    nodes = [n.but(children=by_shorthand(n.children)) if n.children else n for n in nodes]
    return sorted(nodes, key=cmp_to_key(compare))


def by_pseudo(rules: list[Node]) -> list[Node]:
    return sorted(rules, key=lambda r: pseudo_rank(r.selectors[0] if r.selectors else ""))


def sorted_sheet(nodes: list[Node], at_rules: bool = True, shorthand: bool = True) -> list[Node]:
    """Everything else, then rules, then at-rules; a rule that begins with an at-rule counts as one."""
    rest: list[Node] = []
    rules: list[Node] = []
    conditional: list[Node] = []
    for n in nodes:
        nested = n.kind == "rule" and n.children and n.children[0].kind == "atrule"
        (conditional if nested or n.kind == "atrule" else rules if n.kind == "rule" else rest).append(n)
    order: Callable[[list[Node]], list[Node]] = by_shorthand if shorthand else list
    rest, rules, conditional = order(rest), order(rules), order(conditional)
    rules = by_pseudo(rules)
    if at_rules:
        heads = [n if n.kind == "atrule" else next((c for c in n.children if c.kind == "atrule"), n) for n in conditional]
        keys = [(h.name, conditions(h.params), h.params) for h in heads]
        places = sorted(range(len(keys)), key=cmp_to_key(lambda a, b: compare_queries(keys[a], keys[b])))
        conditional = [conditional[k] for k in places]

    def inside(at: Node) -> Node:
        if at.kind != "atrule" or at.children is None:
            return at
        own = [inside(c) if c.kind == "atrule" else c for c in at.children if c.kind != "rule"]
        return at.but(children=own + by_pseudo([c for c in at.children if c.kind == "rule"]))

    return rest + rules + [inside(n) for n in conditional]
