"""Atomic class names and rules."""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..functions.text import name_hash
from ..sources.css import Node

# At-rules by what becomes of them.
ATOMIC = set("container -moz-document else layer media starting-style supports when".split())
FORBIDDEN = {"charset", "import", "namespace"}
IGNORED = set("color-profile counter-style font-face font-palette-values keyframes page property".split())
PREFIX = re.compile(r"^[a-zA-Z\-_]+[a-zA-Z\-_0-9]*$")


class AtomicError(ValueError):
    pass


def class_name(at_rules: str | None, selector: str, prop: str, value: str, important: bool = False, prefix: str = "") -> str:
    """`_` and four characters each for where and what a declaration sets. Where: the at-rules
    (`undefined` if there are none), the selector and the property."""
    group = name_hash(f"{prefix}{at_rules or 'undefined'}{selector}{prop}")[:4]
    return f"_{group}{name_hash(value + ('true' if important else ''))[:4]}"


def anchored(selector: str) -> str:
    selector = selector.strip()
    if not selector:
        return "&"
    return selector if "&" in selector else f"& {selector}"


def is_atomic(name: str) -> bool:
    if name in FORBIDDEN:
        raise AtomicError(f"At-rule '@{name}' cannot be used in CSS rules.")
    if name not in ATOMIC | IGNORED:
        raise AtomicError(f"Unknown at-rule '@{name}'.")
    return name in ATOMIC


def atomic(nodes: list[Node], names: list[str], compressed: Mapping[str, str] | None = None, prefix: str = "") -> list[Node]:
    """A rule for each declaration, in place of flat rules; the classes' full names are added to names."""
    if prefix and not PREFIX.match(prefix):
        raise AtomicError(f"{prefix} isn't a valid CSS identifier")

    def rule(decl: Node, selectors: list[str], label: str | None) -> Node:
        out = []
        for s in map(anchored, selectors or [""]):
            name = class_name(label, s, decl.name, decl.value, decl.important, prefix)
            names.append(name)
            out.append(s.replace("&", "." + ((compressed or {}).get(name[1:]) or name)))
        return Node("rule", selectors=out, children=[decl])

    def down(own: list[Node], label: str | None) -> list[Node]:
        out = []
        for n in own:
            if n.kind == "decl":
                out.append(rule(n, [], label))
            elif n.kind == "rule":
                for c in n.children:
                    if c.kind == "rule":
                        raise AtomicError("Nested rules need to be flattened first")
                    if c.kind == "decl":
                        out.append(rule(c, n.selectors, label))
            elif n.kind == "atrule":
                if is_atomic(n.name) and n.children is not None:
                    out.append(n.but(children=down(n.children, f"{label or ''}{n.name}{n.params}")))
                else:
                    out.append(n)
        return out

    return down(nodes, None)
