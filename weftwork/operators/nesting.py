"""Nested rules to flat ones."""

from __future__ import annotations

from ..functions.selectors import nested
from ..sources.css import Node

# At-rules that keep their rules around a nested block, and those that leave it whole.
BUBBLE = set("media supports container -moz-document layer else when starting-style".split())
UNWRAP = set("document font-face keyframes -webkit-keyframes -moz-keyframes color-profile counter-style font-palette-values page property".split())


def flat(rule: Node) -> list[Node]:
    """The rules that a rule with nested ones stands for, in source order. Declarations after a
    nested block get a rule of their own, so that their order to it stays."""
    out: list[Node] = []
    own: list[Node] = []

    def close() -> None:
        nonlocal own
        if any(c.kind == "decl" for c in own) or own:
            out.append(rule.but(children=own))
        own = []

    for c in rule.children:
        if c.kind == "rule":
            close()
            out += flat(c.but(selectors=nested(rule.selectors, c.selectors)))
        elif c.kind == "atrule" and c.name == "at-root":
            close()
            inner = c.children or []
            out += flattened([Node("rule", selectors=[c.params], children=inner)] if c.params else inner)
        elif c.kind == "atrule" and c.children is not None and c.name in BUBBLE:
            close()
            out.append(bubbled(c, rule))
        elif c.kind == "atrule" and c.children is not None and c.name in UNWRAP:
            close()
            out.append(c)
        else:
            own.append(c)
    if own or not out:
        out.append(rule.but(children=own))
    return out


def bubbled(at: Node, rule: Node) -> Node:
    """The at-rule around the rule: its declarations in one rule, first, then what was nested."""
    decls = [c for c in at.children if c.kind == "decl"]
    out = [rule.but(children=decls)] if decls else []
    for c in at.children:
        if c.kind == "rule":
            out += flat(c.but(selectors=nested(rule.selectors, c.selectors)))
        elif c.kind == "atrule" and c.children is not None and c.name in BUBBLE:
            out.append(bubbled(c, rule))
        elif c.kind != "decl":
            out.append(c)
    return at.but(children=out)


def flattened(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if n.kind == "rule":
            out += flat(n)
        elif n.kind == "atrule" and n.children is not None and n.name not in UNWRAP:
            out.append(n.but(children=flattened(n.children)))
        else:
            out.append(n)
    return out
