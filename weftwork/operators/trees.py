"""Whole-sheet steps on trees: empty rules, duplicates, equal at-rules, comments, declarations."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.css import Node, text_of


def is_empty(value: str) -> bool:
    return value in ("undefined", "null") or not value.strip()


def keep_last(nodes: list[Node]) -> list[Node]:
    """Of the declarations at this level, the last of each property."""
    last = {n.name: k for k, n in enumerate(nodes) if n.kind == "decl"}
    return [n for k, n in enumerate(nodes) if n.kind != "decl" or last[n.name] == k]


def each_declaration(nodes: list[Node], change: Callable[[Node], list[Node]]) -> list[Node]:
    """Every declaration replaced by what change gives; a rule that thereby loses its last child goes."""
    out = []
    for n in nodes:
        if n.kind == "decl":
            out += change(n)
        elif n.children is not None:
            own = each_declaration(n.children, change)
            if own or n.kind != "rule" or not n.children:
                out.append(n.but(children=own))
        else:
            out.append(n)
    return out


def without_comments(nodes: list[Node]) -> list[Node]:
    """Comments go, but those that begin with `!`."""
    return [n.but(children=without_comments(n.children)) if n.children is not None else n for n in nodes if n.kind != "comment" or n.value.startswith("!")]


def identity(node: Node) -> tuple:
    return node.kind, node.name, node.params, tuple(node.selectors), node.value, node.important, tuple(map(identity, node.children)) if node.children is not None else None


def without_duplicates(nodes: list[Node]) -> list[Node]:
    """Right to left: a later equal at-rule or declaration removes an earlier one; a rule
    removes the declarations it repeats from earlier siblings with its selectors, and what
    is then empty."""
    own = [n.but(children=without_duplicates(n.children)) if n.children is not None else n for n in nodes]
    out: list[Node] = []
    seen: set[tuple] = set()
    by_selector: dict[tuple, set[tuple]] = {}
    for n in reversed(own):
        if n.kind == "rule":
            later = by_selector.setdefault(tuple(n.selectors), set())
            kept = [c for c in n.children if c.kind != "decl" or identity(c) not in later]
            later |= {identity(c) for c in n.children if c.kind == "decl"}
            if len(kept) < len(n.children) and all(c.kind == "comment" for c in kept):
                continue
            out.append(n.but(children=kept))
        elif n.kind == "comment":
            out.append(n)
        elif identity(n) not in seen:
            seen.add(identity(n))
            out.append(n)
    return out[::-1]


def merged_at_rules(nodes: list[Node]) -> list[Node]:
    """Root at-rules of one name and params as one, after everything else, in the order of their
    first; of equal children the first."""
    groups: dict[str, tuple[Node, dict[str, Node]]] = {}
    rest = []
    for n in nodes:
        if n.kind != "atrule":
            rest.append(n)
            continue
        _, children = groups.setdefault(n.name + n.params, (n, {}))
        for c in n.children or ():
            children.setdefault(text_of(c), c)
    return rest + [n.but(children=list(children.values()) if n.children is not None else None) for n, children in groups.values()]
