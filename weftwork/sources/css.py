"""CSS text as a tree of nodes, as rows of a table, and back as text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..functions.text import comma_list


@dataclass
class Node:
    """kind: root, rule, atrule, decl or comment. A rule has selectors, an at-rule a name and
    params (children None: it has no block), a declaration a name (the property) and a value,
    a comment a value."""

    kind: str
    name: str = ""
    params: str = ""
    selectors: list[str] = field(default_factory=list)
    value: str = ""
    important: bool = False
    children: list[Node] | None = None
    at: int = 0

    def but(self, **changes) -> Node:
        return replace(self, **changes)


class CssError(ValueError):
    pass


TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|url\(\s*[^"'\s)][^)]*\)|\\.|[{};()\[\]]|[^/"'\\{};()\[\]u]+|.""", re.S | re.I)
IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.I)


def squeezed(text: str) -> str:
    """Without comments, and runs of white space as one space."""
    return re.sub(r"\s+", " ", re.sub(r"/\*.*?\*/", "", text, flags=re.S)).strip()


def parse(css: str) -> Node:
    """The tree of a stylesheet or of a block's content. Raises CssError for an unclosed or
    surplus block, or a word that is no declaration."""
    root = Node("root", children=[])
    stack, held, begin, depth = [root], "", 0, 0

    def flush(final: bool) -> None:
        nonlocal held
        text = held.strip()
        held = ""
        if not text:
            return
        if text.startswith("@"):
            name, params = re.match(r"@([\w-]+)(.*)", text, re.S).groups() if re.match(r"@[\w-]+", text) else (text[1:], "")
            stack[-1].children.append(Node("atrule", name, squeezed(params), at=begin))
            return
        prop, colon, value = text.partition(":")
        prop = squeezed(prop)
        if not colon or not prop:
            raise CssError(f"Unknown word at {begin}: {text[:40]}")
        important = bool(IMPORTANT.search(value))
        value = IMPORTANT.sub("", value).strip()
        stack[-1].children.append(Node("decl", prop, value=value, important=important, at=begin))

    for m in TOKEN.finditer(css):
        t = m[0]
        if t.startswith("/*") and not held.strip() and not depth:
            body = t[2:-2] if t.endswith("*/") else None
            if body is None:
                raise CssError(f"Unclosed comment at {m.start()}")
            stack[-1].children.append(Node("comment", value=body.strip(), at=m.start()))
            continue
        if not held.strip():
            begin = m.start() + len(t) - len(t.lstrip())
        if t in "([":
            depth += 1
        elif t in ")]":
            depth = max(0, depth - 1)
        if t == "{" and not depth and not re.match(r"\s*--[\w-]+\s*:", held):
            text = held.strip()
            held = ""
            if text.startswith("@"):
                name, params = re.match(r"@([\w-]*)(.*)", text, re.S).groups()
                node = Node("atrule", name, squeezed(params), children=[], at=begin)
            else:
                node = Node("rule", selectors=[squeezed(s) for s in comma_list(text)], children=[], at=begin)
            stack[-1].children.append(node)
            stack.append(node)
        elif t == "}" and not depth and not re.match(r"\s*--[\w-]+\s*:[^{]*\{[^}]*$", held):
            flush(True)
            if len(stack) == 1:
                raise CssError(f"Unexpected }} at {m.start()}")
            stack.pop()
        elif t == ";" and not depth:
            flush(False)
        else:
            held += t
    flush(True)
    if len(stack) > 1:
        raise CssError(f"Unclosed block at {stack[-1].at}")
    return root


def text_of(node: Node) -> str:
    """The node without white space that says nothing."""
    if node.kind == "decl":
        return f"{node.name}:{node.value}{'!important' if node.important else ''}"
    if node.kind == "comment":
        return f"/*{node.value}*/"
    if node.kind == "root":
        return "".join(text_of(n) + (";" if n.kind == "decl" or n.children is None and n.kind == "atrule" else "") for n in node.children)
    head = f"@{node.name}{' ' + node.params if node.params else ''}" if node.kind == "atrule" else ",".join(node.selectors)
    if node.children is None:
        return head
    out = ""
    for k, n in enumerate(node.children):
        last = k == len(node.children) - 1
        out += text_of(n) + (";" if not last and (n.kind == "decl" or n.children is None and n.kind == "atrule") else "")
    return f"{head}{{{out}}}"


def walk(node: Node, kind: str | None = None) -> Iterator[Node]:
    for n in node.children or ():
        if kind is None or n.kind == kind:
            yield n
        yield from walk(n, kind)


NODE_ROWS = "node_id int, parent_id int, ord int, depth int, kind string, name string, params string, selectors array<string>, value string, important boolean, offset int, ancestors array<string>"


def rows(root: Node) -> list[tuple]:
    """Adjacency rows: node_id in document order, ord among siblings, ancestors by their heads."""
    out: list[tuple] = []

    def down(node: Node, parent: int | None, above: list[str]) -> None:
        for k, n in enumerate(node.children or ()):
            own = len(out)
            out.append((own, parent, k, len(above), n.kind, n.name or None, n.params or None, n.selectors or None, n.value if n.kind in ("decl", "comment") else None, n.important if n.kind == "decl" else None, n.at, above))
            head = "@" + n.name + n.params if n.kind == "atrule" else ", ".join(n.selectors)
            down(n, own, [*above, head])

    down(root, None, [])
    return out
