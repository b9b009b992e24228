"""Selectors: nesting, pseudo parents, minifying, specificity, and media queries' params."""

from __future__ import annotations

import re
from math import gcd

from .text import comma_list, split_list

NESTING = re.compile(r"&+")
#: Appended to a class to raise its specificity by an id.
SPECIFICITY = ":not(#\\#)"


def nested(parents: list[str], children: list[str]) -> list[str]:
    """Every child under every parent, parent-major. A child's `&` are the parent (of several
    side by side, the first); a child without one is a descendant."""
    if not parents:
        return children
    return [NESTING.sub(lambda m, p=p: p + m[0][1:], c) if "&" in c else f"{p} {c}" for p in parents for c in children]


PSEUDO = re.compile(r"\[[^\]]*\]|\"[^\"]*\"|'[^']*'|\\.|(::?)(?=[\w-])")


def with_parents(selector: str) -> str:
    """`&` before every pseudo of a selector that begins with one."""
    if not selector.startswith(":"):
        return selector
    return PSEUDO.sub(lambda m: "&" + m[0] if m[1] else m[0], selector)


CLASS = re.compile(r"\\.|\[[^\]]*\]|(\.-?[A-Za-z_\u0080-\uffff](?:[\w\u0080-\uffff-]|\\.)*)")


def more_specific(selector: str) -> str:
    if "._" not in selector:
        return selector
    return CLASS.sub(lambda m: m[0] + SPECIFICITY if m[1] else m[0], selector)


# Pseudo-elements of one colon, and nth forms with a shorter name.
ONE_COLON = {"::before", "::after", "::first-letter", "::first-line"}
NTH = {":nth-child": ":first-child", ":nth-of-type": ":first-of-type", ":nth-last-child": ":last-child", ":nth-last-of-type": ":last-of-type"}
PIECE = re.compile(r"""\\.|(?P<attr>\[[^\]]*\])|(?P<string>"[^"]*"|'[^']*')|(?P<pseudo>::?[\w-]+)(?P<args>\()?|(?P<comb>\s*[>+~]\s*|\s+)|(?P<other>[^\\\[\]"'():>+~\s]+|.)""", re.S)


def minify_selector(selector: str, keyframes: bool = False) -> str:
    """One selector without white space, quotes and stars that say nothing."""
    selector = selector.strip()
    if selector.endswith(":"):
        return selector
    if keyframes:
        return {"from": "0%", "100%": "to"}.get(selector.lower(), selector.lower())
    out, at = "", 0
    while at < len(selector):
        m = PIECE.match(selector, at)
        at = m.end()
        if m["attr"]:
            a = re.sub(r"\s*([~|^$*]?=)\s*", r"\1", m["attr"][1:-1].strip())
            out += "[" + re.sub(r"""=(["'])([A-Za-z_\u0080-\uffff][\w\u0080-\uffff-]*)\1(\s*[is])?$""", lambda q: "=" + q[2] + (" " + q[3].strip() if q[3] else ""), a) + "]"
        elif m["pseudo"]:
            name = m["pseudo"].lower() if m["pseudo"].lower() in ONE_COLON or m["pseudo"].lower() in NTH else m["pseudo"]
            if name in ONE_COLON:
                name = name[1:]
            if not m["args"]:
                out += name
                continue
            depth, end = 1, at
            while end < len(selector) and depth:
                depth += {"(": 1, ")": -1}.get(selector[end], 0)
                end += 1
            inner, at = selector[at : end - 1].strip(), end
            if name in NTH:
                inner = re.sub(r"\s+", "", inner.lower())
                if inner == "1":
                    out += NTH[name]
                    continue
                inner = {"even": "2n", "2n+1": "odd"}.get(inner, inner)
            elif ":" in name:
                inner = ",".join(minify_selector(s) for s in comma_list(inner)) if re.search(r"is|where|not|has|matches", name) else inner
            out += f"{name}({inner})"
        elif m["comb"]:
            c = m["comb"].strip()
            if out:
                out += c or " "
            else:
                out = c
        else:
            out += m[0]
    out = out.strip()
    return re.sub(r"(^|[ >+~(,])\*(?=[.#\[:])", r"\1", out)


def minify_selectors(selectors: list[str], keyframes: bool = False) -> list[str]:
    """Minified, each once, in order of code points."""
    return sorted({minify_selector(s, keyframes) for s in selectors})


def minify_params(name: str, params: str) -> str:
    """Of @media and @supports: no white space that says nothing, ratios in lowest terms, no
    needless `all and`, queries each once and in order."""
    if name.lower() not in ("media", "supports"):
        return params

    def one(query: str) -> str:
        q = re.sub(r"\s+", " ", query.strip())
        q = re.sub(r"\s*([:,()])\s*", r"\1", q)
        q = re.sub(r"(?<=[\w)])\((?!selector)", lambda m: "(", q)
        q = re.sub(r"\b(and|or|not|only)\(", r"\1 (", q)
        q = re.sub(r"\)(and|or)\b", r") \1", q)
        q = re.sub(r"\s*(>=|<=|=|>|<)\s*", r"\1", q)
        q = re.sub(r"(aspect-ratio:)\s*(\d+)\s*/\s*(\d+)", lambda m: f"{m[1]}{int(m[2]) // gcd(int(m[2]), int(m[3]))}/{int(m[3]) // gcd(int(m[2]), int(m[3]))}", q)
        return re.sub(r"^all and ", "", q) if name.lower() == "media" else q

    return ",".join(sorted(set(map(one, split_list(params, ",")))))
