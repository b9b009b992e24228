"""Rewrites of property values, each a function of (property, value), in the order of MINIFY."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from posixpath import normpath
from urllib.parse import urlsplit, urlunsplit

from .calc import LENGTHS, drop_zero, fold_calc, shortest_length
from .colors import is_color, minify_colors
from .text import parse_unit
from .values import Part, commas, parse, rewritten, text_of, walk, words

Rewrite = Callable[[str, str], str]


def current_color(prop: str, value: str) -> str:
    return "currentColor" if value.lower() in ("currentcolor", "current-color") else value


def discard_comments(prop: str, value: str) -> str:
    """Comments go, but those that begin with `!`."""
    if "/*" not in value:
        return value
    return re.sub(r"/\*(?!!).*?\*/", "", value, flags=re.S).strip()


# Gradient sides and their angles.
SIDES = {"top": "0deg", "right": "90deg", "bottom": "180deg", "left": "270deg"}


def minify_gradients(prop: str, value: str) -> str:
    """Sides become angles, and stop positions that follow from their neighbours go."""
    if "gradient(" not in value.lower():
        return value

    def change(p: Part) -> Part | None:
        if p.kind != "function" or not re.fullmatch(r"(repeating-)?linear-gradient", p.value.lower()):
            return None
        args = commas(p.parts)
        head = words(args[0])
        if len(head) == 2 and head[0].value.lower() == "to" and head[1].value.lower() in SIDES:
            args[0] = [Part("word", SIDES[head[1].value.lower()])]
        stops = [k for k, a in enumerate(args) if words(a) and is_color(words(a)[0])]
        last = None
        for n, k in enumerate(stops):
            own = words(args[k])
            got = parse_unit(own[1].value) if len(own) == 2 and own[1].kind == "word" else None
            if not got:
                last = None
                continue
            number, unit = float(got[0]), got[1]
            if n == 0 and number == 0 or n == len(stops) - 1 and (number, unit) == (100, "%"):
                args[k] = [own[0]]
            elif last and last[1] == unit and number <= last[0]:
                args[k] = [own[0], Part("space", " "), Part("word", "0")]
            last = (number, unit)
        out: list[Part] = []
        for a in args:
            out += [Part("div", ","), *a] if out else a
        return Part("function", p.value, out)

    return text_of(rewritten(parse(value), change))


# Initial values that are longer than the word `initial`, and values that it stands for.
TO_INITIAL = {
    "background-clip": "border-box",
    "background-color": "transparent",
    "background-origin": "padding-box",
    "background-size": "auto auto",
    "border-block-color": "currentcolor",
    "border-block-end-color": "currentcolor",
    "border-block-start-color": "currentcolor",
    "border-bottom-color": "currentcolor",
    "border-collapse": "separate",
    "border-inline-color": "currentcolor",
    "border-inline-end-color": "currentcolor",
    "border-inline-start-color": "currentcolor",
    "border-left-color": "currentcolor",
    "border-right-color": "currentcolor",
    "border-top-color": "currentcolor",
    "box-sizing": "content-box",
    "color": "canvastext",
    "column-rule-color": "currentcolor",
    "font-synthesis": "weight style",
    "image-orientation": "from-image",
    "mask-clip": "border-box",
    "mask-mode": "match-source",
    "mask-origin": "border-box",
    "mask-type": "luminance",
    "ruby-align": "space-around",
    "ruby-merge": "separate",
    "ruby-position": "alternate",
    "text-decoration-color": "currentcolor",
    "text-emphasis-color": "currentcolor",
    "text-emphasis-position": "over right",
    "transform-box": "view-box",
    "transform-origin": "50% 50% 0",
    "vertical-align": "baseline",
    "writing-mode": "horizontal-tb",
}
FROM_INITIAL = dict(x.split("=") for x in """align-items=normal animation-delay=0s animation-direction=normal animation-duration=0s animation-fill-mode=none animation-iteration-count=1 animation-name=none
    background-color=transparent background-image=none background-size=auto border-collapse=separate border-style=none border-width=medium bottom=auto box-shadow=none
    clear=none clip=auto color-scheme=normal column-count=auto column-gap=normal content=normal cursor=auto direction=ltr display=inline empty-cells=show filter=none
    flex-basis=auto flex-direction=row flex-grow=0 flex-shrink=1 flex-wrap=nowrap float=none font-kerning=auto font-size=medium font-stretch=normal font-style=normal
    font-variant=normal font-weight=400 height=auto left=auto letter-spacing=normal line-height=normal list-style-image=none list-style-type=disc margin=0 margin-bottom=0
    margin-left=0 margin-right=0 margin-top=0 mask=none max-height=none max-width=none min-height=auto min-width=auto opacity=1 order=0 orphans=2 outline-style=none
    outline-width=medium overflow=visible padding=0 padding-bottom=0 padding-left=0 padding-right=0 padding-top=0 position=static resize=none right=auto row-gap=normal
    tab-size=8 table-layout=auto text-indent=0 text-shadow=none text-transform=none top=auto transform=none transition-delay=0s transition-duration=0s transition-property=all
    unicode-bidi=normal visibility=visible white-space=normal widows=2 width=auto word-break=normal word-spacing=normal z-index=auto""".split())  # fmt: skip
KEEP_INITIAL = {"writing-mode", "transform-box"}


def reduce_initial(prop: str, value: str, to: Mapping[str, str] = TO_INITIAL, back: Mapping[str, str] = FROM_INITIAL, supported: bool = False) -> str:
    """`initial` for the initial value where that is shorter and supported; the initial value
    for `initial`. The tables are parameters."""
    name, low = prop.lower(), value.lower()
    if name in KEEP_INITIAL:
        return value
    if supported and low == to.get(name):
        return "initial"
    return back.get(name, value) if low == "initial" else value


# The curves that have a name.
CURVES = {(0.25, 0.1, 0.25, 1.0): "ease", (0.0, 0.0, 1.0, 1.0): "linear", (0.42, 0.0, 1.0, 1.0): "ease-in", (0.0, 0.0, 0.58, 1.0): "ease-out", (0.42, 0.0, 0.58, 1.0): "ease-in-out"}


def timing_functions(prop: str, value: str) -> str:
    if not re.match(r"^(-\w+-)?(animation|transition)(-timing-function)?$", prop, re.I):
        return value

    def change(p: Part) -> Part | None:
        if p.kind != "function":
            return None
        own = [x.value for x in words(p.parts) if x.kind != "div"]
        if p.value.lower() == "cubic-bezier" and len(own) == 4:
            try:
                name = CURVES.get(tuple(map(float, own)))
            except ValueError:
                return None
            return Part("word", name) if name else None
        if p.value.lower() == "steps" and own:
            where = own[1].lower() if len(own) > 1 else ""
            if own[0] == "1" and where in ("start", "jump-start"):
                return Part("word", "step-start")
            if own[0] == "1" and where in ("end", "jump-end"):
                return Part("word", "step-end")
            if where in ("end", "jump-end"):
                return Part("function", p.value, [Part("word", own[0])])
        return None

    return text_of(rewritten(parse(value), change))


def calc(prop: str, value: str) -> str:
    return fold_calc(value)


# Where a zero keeps its unit or a percentage its sign.
KEEP_PERCENT = {"max-height", "height", "min-width", "stroke-dasharray"}
KEEP_ZERO = {"line-height", "initial-letter"}
MATH = {"calc", "min", "max", "clamp", "hsl", "hsla"}
CLAMPED = {"opacity", "shape-image-threshold"}


def convert_values(prop: str, value: str) -> str:
    """Numbers without zeros that say nothing, dimensions in their shortest unit, zero lengths
    without a unit."""
    name = prop.lower()
    if "flex" in name or name.startswith("--") or name in ("descent-override", "ascent-override", "font-stretch", "size-adjust", "line-gap-override"):
        return value

    def number(word: str, keep_unit: bool) -> str | None:
        got = parse_unit(word)
        if not got or not re.fullmatch(r"[a-zA-Z%]*", got[1]):
            return None
        x, unit = got
        if float(x) == 0:
            low = unit.lower()
            bare = (low in LENGTHS or low == "%" and name not in KEEP_PERCENT) and not keep_unit and name not in KEEP_ZERO
            return "0" + ("" if bare else unit)
        if name in CLAMPED:
            return drop_zero(str(min(1.0, max(0.0, float(x))))) if not unit else None
        return shortest_length(x, unit)

    def change_in(keep_unit: bool) -> Callable[[Part], Part | None]:
        def change(p: Part) -> Part | None:
            if p.kind == "function":
                if p.value.lower() == "url":
                    return p
                if p.value.lower() in MATH and not keep_unit:
                    return Part("function", p.value, rewritten(p.parts, change_in(True)))
                return None
            if p.kind != "word":
                return None
            new = number(p.value, keep_unit)
            return Part("word", new) if new is not None else None

        return change

    return text_of(rewritten(parse(value), change_in(False)))


STYLES = set("none hidden dotted dashed solid double groove ridge inset outset auto".split())
WIDTHS = {"thin", "medium", "thick"}
BORDERS = re.compile(r"^(border(-(top|right|bottom|left|block|inline|block-start|block-end|inline-start|inline-end))?|outline|column-rule)$")


def _by_rank(parts: list[Part], rank: Callable[[Part], int | None]) -> str | None:
    own = words(parts)
    ranks = [rank(p) for p in own]
    if None in ranks or any(p.kind == "div" for p in own):
        return None
    return " ".join(str(own[k]) for k in sorted(range(len(own)), key=lambda k: (ranks[k], k)))


def _border(p: Part) -> int | None:
    if p.kind == "word" and (p.value.lower() in WIDTHS or parse_unit(p.value)) or p.kind == "function" and p.value.lower() in ("calc", "min", "max", "clamp"):
        return 0
    if p.kind == "word" and p.value.lower() in STYLES:
        return 1
    return 2


def _shadow(parts: list[Part]) -> str | None:
    own = words(parts)
    if any(p.kind == "div" for p in own):
        return None
    return _by_rank(parts, lambda p: 0 if p.value.lower() == "inset" else 1 if p.kind == "word" and parse_unit(p.value) or p.kind == "function" and p.value.lower() == "calc" else 2)


DIRECTIONS, WRAPS = set("row row-reverse column column-reverse".split()), set("nowrap wrap wrap-reverse".split())
TIMINGS = set("ease ease-in ease-in-out ease-out linear step-end step-start".split())


def _time(p: Part) -> bool:
    got = parse_unit(p.value) if p.kind == "word" else None
    return bool(got and got[1].lower() in ("s", "ms"))


def _timing(p: Part) -> bool:
    return p.kind == "word" and p.value.lower() in TIMINGS or p.kind == "function" and p.value.lower() in ("steps", "cubic-bezier", "linear")


def _animation(parts: list[Part]) -> str | None:
    """name, duration, timing, delay, count, direction, fill, play state."""
    slots: list[list[str]] = [[] for _ in range(8)]
    sets = [set("normal reverse alternate alternate-reverse".split()), set("none forwards backwards both".split()), {"running", "paused"}]
    for p in words(parts):
        low = p.value.lower()
        if p.kind == "div":
            return None
        if _time(p):
            slots[1 if not slots[1] else 3].append(str(p))
        elif _timing(p):
            slots[2].append(str(p))
        elif low == "infinite" or p.kind == "word" and re.fullmatch(r"\d*\.?\d+", low):
            slots[4].append(str(p))
        else:
            k = next((k for k, s in enumerate(sets) if low in s and not slots[5 + k]), None)
            slots[0 if k is None else 5 + k].append(str(p))
    return " ".join(x for s in slots for x in s)


def _transition(parts: list[Part]) -> str | None:
    """property, duration, timing, delay."""
    slots: list[list[str]] = [[] for _ in range(4)]
    for p in words(parts):
        if p.kind == "div":
            return None
        slots[(1 if not slots[1] else 3) if _time(p) else 2 if _timing(p) else 0].append(str(p))
    return " ".join(x for s in slots for x in s)


LISTS = set("inside outside".split())


def ordered_values(prop: str, value: str) -> str:
    """The parts of a shorthand in their canonical order. Values with variables, comments or
    loader marks stay as they are."""
    name = re.sub(r"^-\w+-", "", prop.lower())
    parts = parse(value)
    if any(p.kind == "comment" or p.kind == "function" and p.value.lower() in ("var", "env", "constant") or "___CSS_LOADER" in p.value for p in walk(parts)):
        return value
    each: Callable[[list[Part]], str | None] | None = None
    if BORDERS.match(name):
        each = lambda x: _by_rank(x, _border)
    elif name == "box-shadow":
        each = _shadow
    elif name == "flex-flow":
        each = lambda x: _by_rank(x, lambda p: 0 if p.value.lower() in DIRECTIONS else 1 if p.value.lower() in WRAPS else None)
    elif name == "animation":
        each = _animation
    elif name == "transition":
        each = _transition
    elif name == "list-style":
        each = lambda x: _by_rank(x, lambda p: 1 if p.value.lower() in LISTS else 2 if p.kind == "function" else 0)
    elif name == "columns":
        each = lambda x: _by_rank(x, lambda p: 1 if re.fullmatch(r"\d+", p.value) else 0)
    elif name == "grid-auto-flow":
        each = lambda x: _by_rank(x, lambda p: 1 if p.value.lower() == "dense" else 0 if p.value.lower() in ("row", "column") else None)
    elif name in ("grid-column-gap", "grid-row-gap"):
        each = lambda x: _by_rank(x, lambda p: 0 if p.value.lower() == "normal" else 1)
    elif name in ("grid-column", "grid-row", "grid-column-start", "grid-column-end", "grid-row-start", "grid-row-end"):
        sides = [re.sub(r"^(.*\S)\s+span$", r"span \1", x.strip()) for x in value.split("/")]
        return "/".join(sides)
    if not each or not parts:
        return value
    out = [each(x) for x in commas(parts)]
    return value if None in out else ",".join(out)


def normalize_string(prop: str, value: str) -> str:
    """Double quotes, unless single ones spare escapes; line continuations go."""

    def change(p: Part) -> Part | None:
        if p.kind != "string":
            return None
        body = p.value.replace("\\\n", "")
        double, single = body.count('"') - body.count('\\"'), body.count("'") - body.count("\\'")
        if p.quote == "'" and not double:
            return Part("string", body.replace("\\'", "'"), quote='"')
        if p.quote == '"' and '\\"' in body and not single and not double:
            return Part("string", body.replace('\\"', '"'), quote="'")
        return Part("string", body, quote=p.quote)

    return text_of(rewritten(parse(value), change)) if "'" in value or '"' in value else value


def unicode_range(prop: str, value: str) -> str:
    """Lower case, and a range of all values of its last digits as question marks."""
    if prop.lower() != "unicode-range":
        return value

    def one(x: str) -> str:
        m = re.fullmatch(r"u\+([0-9a-f?]+)(?:-([0-9a-f]+))?", x.strip().lower())
        if not m or not m[2]:
            return x.strip().lower()
        low, high = m[1], m[2]
        width = max(len(low), len(high))
        low, high = low.zfill(width), high.zfill(width)
        k = width
        while k and low[k - 1] == "0" and high[k - 1] == "f":
            k -= 1
        marks = width - k
        if not 1 <= marks <= 5 or low[:k] != high[:k]:
            return x.strip().lower()
        return "u+" + low[:k].lstrip("0") + "?" * marks

    return ",".join(map(one, value.split(",")))


PLAIN_URL = re.compile(r"""[\s()'"]""")


def normalize_url_text(url: str) -> str:
    url = url.strip()
    if re.match(r"^(data:|[a-z-]+-extension://)", url, re.I) or not url or url.startswith("#"):
        return url
    if re.match(r"^([a-z][a-z0-9+.-]*:)?//", url, re.I):
        try:
            got = urlsplit(url)
            port = got.port
        except ValueError:
            return url
        default = {"http": 80, "https": 443}.get(got.scheme.lower())
        host = (got.hostname or "").rstrip(".") + (f":{port}" if port and port != default else "")
        path = re.sub(r"(?<!:)/{2,}", "/", got.path)
        path = normpath(path) + ("/" if path.endswith("/") and path != "/" else "") if path else ""
        out = urlunsplit((got.scheme.lower(), host, "" if path == "/" and not got.query else path, got.query, got.fragment))
        return out
    path, mark, rest = re.match(r"([^?#]*)([?#]?)(.*)", url, re.S).groups()
    if path:
        end = "/" if path.endswith("/") and path != "/" else ""
        path = normpath(path) + end
    return path + mark + rest


def normalize_url(prop: str, value: str) -> str:
    """Paths without dot segments, hosts in lower case, no quotes where none are needed."""
    if "url(" not in value.lower():
        return value

    def change(p: Part) -> Part | None:
        if p.kind != "function" or p.value.lower() != "url" or len(p.parts) != 1 or p.parts[0].kind not in ("word", "string"):
            return None
        own = p.parts[0]
        url = normalize_url_text(own.value)
        quoted = own.kind == "string" and PLAIN_URL.search(url)
        return Part("function", "url", [Part("string", url, quote=own.quote) if quoted else Part("word", url)])

    return text_of(rewritten(parse(value), change))


# Positions as percentages.
ACROSS, DOWN = {"left": "0", "center": "50%", "right": "100%"}, {"top": "0", "center": "50%", "bottom": "100%"}
POSITIONED = re.compile(r"^(background(-position)?|(-\w+-)?perspective-origin|(-\w+-)?transform-origin|object-position)$")


def normalize_positions(prop: str, value: str) -> str:
    name = prop.lower()
    if not POSITIONED.match(name):
        return value

    def one(parts: list[Part]) -> str:
        every = words(parts)
        at = [k for k, p in enumerate(every) if p.kind == "word" and (p.value.lower() in ACROSS or p.value.lower() in DOWN or parse_unit(p.value) and parse_unit(p.value)[1].lower() in LENGTHS | {"%", ""})]
        slash = next((k for k, p in enumerate(every) if p.kind == "div" and p.value == "/"), len(every))
        at = [k for k in at if k < slash]
        if not at or len(at) > 2 or at != list(range(at[0], at[0] + len(at))):
            return text_of(parts)
        own = [every[k].value.lower() for k in at]
        new = own
        if len(own) == 1:
            new = [ACROSS.get(own[0], own[0])] if own[0] not in ("top", "bottom") else own
        else:
            x, y = own
            if x in ("top", "bottom") or (x == "center" and y in ("left", "right")):
                x, y = y, x
            if x in ("top", "bottom") or y in ("left", "right"):
                return text_of(parts)
            new = [ACROSS.get(x, x), DOWN.get(y, y)]
            if new[1] == "50%" and own[1] == "center":
                new = new[:1]
        every[at[0] : at[-1] + 1] = [Part("word", w) for w in new]
        return " ".join(map(str, every)).replace(" / ", "/")

    return ",".join(one(x) for x in commas(parse(value)))


#: The minifying rewrites in the order in which they run.
MINIFY: list[tuple[str, Rewrite]] = [
    ("discard-comments", discard_comments),
    ("minify-gradients", minify_gradients),
    ("reduce-initial", reduce_initial),
    ("colormin", minify_colors),
    ("timing-functions", timing_functions),
    ("calc", calc),
    ("convert-values", convert_values),
    ("ordered-values", ordered_values),
    ("normalize-string", normalize_string),
    ("normalize-unicode", unicode_range),
    ("normalize-url", normalize_url),
    ("normalize-positions", normalize_positions),
]


def minified(prop: str, value: str) -> str:
    """All rewrites; a custom property is left alone but for its comments."""
    if prop.startswith("--"):
        return discard_comments(prop, value)
    for _, rewrite in MINIFY:
        value = rewrite(prop, value)
    return text_of(parse(value))
