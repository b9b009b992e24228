"""Named colours and the shortest spelling of a colour."""

from __future__ import annotations

import colorsys
import re

from .text import js_number, parse_unit
from .values import Part, parse, rewritten, text_of, words

# The named colours of CSS Color Level 4.
NAMED = dict(
    x.split(":")
    for x in """aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000
    blanchedalmond:ffebcd blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e
    coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b
    darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00
    darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f
    darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff
    firebrick:b22222 floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520
    gray:808080 green:008000 greenyellow:adff2f grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0
    khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080
    lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 lightsalmon:ffa07a
    lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899 lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0
    lime:00ff00 limegreen:32cd32 linen:faf0e6 magenta:ff00ff maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3
    mediumpurple:9370db mediumseagreen:3cb371 mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc
    mediumvioletred:c71585 midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 navajowhite:ffdead navy:000080
    oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98
    paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd powderblue:b0e0e6
    purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460
    seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090
    snow:fffafa springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee
    wheat:f5deb3 white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32""".split()
)
SHORTEST: dict[str, str] = {}
for _name, _hex in NAMED.items():
    if len(_name) < len(SHORTEST.get(_hex, "x" * 99)):
        SHORTEST[_hex] = _name
FUNCTIONS = {"rgb", "rgba", "hsl", "hsla"}
ALSO_COLORS = {"hwb", "lab", "lch", "oklab", "oklch", "color", "color-mix"}
HEX = re.compile(r"^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$", re.I)


def is_color(part: Part) -> bool:
    if part.kind == "function":
        return part.value.lower() in FUNCTIONS | ALSO_COLORS
    return part.kind == "word" and (bool(HEX.match(part.value)) or part.value.lower() in NAMED or part.value in ("transparent", "currentcolor"))


def _channel(text: str, full: float) -> float | None:
    got = parse_unit(text)
    if not got or got[1] not in ("", "%"):
        return None
    return float(got[0]) * (full / 100 if got[1] else 1)


def rgba(part: Part) -> tuple[int, int, int, float] | None:
    """Of a colour that the sRGB spellings can give exactly; None for any other part."""
    if part.kind == "word":
        word = part.value.lower()
        if word == "transparent":
            return 0, 0, 0, 0.0
        digits = NAMED.get(word) or (HEX.match(word) or [None, None])[1]
        if not digits:
            return None
        if len(digits) < 6:
            digits = "".join(c * 2 for c in digits)
        alpha = int(digits[6:], 16) / 255 if len(digits) == 8 else 1.0
        return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:6], 16), alpha
    if part.kind != "function" or part.value.lower() not in FUNCTIONS:
        return None
    own = [x.value for x in words(part.parts) if x.kind == "word"]
    others = [x for x in words(part.parts) if x.kind not in ("word", "div")]
    if others or len(own) not in (3, 4):
        return None
    alpha = _channel(own[3], 1) if len(own) == 4 else 1.0
    if part.value.lower().startswith("rgb"):
        rgb = [_channel(x, 255) for x in own[:3]]
        if alpha is None or None in rgb:
            return None
        r, g, b = (min(255, max(0, int(x + 0.5))) for x in rgb)
        return r, g, b, min(1.0, max(0.0, alpha))
    hue, s, v = parse_unit(own[0]), _channel(own[1], 1), _channel(own[2], 1)
    if alpha is None or s is None or v is None or not hue or hue[1] not in ("", "deg"):
        return None
    got = colorsys.hls_to_rgb(float(hue[0]) % 360 / 360, min(1, max(0, v)), min(1, max(0, s)))
    r, g, b = (int(x * 255 + 0.5) for x in got)
    return r, g, b, min(1.0, max(0.0, alpha))


def _number(x: float) -> str:
    return re.sub(r"^(-?)0\.", r"\1.", js_number(x))


def shortest(color: tuple[int, int, int, float]) -> str:
    """The shortest of name, hex and functional spelling; the earlier of equals."""
    r, g, b, alpha = color
    if (r, g, b, alpha) == (0, 0, 0, 0):
        return "#0000"
    if alpha == 1:
        digits = f"{r:02x}{g:02x}{b:02x}"
        short = digits[::2] if digits[::2] == digits[1::2] else digits
        name = SHORTEST.get(digits)
        return name if name and len(name) < len(short) + 1 else "#" + short
    alpha = round(alpha, 3)
    h, light, s = colorsys.rgb_to_hls(r / 255, g / 255, b / 255)
    options = []
    byte = round(alpha * 255)
    if abs(byte / 255 - alpha) < 0.0005:
        digits = f"{r:02x}{g:02x}{b:02x}{byte:02x}"
        options.append("#" + (digits[::2] if digits[::2] == digits[1::2] else digits))
    options.append(f"rgba({r},{g},{b},{_number(alpha)})")
    h, s, light = round(h * 360), round(s * 100), round(light * 100)
    if tuple(int(x * 255 + 0.5) for x in colorsys.hls_to_rgb(h / 360, light / 100, s / 100)) == (r, g, b):
        options.append(f"hsla({h},{s}%,{light}%,{_number(alpha)})")
    return min(options, key=len)


MATH = {"calc", "min", "max", "clamp", "var", "env", "url"}
NO_COLOR = re.compile(r"^(?:composes|font|src|filter|-webkit-tap-highlight-color)$|^--", re.I)


def minify_colors(prop: str, value: str) -> str:
    """Every colour of a value in its shortest spelling; a space keeps a rewritten function
    apart from a word that follows."""
    if NO_COLOR.search(prop) and prop.lower() != "filter":
        return value

    def change(p: Part) -> Part | None:
        if p.kind == "string":
            return p
        got = rgba(p)
        if got is None:
            return None
        return Part("word", shortest(got))

    parts = rewritten(parse(value), change, lambda p: p.value.lower() not in MATH)
    out: list[Part] = []
    for p in parts:
        if out and p.kind in ("word", "function") and out[-1].kind == "word":
            out.append(Part("space", " "))
        out.append(p)
    return text_of(out)

