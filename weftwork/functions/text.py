"""Text primitives: class-name hash, number formatting, list splitting, units, case."""

from __future__ import annotations

import re
from collections.abc import Iterator

MASK = 0xFFFFFFFF
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    out = DIGITS[n % 36]
    while n := n // 36:
        out = DIGITS[n % 36] + out
    return out


def name_hash(text: str, seed: int = 0) -> str:
    """32-bit MurmurHash2 over the low bytes of the UTF-16 code units, in base 36."""
    low = text.encode("utf-16-le", "surrogatepass")[::2]
    m = 0x5BD1E995
    h = seed ^ len(low)
    whole = len(low) // 4 * 4
    for at in range(0, whole, 4):
        k = int.from_bytes(low[at : at + 4], "little") * m & MASK
        h = (h * m ^ (k ^ k >> 24) * m) & MASK
    if rest := low[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * m & MASK
    h = (h ^ h >> 13) * m & MASK
    return base36(h ^ h >> 15)


def js_number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = f"{x!r}".partition("e")
    if not power and abs(x) >= 1e-6:
        return digits
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits.lstrip("0").rstrip("0"), point - lead
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    power = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if power >= 0 else '-'}{abs(power)}"


def split_list(text: str, separators: str, last: bool = False) -> list[str]:
    """Parts between separators that are outside quotes and parentheses, trimmed. Empty parts
    are left out, but for the last one if `last`."""
    parts, held, depth, quote, skip = [], "", 0, "", False
    for c in text:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c in separators and not depth:
            if held.strip():
                parts.append(held.strip())
            held = ""
            continue
        held += c
    if last or held.strip():
        parts.append(held.strip())
    return parts


def comma_list(text: str) -> list[str]:
    return split_list(text, ",", last=True)


def space_list(text: str) -> list[str]:
    return split_list(text, " \n\t")


UNIT = re.compile(r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(.*)$", re.S)


def parse_unit(text: str) -> tuple[str, str] | None:
    """(number, unit) as written; the number stays text. None if it does not begin with a number."""
    m = UNIT.match(text)
    return (m[1], m[2]) if m else None


UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


def kebab_case(text: str) -> str:
    return UPPER.sub(lambda m: "-" + m[0].lower(), text)


def unprefixed(name: str) -> str:
    return re.sub(r"^-\w+-", "", name)


def vendor_prefix(name: str) -> str:
    m = re.match(r"^(-\w+-)", name)
    return m[1] if m else ""


# The letters of short class names, in order.
FIRST = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"
LATER = FIRST + "-0123456789"


def short_names(reserved: set[str] = frozenset(), prefix: str = "") -> Iterator[str]:
    """Short class names in order: a letter, then bijective base-64 digits, least first. Reserved
    names are left out, and so is every name with `ad` in it, which blockers hide."""
    if prefix and (len(prefix) > 1 or prefix not in FIRST):
        raise ValueError(f"{prefix!r} is not a valid prefix: [a-zA-Z_]")
    n = 0
    while True:
        rest = n + 1 if prefix else n // len(FIRST)
        name = prefix or FIRST[n % len(FIRST)]
        while rest:
            rest, digit = divmod(rest - 1, len(LATER))
            name += LATER[digit]
        n += 1
        if name not in reserved and "ad" not in name.lower():
            yield name
