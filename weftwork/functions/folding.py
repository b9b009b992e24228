"""Constant folding of JavaScript expressions on double columns, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def to_int32(x: Column) -> Column:
    """The number modulo 2^32, as a signed 32-bit integer; 0 for what is not finite."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.when(finite, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    low = F.pmod(whole, F.lit(2**32).cast("decimal(38,0)")).cast("long")
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


BITWISE = {
    "|": lambda a, b: to_int32(a).bitwiseOR(to_int32(b)),
    "&": lambda a, b: to_int32(a).bitwiseAND(to_int32(b)),
    "^": lambda a, b: to_int32(a).bitwiseXOR(to_int32(b)),
    "<<": lambda a, b: F.call_function("shiftleft", to_int32(a), to_int32(b).bitwiseAND(31)),
    ">>": lambda a, b: F.call_function("shiftright", to_int32(a), to_int32(b).bitwiseAND(31)),
    ">>>": lambda a, b: F.call_function("shiftright", F.pmod(to_int32(a).cast("long"), F.lit(2**32)), to_int32(b).bitwiseAND(31)),
}


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend; NaN for a divisor of 0."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.try_mod(a, b))


def divided(a: Column, b: Column) -> Column:
    signed = F.when(a == 0, F.lit(NAN)).when(F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, signed).otherwise(F.try_divide(a, b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "%": remainder, "**": F.pow}
# NaN equals itself in SQL, and is above all; not so here
ORDERED = lambda a, b: ~F.isnan(a) & ~F.isnan(b)
COMPARISON = {"<": lambda a, b: ORDERED(a, b) & (a < b), ">": lambda a, b: ORDERED(a, b) & (a > b), "<=": lambda a, b: ORDERED(a, b) & (a <= b), ">=": lambda a, b: ORDERED(a, b) & (a >= b), "===": lambda a, b: ORDERED(a, b) & (a == b), "!==": lambda a, b: ~(ORDERED(a, b) & (a == b))}


def truthy(x: Column) -> Column:
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


LOGICAL = {"||": lambda a, b: F.when(truthy(a), a).otherwise(b), "&&": lambda a, b: F.when(truthy(a), b).otherwise(a), "??": lambda a, b: F.coalesce(a, b)}
UNARY = {"!": lambda a: ~truthy(a), "+": lambda a: a, "-": lambda a: -a, "~": lambda a: F.bitwise_not(to_int32(a))}


def whole(f):
    """Rounding by f, which goes through 64-bit integers; from 2^53 on every double is whole."""
    return lambda x: F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


MATH = {
    "abs": F.abs, "ceil": whole(F.ceil), "floor": whole(F.floor), "round": whole(lambda x: F.floor(x + 0.5)),
    "trunc": whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))), "sign": F.signum, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "log": F.log,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
}


def maximum(*values: Column) -> Column:
    """-Infinity for none; NaN if any is."""
    return F.greatest(*values) if len(values) > 1 else values[0] if values else F.lit(float("-inf"))


def minimum(*values: Column) -> Column:
    if len(values) < 2:
        return values[0] if values else F.lit(float("inf"))
    odd = F.isnan(values[0])
    for v in values[1:]:
        odd = odd | F.isnan(v)
    return F.when(odd, F.lit(NAN)).otherwise(F.least(*values))


def parse_float(text: Column) -> Column:
    """The number that a text begins with; NaN if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(NAN))


def parse_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("double"), F.lit(NAN))


def number(text: Column) -> Column:
    """Number(): the whole text, 0 if it is blank, else NaN."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    plain = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    return F.when(trimmed == "", 0.0).otherwise(F.coalesce(plain, F.lit(NAN)))
