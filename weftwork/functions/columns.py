"""Column functions, all of them built-in expressions but for the hash."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ordering import DEPTH, PSEUDOS
from .text import name_hash

# CSS units, and properties whose numbers have no unit.
UNITS = "em ex cap ch ic rem lh rlh vw vh vi vb vmin vmax cm mm Q in pc pt px deg grad rad turn s ms Hz kHz dpi dpcm dppx x fr %".split()
UNITLESS = set(
    """animationIterationCount basePalette borderImageOutset borderImageSlice borderImageWidth boxFlex boxFlexGroup boxOrdinalGroup columnCount columns flex
    flexGrow flexPositive flexShrink flexNegative flexOrder fontSizeAdjust fontWeight gridArea gridRow gridRowEnd gridRowSpan gridRowStart gridColumn gridColumnEnd
    gridColumnSpan gridColumnStart lineClamp lineHeight opacity order orphans tabSize WebkitLineClamp widows zIndex zoom fillOpacity floodOpacity stopOpacity
    strokeDasharray strokeDashoffset strokeMiterlimit strokeOpacity strokeWidth""".split()
)
BUCKETS = ["s-0", "s-1", "s-2", "s-3", "s-4", "s-5", "", "l", "v", "w", "f", "i", "h", "a", "m"]
PSEUDO_BUCKETS = {"k": "l", "ited": "v", "us-within": "w", "us": "f", "us-visible": "i", "er": "h", "ive": "a"}


def hashed(text: Column | str) -> Column:
    """The class-name hash of a string column."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        once = texts.dictionary_encode()
        names = pa.array([None if x is None else name_hash(x) for x in once.dictionary.to_pylist()], pa.string())
        return names.take(once.indices)

    return run(text)


def class_name(at_rules: Column, selector: Column, prop: Column, value: Column, important: Column, prefix: str = "") -> Column:
    group = hashed(F.concat(F.lit(prefix), F.coalesce(at_rules, F.lit("undefined")), selector, prop))
    own = hashed(F.concat(value, F.when(important, "true").otherwise("")))
    return F.concat(F.lit("_"), F.substring(group, 1, 4), F.substring(own, 1, 4))


def kebab_case(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "([A-ZÀ-ÖØ-Þ])", "-$1"))


def unprefixed(x: Column) -> Column:
    return F.regexp_replace(x, r"^-\w+-", "")


def vendor_prefix(x: Column) -> Column:
    return F.regexp_extract(x, r"^(-\w+-)", 1)


def current_color(x: Column) -> Column:
    return F.when(F.lower(x).isin("currentcolor", "current-color"), "currentColor").otherwise(x)


def is_empty(x: Column) -> Column:
    return x.isNull() | x.isin("undefined", "null") | x.rlike(r"(?U)^\s*$")


def with_unit(prop: Column, number: Column, text: Column) -> Column:
    """The text of a value; px after a number other than 0 of a property that has units."""
    bare = prop.isin(*sorted(UNITLESS)) | prop.startswith("--")
    return F.when(text.isNull(), "").when(number.isNotNull() & (number != 0) & ~bare, F.concat(text, F.lit("px"))).otherwise(F.btrim(text))


def variable_suffix(after: Column) -> Column:
    """The unit or quote that follows an interpolation and belongs to its value."""
    return F.regexp_extract(after, "^(" + "|".join(sorted(UNITS, key=lambda u: UNITS.index(u))) + '|"|\')(;|,|\\n| |\\))?', 1)


def variable_prefix(before: Column) -> Column:
    return F.regexp_extract(before, "([\"'-])$", 1)


def content_value(x: Column) -> Column:
    plain = x.contains('"') | x.contains("'") | x.rlike(r"^(?s:[A-Za-z\-]+\(.*|.*-quote|inherit|initial|none|normal|revert|unset)(\s|$)")
    return F.when(x.isNull() | (x == ""), '""').when(plain, x).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


def variable_value(value: Column, suffix: Column, prefix: Column) -> Column:
    has = suffix.isNotNull() & (suffix != "")
    return F.when(value.isNull(), "var(--c-, )").when(has, F.concat(F.coalesce(prefix, F.lit("")), value, suffix)).otherwise(value)


def compressed(name: Column, short: Column) -> Column:
    """`_aaaabbbb` and its short name as `_aaaa_short`; the name where there is none."""
    return F.coalesce(F.concat(F.substring(name, 1, 5), F.lit("_"), short), name)


def shorthand_depth(prop: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in DEPTH.items() for x in kv))
    return F.try_element_at(table, prop)


def pseudo_rank(selector: Column) -> Column:
    trimmed = F.btrim(selector)
    return reduce(lambda out, k: out.when(trimmed.endswith(PSEUDOS[k]), k + 1), range(1, len(PSEUDOS)), F.when(trimmed.endswith(PSEUDOS[0]), 1)).otherwise(0)


def bucket(sheet: Column) -> Column:
    """The style bucket that a sheet goes to: at-rules, pseudo-classes, shorthands by depth, the rest."""
    brace = F.instr(sheet, "{")
    table = F.create_map(*(F.lit(x) for kv in PSEUDO_BUCKETS.items() for x in kv))
    pseudo = F.when(F.substring(sheet, 11, 1) == ":", F.try_element_at(table, F.substr(sheet, F.lit(15), brace - 15)))
    prop = F.btrim(F.regexp_extract(sheet, r"^[^{]*\{([^:]*):", 1))
    depth = F.concat(F.lit("s-"), shorthand_depth(prop).cast("string"))
    return F.when(sheet.startswith("@"), "m").otherwise(F.coalesce(pseudo, depth, F.lit("")))


def bucket_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BUCKETS)), name)


def shortest(candidates: Column) -> Column:
    """The shortest of an array of strings; of equals the last."""
    return F.aggregate(candidates, F.element_at(candidates, 1), lambda best, x: F.when(F.length(best) < F.length(x), best).otherwise(x))


def box_sides(value: Column) -> Column:
    """top, right, bottom, left of a one- to four-valued shorthand, as an array."""
    v = F.split(F.btrim(value), r"\s+")
    top, at = F.element_at(v, 1), lambda k: F.try_element_at(v, F.lit(k))
    right = F.coalesce(at(2), top)
    return F.array(top, right, F.coalesce(at(3), top), F.coalesce(at(4), right))
