"""Vendor prefixes, from the user's support data: tables of what to add and what to remove, and
both on trees and on declaration rows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comma_list, space_list, vendor_prefix
from ..sources.css import Node


def prefixed(nodes: list[Node], table: Mapping[str, list[str]]) -> list[Node]:
    """Each declaration of a property in the table after its prefixed clones, unless one
    stands beside it already; at-rules and selectors likewise (`@keyframes`, `::placeholder`).
    A prefixed parent gives only its own prefix."""
    if not table:
        return nodes

    def down(own: list[Node], parent: str) -> list[Node]:
        out: list[Node] = []
        present = {n.name for n in own if n.kind == "decl"}
        for n in own:
            mark = vendor_prefix(n.name) if n.kind == "atrule" else ""
            if n.children is not None:
                n = n.but(children=down(n.children, mark or parent))
            if n.kind == "decl":
                marks = [p for p in table.get(n.name, []) if p + n.name not in present and (not parent or p == parent)]
                out += [n.but(name=p + n.name) for p in marks]
            elif n.kind == "atrule" and not mark:
                names = {m.name for m in own if m.kind == "atrule" and m.params == n.params}
                out += [n.but(name=p + n.name, children=None if n.children is None else only(n.children, p)) for p in table.get("@" + n.name, []) if p + n.name not in names]
            elif n.kind == "rule":
                for pseudo, marks in table.items():
                    if pseudo.startswith(":") and any(s.endswith(pseudo) for s in n.selectors):
                        colons = re.match(":+", pseudo)[0]
                        out += [n.but(selectors=[s.replace(pseudo, colons + p + pseudo[len(colons) :]) for s in n.selectors]) for p in marks]
            out.append(n)
        return out

    def only(own: list[Node], mark: str) -> list[Node]:
        """Without what other vendors' prefixes have been put on."""
        kept = [n for n in own if n.kind != "decl" or vendor_prefix(n.name) in ("", mark)]
        return [n.but(children=only(n.children, mark)) if n.children is not None else n for n in kept]

    return down(nodes, "")


# -- tables


def plan(entries: DataFrame, selected: DataFrame) -> DataFrame:
    """name, add, remove from entries(name, browser, version, prefix, note) and the selected
    browsers(browser, version): prefixes that a selected browser needs, longest first by the
    prefix without its note, and all the entry's others. A name that nothing selected needs
    has all to remove."""
    needed = entries.join(selected.withColumn("hit", F.lit(True)), ["browser", "version"], "left")
    full = F.when(F.col("note").isNull(), F.col("prefix")).otherwise(F.concat_ws(" ", "prefix", "note"))
    sets = needed.groupBy("name").agg(F.collect_set(F.when(F.col("hit"), full)).alias("add"), F.collect_set(full).alias("all"))
    bare = lambda x: F.length(F.regexp_replace(x, " .*", ""))
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda p: F.struct(-bare(p), -F.length(p), p.alias("p")))), lambda s: s.p)
    return sets.select("name", order(F.col("add")).alias("add"), order(F.array_except("all", "add")).alias("remove"))


def add_prefixes(decls: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """decls(key, ord, ..., prop) with a row for each prefixed clone before the original: column
    `clone` counts from 0, the original last. A clone whose property the same block has
    (same key, at_rules and selectors) is left out."""
    table = table.select(F.col("name").alias("prop"), "add")
    joined = decls.join(table, "prop", "left")
    marks = F.concat(F.transform(F.coalesce("add", F.array().cast("array<string>")), lambda p: F.regexp_replace(p, " .*", "")), F.array(F.lit("")))
    out = joined.select("*", F.posexplode(marks).alias("clone", "mark")).withColumn("original", F.col("prop"))
    out = out.withColumn("prop", F.concat("mark", "original"))
    have = decls.select(key, "at_rules", "selectors", F.col("prop")).distinct().withColumn("have", F.lit(True))
    out = out.join(have, [key, "at_rules", "selectors", "prop"], "left")
    return out.where((F.col("mark") == "") | F.col("have").isNull()).select(*decls.columns, "clone")


def remove_prefixes(decls: DataFrame, table: DataFrame) -> DataFrame:
    """decls without those whose prefixed property the table says to remove."""
    gone = table.select("name", F.explode("remove").alias("mark")).select(F.concat(F.regexp_replace("mark", " .*", ""), "name").alias("prop"))
    return decls.join(gone.distinct(), "prop", "left_anti")


def resolution_variants(query: str) -> list[str]:
    """A `min-resolution` or `max-resolution` condition as older browsers spell it, then itself."""
    m = re.search(r"\((min|max)-resolution:\s*([\d.]+)(dppx|dpi|dpcm|x)\)", query)
    if not m:
        return [query]
    per = {"dppx": Fraction(1), "x": Fraction(1), "dpi": Fraction(1, 96), "dpcm": Fraction(254, 9600)}[m[3]]
    ratio = Fraction(m[2]) * per
    number = f"{float(ratio):g}"
    moz = f"({m[1]}--moz-device-pixel-ratio: {number})"
    opera = f"(-o-{m[1]}-device-pixel-ratio: {ratio.numerator}/{ratio.denominator})"
    return [query.replace(m[0], x) for x in (f"(-webkit-{m[1]}-device-pixel-ratio: {number})", moz, opera, m[0])]



def supports_variants(params: str, table: Mapping[str, list[str]]) -> str:
    """A @supports condition in which each declaration of the table is any of its spellings."""

    def either(m: re.Match) -> str:
        marks = table.get(m[1], [])
        return f"({' or '.join(f'({p}{m[1]}:{m[2]})' for p in [*marks, ''])})" if marks else m[0]

    return re.sub(r"\(\s*([\w-]+)\s*:\s*((?:[^()]|\([^()]*\))*?)\s*\)", either, params)


def transition_variants(value: str, table: Mapping[str, list[str]]) -> str:
    """A transition with each of its properties that the table has also under its prefixes."""
    out = []
    for part in comma_list(value):
        for name in space_list(part):
            out += [part.replace(name, p + name, 1) for p in table.get(name, [])]
        out.append(part)
    return ",".join(dict.fromkeys(out))


def value_variants(decls: DataFrame, table: DataFrame) -> DataFrame:
    """decls with, before each whose value has a word of table(word, mark), a clone in which the
    word is prefixed; `clone` counts from 0, the original last."""
    hit = decls.join(table, F.rlike(F.concat(F.lit(" "), "value", F.lit(" ")), F.concat(F.lit(r"[\s,(]"), "word", F.lit(r"[\s,()]"))))
    new = F.regexp_replace("value", F.concat(F.lit(r"(^|[\s,(])("), "word", F.lit(r")(?=$|[\s,()])")), F.concat(F.lit("$1"), "mark", F.lit("$2")))
    clones = hit.withColumn("value", new).select(*decls.columns, F.lit(0).alias("clone"))
    return clones.union(decls.select("*", F.lit(1).alias("clone")))


def controlled(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes(keys, ord, kind, value) with `on`: false after a comment `autoprefixer: off` until one
    with `on`, and for the node after `autoprefixer: ignore next`. keys name a block."""
    text = F.regexp_extract(F.when(F.col("kind") == "comment", F.col("value")), r"(?i)autoprefixer:\s*(on|off|ignore next)", 1)
    own = F.when(F.lower(text).isin("on", "off"), F.lower(text))
    order = Window.partitionBy(*keys).orderBy("ord")
    state = F.last(own, ignorenulls=True).over(order)
    skip = F.coalesce(F.lower(F.lag(text).over(order)) == "ignore next", F.lit(False))
    return nodes.withColumn("on", F.coalesce(state != "off", F.lit(True)) & ~skip)


def prefix_runs(decls: DataFrame, keys: list[str]) -> DataFrame:
    """decls with `run`: side-by-side declarations of one property, whatever its prefixes."""
    order = Window.partitionBy(*keys).orderBy("ord")
    bare = F.regexp_replace("prop", r"^-\w+-", "")
    return decls.withColumn("_bare", bare).withColumn("_new", F.when(F.lag("_bare").over(order).eqNullSafe(F.col("_bare")), 0).otherwise(1)).withColumn("run", F.sum("_new").over(order)).drop("_bare", "_new")


def parent_prefix(ancestors: Column) -> Column:
    """The prefix of the nearest ancestor that has one, of an array of heads from the root down."""
    marks = F.transform(ancestors, lambda a: F.regexp_extract(a, r"(?:^@|:)(-\w+-)", 1))
    return F.try_element_at(F.filter(marks, lambda m: m != ""), F.lit(-1))
