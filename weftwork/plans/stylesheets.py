"""The three ways through a stylesheet: to atomic rules, to a sorted sheet, to rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rewrites, selectors
from ..operators import atomic, expand, nesting, ordering, prefixes, trees
from ..sources import css as source
from ..sources.css import Node


@dataclass(frozen=True)
class Options:
    optimize: bool = True
    compressed: Mapping[str, str] = field(default_factory=dict)
    specificity: bool = False
    sort_at_rules: bool = True
    sort_shorthand: bool = True
    hash_prefix: str = ""
    #: property to vendor prefixes; the support data to derive it from is the user's
    prefixes: Mapping[str, list[str]] = field(default_factory=dict)


def _change(options: Options):
    def change(decl: Node) -> list[Node]:
        if trees.is_empty(decl.value):
            return []
        value = rewrites.current_color(decl.name, decl.value) if options.optimize else decl.value
        return [decl.but(name=prop, value=v) for prop, v in expand.expanded(decl.name, value)]

    return change


def _minified(nodes: list[Node], options: Options, keyframes: bool = False) -> list[Node]:
    out = []
    for n in nodes:
        if n.kind == "decl":
            out.append(n.but(value=rewrites.minified(n.name, n.value)) if options.optimize else n)
            continue
        own = None if n.children is None else _minified(n.children, options, keyframes or n.name.endswith("keyframes"))
        if n.kind == "rule":
            out.append(n.but(selectors=selectors.minify_selectors(n.selectors, keyframes), children=own))
        elif n.kind == "atrule":
            out.append(n.but(params=selectors.minify_params(n.name, n.params), children=own))
        else:
            out.append(n)
    return out


def _selectors(nodes: list[Node], change) -> list[Node]:
    return [n.but(selectors=[change(s) for s in n.selectors], children=None if n.children is None else _selectors(n.children, change)) for n in nodes]


def transformed(text: str, options: Options = Options()) -> tuple[list[str], list[str]]:
    """(sheets, class names) of a block of styles: one sheet for each top-level node, each class
    name once. Raises source.CssError or atomic.AtomicError."""
    nodes = trees.keep_last(source.parse(text).children)
    nodes = _selectors(nodes, selectors.with_parents)
    nodes = ordering.sorted_sheet(nodes, options.sort_at_rules, options.sort_shorthand)
    nodes = nesting.flattened(nodes)
    nodes = trees.each_declaration(nodes, _change(options))
    if options.optimize:
        nodes = trees.without_comments(nodes)
    nodes = _minified(nodes, options)
    names: list[str] = []
    nodes = atomic.atomic(nodes, names, options.compressed, options.hash_prefix)
    if options.specificity:
        nodes = _selectors(nodes, selectors.more_specific)
    nodes = prefixes.prefixed(nodes, options.prefixes)
    return [source.text_of(n) for n in nodes if n.kind != "comment"], list(dict.fromkeys(names))


def sorted_css(text: str, at_rules: bool = True, shorthand: bool = True) -> str:
    """A sheet without duplicates, with equal at-rules merged, in order."""
    nodes = trees.without_duplicates(source.parse(text).children)
    nodes = ordering.sorted_sheet(trees.merged_at_rules(nodes), at_rules, shorthand)
    return source.text_of(Node("root", children=nodes))


ERRORS = (source.CssError, ValueError, RecursionError)  # the last for blocks nested too deep


def transform_css(df: DataFrame, options: Options = Options(), column: str = "css") -> DataFrame:
    """df with sheets, class_names and error: what `transformed` gives for its text column. A null
    text has null for all three; one that cannot be transformed has an error and no sheets.
    No shuffle; a task works through its rows in Arrow batches."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sheets, names, errors = [], [], []
            for x in batch.column(batch.schema.get_field_index(column)):
                text = x.as_py()
                got: tuple = (None, None, None)
                if text is not None:
                    try:
                        got = (*transformed(text, options), None)
                    except ERRORS as e:
                        got = (None, None, str(e))
                sheets.append(got[0])
                names.append(got[1])
                errors.append(got[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sheets, strings), pa.array(names, strings), pa.array(errors, pa.string())], names=[*batch.schema.names, "sheets", "class_names", "error"])

    return df.mapInArrow(run, ", ".join([*kinds, "sheets array<string>", "class_names array<string>", "error string"]))


def sort_css(df: DataFrame, at_rules: bool = True, shorthand: bool = True, column: str = "css") -> DataFrame:
    """df with `sorted`: its text as one ordered sheet; null where it cannot be parsed."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            try:
                out.append(None if x.as_py() is None else sorted_css(x.as_py(), at_rules, shorthand))
            except ERRORS:
                out.append(None)
        return pa.array(out, pa.string())

    return df.withColumn("sorted", run(column))


def nodes_of(df: DataFrame, key: str = "doc_id", column: str = "css") -> DataFrame:
    """key and source.NODE_ROWS: one row for each node; a text that cannot be parsed has none."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = source.rows(source.parse(x.as_py() or ""))
                except source.CssError:
                    continue
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string())]
                    names = [part.split()[0] for part in source.NODE_ROWS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind.simpleString()}, {source.NODE_ROWS}")


DECLARATIONS = "ord long, at_rules array<struct<name:string,params:string>>, selectors array<string>, prop string, value string, important boolean"


def declarations_of(df: DataFrame, key: str = "doc_id", column: str = "css", flatten: bool = True) -> DataFrame:
    """key and DECLARATIONS: every declaration with its at-rules and, nested rules flattened, its selectors."""
    kind = df.schema[key].dataType
    at_rule = pa.list_(pa.struct([("name", pa.string()), ("params", pa.string())]))

    def down(nodes: list[Node], above: list[dict], own: list[str]) -> Iterator[tuple]:
        for n in nodes:
            if n.kind == "decl":
                yield above, own, n.name, n.value, n.important
            elif n.children is not None:
                yield from down(n.children, above + [{"name": n.name, "params": n.params}] if n.kind == "atrule" else above, n.selectors if n.kind == "rule" else own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    nodes = source.parse(x.as_py() or "").children
                except source.CssError:
                    continue
                rows = list(down(nesting.flattened(nodes) if flatten else nodes, [], []))
                if rows:
                    a, s, p, v, i = zip(*rows, strict=True)
                    columns = [pa.array([own.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int64()), pa.array(a, at_rule), pa.array(s, pa.list_(pa.string())), pa.array(p), pa.array(v), pa.array(i)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "ord", "at_rules", "selectors", "prop", "value", "important"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind.simpleString()}, {DECLARATIONS}")
