"""Style items: what a module's style calls come to, as rows.

items(key, ord, type, css, ...) with type `unconditional`, `conditional`, `logical`, `sheet` or
`map`. Parsing modules is out of scope; the rows come from whatever parsed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import content_value, hashed, kebab_case, with_unit
from .rows import keep_first, merge_runs


def declaration(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(":"), value, F.lit(";"))


def rule(selector: Column, css: Column) -> Column:
    return F.concat(selector, F.lit("{"), css, F.lit("}"))


def object_css(entries: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """keys and css of style objects from entries(keys, ord, name, number, text): names in kebab
    case, units and quotes added where the property has them, in order."""
    value = F.when(F.col("name") == "content", content_value(F.col("text"))).otherwise(with_unit(F.col("name"), F.col("number"), F.col("text")))
    css = declaration(kebab_case(F.col("name")), value)
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord), css.alias("c")))), lambda x: x.c)
    return entries.groupBy(*keys).agg(F.array_join(own, "").alias("css"))


def variable_name(expression: Column) -> Column:
    """The custom property that stands for a value known only at run time."""
    return F.concat(F.lit("--_"), hashed(expression))


def keyframes(frames: DataFrame, css: str = "css") -> DataFrame:
    """frames with the animation's name and its sheet."""
    name = F.concat(F.lit("k"), hashed(F.col(css)))
    return frames.withColumn("name", name).withColumn("sheet", F.concat(F.lit("@keyframes "), "name", F.lit("{"), F.col(css), F.lit("}")))


def merged_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Sheets first, then the rest in order, with side-by-side unconditional items as one. A sheet
    between two of them does not part them. Column `place` has the order."""
    sheets = items.where("type = 'sheet'").select(*keys, "ord", "type", "css")
    others = merge_runs(items.where("type <> 'sheet'"), keys, "ord", "type", "css", ["unconditional"]).select(*keys, "ord", "type", "css")
    return sheets.withColumn("place", F.struct(F.lit(0).alias("part"), "ord")).union(others.withColumn("place", F.struct(F.lit(1).alias("part"), "ord")))


def variables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each variable of rows(keys, ord, name, ...) once; the first counts."""
    return keep_first(rows, [*keys, "name"], "ord")


def from_imports(calls: DataFrame, imports: DataFrame, sources: DataFrame) -> DataFrame:
    """calls(module, local, ...) whose local name the module imports from one of sources(source)
    under imports(module, local, imported, source): with the imported name as `api`."""
    known = imports.join(sources, "source", "left_semi")
    return calls.join(known.select("module", "local", F.col("imported").alias("api")), ["module", "local"])
