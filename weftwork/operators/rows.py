"""Stylesheet operators as transforms of any table with a key and an order column.

Rows have no order of their own, so each operator takes the column (`ord`) that has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, bucket_rank, is_empty
from .atomic import ATOMIC, FORBIDDEN, IGNORED


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """The row of the highest ord for each key. The limit is pushed below the shuffle."""
    return _pick(df, keys, [F.desc(ord)])


def keep_first(df: DataFrame, keys: list[str], ord: str) -> DataFrame:
    return _pick(df, keys, [F.asc(ord)])


def without_empty(decls: DataFrame) -> DataFrame:
    return decls.where(~is_empty(F.col("value")))


def gate(name: Column) -> Column:
    """True for an at-rule whose content becomes atomic, false for one that stays whole; an error for any other."""
    error = F.when(name.isin(*sorted(FORBIDDEN)), F.concat(F.lit("At-rule '@"), name, F.lit("' cannot be used in CSS rules."))).otherwise(F.concat(F.lit("Unknown at-rule '@"), name, F.lit("'.")))
    return F.when(name.isin(*sorted(ATOMIC)), True).when(name.isin(*sorted(IGNORED)), False).otherwise(F.raise_error(error).cast("boolean"))


def gate_kind(name: Column) -> Column:
    """The same without an error: atomic, whole, forbidden or unknown."""
    return F.when(name.isin(*sorted(ATOMIC)), "atomic").when(name.isin(*sorted(IGNORED)), "whole").when(name.isin(*sorted(FORBIDDEN)), "forbidden").otherwise("unknown")


def merge_runs(df: DataFrame, keys: list[str], ord: str, kind: str, text: str, joins: list[str], separator: str = "") -> DataFrame:
    """Side-by-side rows of one kind (of `joins`; every other row is its own run) as one: keys,
    first ord, kind, joined text and number of rows."""
    order = Window.partitionBy(*keys).orderBy(ord)
    before = F.lag(kind).over(order)
    new = F.when(F.col(kind).isin(*joins) & before.eqNullSafe(F.col(kind)), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord), F.col(text).alias("t")))), lambda x: x.t)
    out = runs.groupBy(*keys, "_run").agg(F.min(ord).alias(ord), F.min(kind).alias(kind), F.array_join(own, separator).alias(text), F.count("*").alias("n_rows"))
    return out.drop("_run")


def merge_classes(df: DataFrame, keys: list[str], ord: str, name: str, short: bool = False) -> DataFrame:
    """keys and `classes`: of the class names of one group (five characters of an atomic name,
    else all of it) the last, at the place of the first. With short, `_aaaa_x` counts as x."""
    atomic = F.col(name).startswith("_")
    group = F.when(atomic, F.substring(name, 1, 5)).otherwise(F.col(name))
    shown = F.when(atomic & (F.substring(name, 6, 1) == "_"), F.substr(name, F.lit(7))).otherwise(F.col(name)) if short else F.col(name)
    last = df.groupBy(*keys, group.alias("_group")).agg(F.min(ord).alias("_at"), F.max_by(shown, ord).alias("_last"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_last"))), lambda x: x["_last"])
    return last.groupBy(*keys).agg(F.array_join(own, " ").alias("classes"))


def merge_at_rules(children: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """keys, name, params, ord (the first's), children: at-rules of one name and params as one,
    with their distinct children (column child) in order of first occurrence."""
    once = children.groupBy(*keys, "name", "params", "child").agg(F.min(ord).alias("_at"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("_at", "child"))), lambda x: x.child)
    return once.groupBy(*keys, "name", "params").agg(F.min("_at").alias(ord), own.alias("children"))


def hoisted(sheets: DataFrame, keys: list[str], ord: str, sheet: str) -> DataFrame:
    """A constant's number for each distinct sheet, in order of first occurrence."""
    first = sheets.groupBy(*keys, sheet).agg(F.min(ord).alias(ord))
    return first.withColumn("constant", F.row_number().over(Window.partitionBy(*keys).orderBy(ord, sheet)))


def bucketed(sheets: DataFrame, keys: list[str], ord: str, sheet: str) -> DataFrame:
    """keys, bucket, rank, css: each distinct sheet once, joined by style bucket in the order of buckets."""
    once = keep_first(sheets, [*keys, sheet], ord).withColumn("bucket", bucket(F.col(sheet)))
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord), F.col(sheet).alias("s")))), lambda x: x.s)
    return once.groupBy(*keys, "bucket").agg(F.array_join(own, "").alias("css")).withColumn("rank", bucket_rank(F.col("bucket")))


def added_and_removed(df: DataFrame, wanted: str, every: str) -> DataFrame:
    """add: those of `every` that are wanted; remove: the others, or all if none is wanted."""
    add = F.array_intersect(every, wanted)
    return df.withColumn("add", F.array_sort(add)).withColumn("remove", F.array_sort(F.when(F.size(add) == 0, F.col(every)).otherwise(F.array_except(every, add))))


#: Rules up to which they are part of the plan.
FEW_RULES = 1000


def first_match(left: DataFrame, rules: DataFrame, on: Callable[[Column], Column], order: str) -> DataFrame:
    """Every left row with the columns of the first rule, by order, for which `on` (given the
    rule as a struct) is true; nulls where there is none. Rows that repeat stay. Few rules
    are compared in place, without a shuffle; more are joined."""
    names = rules.columns
    found = rules.orderBy(order).limit(FEW_RULES + 1).collect()
    if len(found) <= FEW_RULES:
        kind = rules.schema.simpleString()
        if not found:
            return left.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema))
        every = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in names)).cast(kind) for r in found))
        first = F.try_element_at(F.filter(every, lambda r: F.coalesce(on(r), F.lit(False))), F.lit(1))
        return left.withColumn("_rule", first).select(*left.columns, "_rule.*")
    one = rules.select(F.struct(*names).alias("_rule"))
    joined = left.withColumn("_id", F.monotonically_increasing_id()).join(one, on(F.col("_rule")), "left")
    return _pick(joined, ["_id"], [F.asc_nulls_last(F.col("_rule")[order])]).select(*left.columns, "_rule.*")
