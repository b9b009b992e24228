"""Modules as tables: bindings, exports, included files, requests, package rewrites, short names."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from copy import deepcopy

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIRST, LATER
from ..shared import written
from .rows import first_match
from .walks import reached


def bindings(scopes: DataFrame, names: DataFrame, uses: DataFrame) -> DataFrame:
    """use, name, scope: the innermost scope around a use that binds its name; null where none
    does. scopes(scope, parent), names(scope, name), uses(use, scope, name). Scopes may be
    nested to any depth; ones that hold each other bind nothing they do not name."""
    bound = names.select("scope", "name").distinct()
    around = scopes.where("parent is not null").select("scope", "parent").distinct()

    def outwards(here: DataFrame) -> DataFrame:
        open_ = here.join(bound, ["scope", "name"], "left_anti").join(around, "scope")
        return open_.select("use", "name", F.col("parent").alias("scope"), (F.col("depth") + 1).alias("depth"))

    hit = reached(uses.select("use", "name", "scope"), outwards, ["use", "name", "scope"], "depth").join(bound, ["scope", "name"], "left_semi")
    hit = hit.groupBy("use", "name").agg(F.min_by("scope", "depth").alias("scope"))
    return uses.select("use", "name").join(hit, ["use", "name"], "left")


def exports(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """module, name, home, home_name: where a wanted export is defined, through any number of
    re-exports; of several definitions the nearest, then the first by name. Cycles end.
    edges(module, name, source, source_name): source null for a definition; name `*` passes
    every name on."""
    on = edges.where("source is not null").select(F.col("module").alias("at"), F.col("name").alias("by"), "source", "source_name")

    def further(here: DataFrame) -> DataFrame:
        along = here.join(on, "at").where((F.col("by") == F.col("at_name")) | (F.col("by") == "*"))
        name = F.when(F.col("by") == "*", F.col("at_name")).otherwise(F.col("source_name"))
        return along.select("module", "name", F.col("source").alias("at"), name.alias("at_name"), (F.col("hops") + 1).alias("hops"))

    start = wanted.select("module", "name", F.col("module").alias("at"), F.col("name").alias("at_name"))
    every = reached(start, further, ["module", "name", "at", "at_name"], "hops")
    homes = edges.where("source is null").select(F.col("module").alias("at"), F.col("name").alias("at_name")).distinct()
    found = every.join(homes, ["at", "at_name"], "left_semi").groupBy("module", "name").agg(F.min(F.struct("hops", "at", "at_name")).alias("home"))
    return found.select("module", "name", F.col("home.at").alias("home"), F.col("home.at_name").alias("home_name"))


def included_files(hops: DataFrame) -> DataFrame:
    """module and its distinct files, in order of code points."""
    return hops.groupBy("module").agg(F.array_sort(F.collect_set("path")).alias("files"))


def resolved(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests(request) by the first of rules(rule, prefix, target) whose prefix it has."""
    first = first_match(requests.select("request").distinct(), rules, lambda r: F.col("request").startswith(r.prefix), "rule")
    rest = F.substr("request", F.length("prefix") + 1)
    return first.select("request", F.when(F.col("rule").isNull(), F.col("request")).otherwise(F.concat("target", rest)).alias("path"))


def used_variants(uses: DataFrame, maps: DataFrame) -> DataFrame:
    """uses(key, ord, identifier) of known style maps: key and their sheets in order."""
    joined = uses.join(maps.select("identifier", "sheets"), "identifier")
    own = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sheets"))), lambda x: x.sheets))
    return joined.groupBy("key").agg(F.array_distinct(own).alias("sheets"))


def rewritten_package(text: str, steps: Sequence[Mapping]) -> str:
    """A package.json after steps in order: ensureObject, renameKey, renameMapEntry, setDefault, deleteKey.
    What is no object stays as it is."""
    root = json.loads(text)
    if not isinstance(root, dict):
        return text
    for step in steps:
        op, soft = step["op"], step.get("ifTargetMissing", False)
        own = root.get(step["in"]) if "in" in step else root
        if op == "ensureObject":
            if not isinstance(root.get(step["key"]), dict):
                root[step["key"]] = {}
        elif op == "deleteKey":
            root.pop(step["key"], None)
        elif not isinstance(own, dict):
            continue
        elif op == "setDefault":
            for k, v in step["entries"].items():
                own.setdefault(k, v)
        elif step["from"] in own and not (soft and step["to"] in own):
            value = deepcopy(own[step["from"]])  # later steps change the one only
            wrap = step.get("wrap")
            own[step["to"]] = {wrap["key"]: value} if wrap else value
            if op == "renameMapEntry" and step.get("deleteSource"):
                del own[step["from"]]
    return json.dumps(root)


def rewritten_packages(df: DataFrame, column: str, steps: Sequence[Mapping]) -> DataFrame:
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rewritten_package(t, steps) for t in x.to_pylist()], pa.string())

    return df.withColumn(column, run(column))


# -- short class names


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rank by `order`, from 0: ranges of the order are sorted apart, and the counts of
    those before are added. The ranges are written, since both plans must see the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each range
    return dealt.withColumn("_here", here).join(base, "_part").withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")


def _short(n: int) -> str:
    name, rest = FIRST[n % len(FIRST)], n // len(FIRST)
    while rest:
        rest, digit = divmod(rest - 1, len(LATER))
        name += LATER[digit]
    return name


def compression_map(classes: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """name, short: every atomic class of classes(ord, name) once, with the short name it had in
    old(name, short) or the next free one, in order of first occurrence. Names in use are
    not given again. Candidates are made and dealt out on the executors."""
    spark = classes.sparkSession
    atomic = classes.where(F.col("name").startswith("_") & (F.length("name") == 9))
    once = atomic.groupBy(F.substr("name", F.lit(2)).alias("name")).agg(F.min("ord").alias("ord"))
    if old is None:
        old = spark.createDataFrame([], "name string, short string")
    kept = once.join(old, "name").select("name", "short")
    new = numbered(once.join(old, "name", "left_anti"), "ord", "place")
    n = new.count()

    @F.arrow_udf("string")
    def names(x: pa.Array) -> pa.Array:
        return pa.array([_short(k) for k in x.to_pylist()], pa.string())

    every = spark.range(int(n * 1.3) + kept.count() + 64).withColumn("short", names("id"))
    free = every.where(~F.lower("short").contains("ad")).join(kept.select("short"), "short", "left_anti")
    return kept.union(new.join(numbered(free, "id", "place"), "place").select("name", "short"))
