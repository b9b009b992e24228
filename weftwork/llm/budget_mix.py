"""Mixing sources to target weights by hierarchical budgets.

The documents hang in a tree, here domain, language, source. A budget of tokens
enters at the root and is shared by weight among children, level by level. What a child
cannot supply goes to its siblings first, by their weights, and only what
all of them cannot take stays with the parent, so that its own siblings get it. A leaf
supplies its tokens up to `epochs` times. It gives whole epochs, then the prefix of the
next: its documents in a seeded order, up to the last that still fits.

A leaf's prefix is found by its cut-off key: token sums over ranges of keys lead to one
range, in which the sums are taken key by key. Selecting is then a filter on the
documents where they lie; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
RANGES = 1024
SEPARATOR = "\x01"


@dataclass(frozen=True)
class Params:
    """budget: tokens, or, if below or at 1 as a float, a share of all. weights: by path
    (a tuple of names from the root); a node without one has weight 1."""

    budget: float | int = 1.0
    epochs: int = 2
    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    seed: int = 17


def poured(amount: int, room: list[int], weights: list[float]) -> list[int]:
    """amount shared by weight, nobody above their room; shortages go to the others by weight.
    Whole numbers: what rounding leaves goes one by one to the first with room."""
    out = [0] * len(room)
    open_ = [k for k in range(len(room)) if weights[k] > 0]
    left = min(amount, sum(room[k] for k in open_))
    while left and open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if room[k] - out[k] <= left * weights[k] / total]
        if full:
            for k in full:
                left -= room[k] - out[k]
                out[k] = room[k]
            open_ = [k for k in open_ if k not in set(full)]
            continue
        shares = {k: int(left * weights[k] / total) for k in open_}
        for k, x in shares.items():
            out[k] += x
        for k in open_[: left - sum(shares.values())]:
            out[k] += 1
        break
    return out


def _share(epochs: int, weights: Mapping[tuple[str, ...], float]):
    """A parent's budget among its children."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        paths = table.column("path").to_pylist()
        room = [epochs * n for n in table.column("n").to_pylist()]
        given = poured(table.column("budget")[0].as_py(), room, [weights.get(tuple(x.split(SEPARATOR)), 1.0) for x in paths])
        return pa.table({"path": table.column("path"), "n": table.column("n"), "budget": pa.array(given, pa.int64())})

    return run


def budgets(leaves: DataFrame, depth: int, amount: int, epochs: int, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """path, n, budget: the tokens that each of leaves(path, n) is to give. Paths are names
    from the root down, as many as depth. Level by level, the children of a
    node share its budget in one task; the driver sees none of them."""
    spark = leaves.sparkSession
    nodes = spark.createDataFrame([("", amount)], "path string, budget long")
    for k in range(1, depth + 1):
        upto = F.substring_index("path", SEPARATOR, k)
        children = leaves.groupBy(upto.alias("path")).agg(F.sum("n").alias("n"))
        parent = F.substring_index("path", SEPARATOR, k - 1) if k > 1 else F.lit("")
        own = children.withColumn("parent", parent).join(nodes.select(F.col("path").alias("parent"), "budget"), "parent")
        nodes = written(own.groupBy("parent").applyInArrow(_share(epochs, weights), "path string, n long, budget long"), "budgets")
    return nodes


def mixed(docs: DataFrame, levels: Mapping[str, Column], p: Params = Params(), keep: bool = False) -> DataFrame:
    """The selected rows, one for each epoch a document is in: doc_id, the levels, n_tokens,
    epoch (from 0) and budget (its leaf's). With keep, docs' own columns only.

    levels are string expressions over docs, from the root down; a null name is the
    name "". n_tokens counts words between ASCII spaces; null and empty texts have none
    and are selected whenever their place in the order is reached. Rows that repeat a doc_id have
    one place and are selected together. A weight of 0 or less excludes a node. An empty
    table, or no budget, gives no rows with tokens.
    """
    names = list(levels)
    path = F.concat_ws(SEPARATOR, *(F.regexp_replace(F.coalesce(x, F.lit("")), SEPARATOR, "") for x in levels.values()))
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    level = F.array(*(F.coalesce(x, F.lit("")) for x in levels.values())).alias("level")
    slim = written(docs.select("doc_id", path.alias("leaf"), level, tokens.alias("n")), "leaves")
    leaves = written(slim.groupBy("leaf").agg(F.sum("n").alias("n")).withColumnRenamed("leaf", "path"), "sums")
    total = leaves.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    amount = int(p.budget * total) if isinstance(p.budget, float) and p.budget <= 1 else int(p.budget)
    given = budgets(leaves, len(names), amount, p.epochs, p.weights)
    part = lambda f: F.when(F.col("n") > 0, f).otherwise(0)
    plan = given.where(F.lit(p.epochs > 0)).select(F.col("path").alias("leaf"), "budget", part(F.expr("budget div n")).alias("whole"), part(F.expr("budget % n")).alias("rest"))
    # the leaf's order in its last epoch; the key is not negative, so that ranges are its leading bits
    key = lambda id: F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), "whole", id), 1)
    placed = slim.join(plan, "leaf").select("leaf", "n", "rest", key("doc_id").alias("key"))
    width = 1 << 53  # 2^63 keys in RANGES ranges
    ranges = placed.groupBy("leaf", "rest", F.floor(F.col("key") / width).alias("range")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("range"))
    crossed = ranges.withColumn("upto", upto).where("upto > rest").groupBy("leaf").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    crossed = crossed.select("leaf", "x.range", "x.before")
    inside = placed.withColumn("range", F.floor(F.col("key") / width)).join(crossed, ["leaf", "range"])
    keys = inside.groupBy("leaf", "rest", "before", "key").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("key"))
    cut = keys.withColumn("upto", upto).where("upto > rest").groupBy("leaf").agg(F.min("key").alias("cut"))
    chosen = written(plan.join(cut, "leaf", "left").select("leaf", "budget", "whole", "cut"), "cuts")  # a row for each leaf
    if keep:
        # docs' row stays in one struct, so that none of its names can clash
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        out = docs.select(row, path.alias("leaf"), F.col("doc_id").alias("id")).join(chosen, "leaf")
    else:
        out = slim.withColumnRenamed("doc_id", "id").join(chosen, "leaf")
    times = F.col("whole") + F.when(F.col("cut").isNull() | (key("id") < F.col("cut")), 1).otherwise(0)
    times = F.least(times, F.lit(p.epochs).cast("long"))
    epochs = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    out = out.select("*", F.explode(epochs).alias("epoch"))
    if keep:
        return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    named = (F.col("level")[k].alias(x) for k, x in enumerate(names))
    return out.select(F.col("id").alias("doc_id"), *named, F.col("n").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"), "budget")
