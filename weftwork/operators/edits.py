"""Edits and predicates on node rows (see sources.css.NODE_ROWS): trees without trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def under_some(test: Callable[[Column], Column]) -> Column:
    """Whether some ancestor's head passes."""
    return F.exists("ancestors", test)


def under_all(test: Callable[[Column], Column]) -> Column:
    return F.forall("ancestors", test)


def renumbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Siblings numbered from 0 again, in the order they have."""
    return nodes.withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1).cast("int"))


def inserted(nodes: DataFrame, new: DataFrame, keys: list[str], before: bool = False) -> DataFrame:
    """nodes with rows of the same columns after (or before) the sibling whose ord they carry."""
    old = nodes.withColumn("ord", F.col("ord") * 2.0)
    new = new.withColumn("ord", F.col("ord") * 2.0 + (-1.0 if before else 1.0))
    return renumbered(old.unionByName(new), keys)


def appended(nodes: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    top = nodes.groupBy(*keys).agg(F.max("ord").alias("_top"))
    new = new.join(top, keys, "left").withColumn("ord", F.col("ord") + F.coalesce("_top", F.lit(-1)) + 1).drop("_top")
    return renumbered(nodes.unionByName(new.select(nodes.columns)), keys)


def removed(nodes: DataFrame, test: Column, keys: list[str]) -> DataFrame:
    return renumbered(nodes.where(~F.coalesce(test, F.lit(False))), keys)


def without_childless(nodes: DataFrame, key: str) -> DataFrame:
    """nodes but for rules that no row has as parent."""
    parents = nodes.where("parent_id is not null").select(key, F.col("parent_id").alias("node_id")).distinct()
    rules = nodes.where("kind = 'rule'").join(parents, [key, "node_id"], "left_semi")
    return nodes.where("kind <> 'rule'").unionByName(rules.select(nodes.columns))
