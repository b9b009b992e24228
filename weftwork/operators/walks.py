"""Walks along links of any length, in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Steps that one round plans before it is written.
STRIDE = 4


def reached(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], depth: str) -> DataFrame:
    """Every row that steps lead to from start (whose depth is 0), once for each value of the
    keys, with the least depth.

    step gives a frontier's next rows, in the same columns, with a depth greater by 1. A row
    reached before is left out, so that cycles end and nothing bounds the length of a walk.
    Each round is written to the shared folder, which cuts its lineage.
    """
    seen = [written(start.withColumn(depth, F.lit(0)).dropDuplicates(keys), "walk")]
    frontier = seen[0]
    while True:
        here, steps = frontier, []
        for _ in range(STRIDE):
            here = step(here)
            steps.append(here)
        new = reduce(DataFrame.unionByName, steps)
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in new.columns if c not in keys)), depth).alias("_row")).select(*keys, "_row.*").select(*new.columns)
        for old in seen:
            new = new.join(old.select(*keys), keys, "left_anti")
        new = written(new, "walk")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(new)
        frontier = new
