"""What several operators share: written tables, batches of texts, links to components."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import remove, shared_dir, written  # noqa: F401

LINKS = "a long, b long"
#: Texts sent to Python at once.
TEXTS = 1000


def without_clashes(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with what an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links(a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is two aggregations and
    two joins on long keys, is written to the shared folder, and the last round is
    found by comparing an order-free digest of the links, so that only two numbers
    reach the driver. A hub's links are spread by Spark's skew-join splitting: the
    other side of each join has one row for each node.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    kept, digest = None, None
    while True:
        table = written(edges, "links")
        now = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if kept is not None:
            remove(kept)
        kept = table
        if digest == (now.n, now.s) or not now.n:
            return kept.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        digest = (now.n, now.s)
        both = kept.select(F.col("lo").alias("u"), F.col("lo").alias("m")).union(kept.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("u").agg(F.min("m").alias("m"))
        large = kept.join(least, kept.lo == least.u).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        pair = large.join(least, large.hi == least.u)
        small = pair.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(pair.select("hi", F.col("m")))
        edges = small.where("hi != lo").distinct()


def give_back() -> None:
    """Returns freed memory to the system, as the next task of a worker may need none of it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Forest:
    """Union-find over the integers below n; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(n: int, a, b) -> tuple:
    """Of the links a[i]-b[i] among n nodes, those of a spanning forest: at most n - 1."""
    import numpy as np

    forest = Forest(n)
    keep = [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if forest.join(x, y)]
    keep = np.asarray(keep, dtype=np.int64)
    return a[keep], b[keep]


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
