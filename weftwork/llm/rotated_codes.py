"""Near-duplicate embeddings by randomly rotated binary codes with correction factors.

A unit vector o is rotated at random and kept as the signs of its components. With
s the sign vector over sqrt(D) and f = <s, o'> the stored correction factor,
<s, q'> / f is an unbiased estimate of <o, q> for a rotated vector q'. Its error is
sqrt(1 - f^2) / f times the length of q's part across o, times the projection of a
random direction in D - 1 dimensions; for a pair at the threshold that part has length
sqrt(1 - threshold^2). Pairs whose estimate plus `sigmas` deviations stays below
the threshold are ruled out; every other pair is computed exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collision_search import as_matrix, usable
from .common import components, partitions, spanning, without_clashes, written


@dataclass(frozen=True)
class Params:
    """sigmas: width of the bound; at 7 a true link is missed with probability below
    1e-11. block_rows: vectors of one label in a block; a task compares two blocks."""

    sigmas: float = 7.0
    block_rows: int = 2048
    seed: int = 11


class Codes:
    """Unit vectors, their rotated form, and code and correction factor of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: Params) -> None:
        # scaled first, so that lengths of tiny or huge vectors do not leave the doubles
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.ids, self.unit = ids, scaled / np.sqrt((scaled**2).sum(axis=1))[:, None]
        d = vectors.shape[1]
        turn, r = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((d, d)))
        self.turned = (self.unit @ (turn * np.sign(np.diag(r)))).astype(np.float32)
        self.code = np.where(self.turned < 0, np.float32(-1), np.float32(1))
        self.factor = np.abs(self.turned).sum(axis=1) / np.sqrt(d)
        self.spread = np.sqrt(np.maximum(0, 1 - self.factor**2)) / self.factor / np.sqrt(max(d - 1, 1))


def linked(x: Codes, y: Codes, same: bool, threshold: float, p: Params, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into x, into y) whose exact cosine is at least the threshold; for same, i < j."""
    d = x.unit.shape[1]
    across = np.sqrt(max(0.0, 1 - threshold**2))
    for at in range(0, len(x.ids), rows):
        end = min(at + rows, len(x.ids))
        need = (threshold - p.sigmas * across * x.spread[at:end] - 1e-5) * x.factor[at:end] * np.sqrt(d)
        start = at if same else 0
        i, j = np.nonzero(x.code[at:end] @ y.turned[start:].T >= need[:, None].astype(np.float32))
        i, j = i + at, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            near = (x.unit[a] * y.unit[b]).sum(axis=1) >= threshold
            yield a[near], b[near]


def _compare(threshold: float, p: Params):
    """One group: two blocks of a label (or one with itself). Counts of links and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        block, (left, right) = table.column("block").to_numpy(), (table.column("i")[0].as_py(), table.column("j")[0].as_py())
        ids, vectors = table.column("vec_id").to_numpy(), as_matrix(table.column("embedding"))
        # in a fixed order, so that a task that runs again gives the same rows
        order = np.lexsort((ids, block))
        block, ids, vectors = block[order], ids[order], vectors[order]
        codes = Codes(ids, vectors, p)
        first = int((block == left).sum())
        n_links = np.zeros(len(ids), np.int64)
        a_kept, b_kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def part(lo: int, hi: int) -> Codes:
            out = object.__new__(Codes)
            out.ids, out.unit, out.turned, out.code, out.factor, out.spread = (v[lo:hi] for v in (codes.ids, codes.unit, codes.turned, codes.code, codes.factor, codes.spread))
            return out

        same = left == right
        x, y = (codes, codes) if same else (part(0, first), part(first, len(ids)))
        for a, b in linked(x, y, same, threshold, p):
            b = b if same else b + first
            n_links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            a, b = spanning(len(ids), np.concatenate([a_kept[0], a]), np.concatenate([b_kept[0], b]))
            a_kept, b_kept = [a], [b]
        some = np.flatnonzero(n_links)
        a, b = ids[a_kept[0]], ids[b_kept[0]]
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], a]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), b]), pa.int64()),
            "n": pa.array(np.concatenate([n_links[some], np.zeros(len(a), np.int64)]), pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Two vectors link when their labels are equal and not null and their cosine is at
    least the threshold. Vectors that are null, zero or hold null or non-finite
    components, and rows of null label, link with nothing: n_links 0, component_id
    their own vec_id, kept; and so do rows of null vec_id, whose component_id is null, and
    vectors of unequal lengths with each other. vec_id identifies a row; rows that repeat a vec_id are
    compared as separate rows, and each gets the id's summed count. Extra columns are
    ignored. An empty table gives an empty result.

    A label's rows are cut into blocks of about p.block_rows by a hash, and a task
    compares two blocks, so that no task holds a label. A task returns link counts
    and a spanning forest of its links, never the pairs.
    """
    spark = vectors.sparkSession
    rows = without_clashes(vectors, "vec_id", "embedding", "label")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    able = rows.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("label", F.struct("label", F.size("embedding").alias("length")))
    sizes = able.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / p.block_rows)).cast("int").alias("blocks"))
    cut = able.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("other", other).select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "embedding")
    task = F.xxhash64("label", "i", "j").alias("task")
    dealt = dealt.select(task, *dealt.columns).repartition(2 * partitions(spark), "task")
    found = written(dealt.groupBy("task", "label", "i", "j").applyInArrow(_compare(threshold, p), "a long, b long, n long"), "pairs")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("n = 0").select("a", "b"))
    out = rows.select("vec_id").join(counts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def oracle_sql(threshold: float) -> str:
    """The same result by exact comparison of all pairs of a label, for DuckDB and small tables."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {threshold}
), r(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(max(n_links), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM embeddings JOIN r ON node = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id"""
