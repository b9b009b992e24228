"""Near-duplicates by the similarity of 5-word shingle sets.

Documents link when the Jaccard similarity of their sets is at least a threshold. Equal
sets collapse first. Candidates are found by hamming_tree, on SimHash fingerprints of the
sets; an exact check on the sets themselves follows for the candidates that reach each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, Forest, components, give_back, written
from .hamming_tree import WIDE, WORDS, Wide, candidates, near, wide, words_of

SEED = 42
SIGNATURE = "doc_id long, text_hash long, key long, size long, " + ", ".join(f"{x} long" for x in WORDS)

SETS = "shingles binary, key long, size long, " + ", ".join(f"{x} long" for x in WORDS)


@dataclass(frozen=True)
class Params:
    """words: in a shingle. tree: how candidates are found, and the least similarity of linked
    documents. block: sets of a component of candidates that one comparison takes, twice at
    most. bucket_rows: sets compared by one task, about."""

    words: int = 5
    tree: Wide = Wide()
    block: int = 1024
    bucket_rows: int = 2048


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, sorted; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # as hamming_tree does
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def _signatures(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            fp = np.zeros((WIDE, batch.num_rows), np.uint64)
            for k, text in enumerate(batch.column(1)):
                found = shingles(text.as_py(), p.words)
                keys[k], sizes[k], fp[:, k] = xxhash.xxh3_64_intdigest(found.tobytes()), len(found), wide(found)
            columns = [batch.column(0), batch.column(2), pa.array(keys.view(np.int64)), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in fp)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "size", *WORDS])
        give_back()

    return run


def _sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), p.words).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["shingles", *batch.schema.names[1:]])
        give_back()

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _confirm(p: Params):
    """The links of some comparisons, each of one block or across two."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("low", "ascending"), ("high", "ascending"), ("size", "ascending"), ("key", "ascending")])
        root, low, high, block, size, key = (table.column(x).to_numpy() for x in ("root", "low", "high", "block", "size", "key"))
        fp = words_of(table)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        a, b = [], []
        new = (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(root)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            forest = Forest(hi - lo)
            side = block[lo:hi]
            across = low[lo:hi].max(initial=0) != high[lo:hi].max(initial=0)
            for i, j in near(fp[lo:hi], size[lo:hi], p.tree):
                if across:
                    i, j = (x[side[i] != side[j]] for x in (i, j))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if forest.find(x) != forest.find(y) and similar(sets[lo + x], sets[lo + y], p.tree.least):
                        forest.join(x, y)
            for i in range(hi - lo):
                if (first := forest.find(i)) != i:
                    a.append(key[lo + i])
                    b.append(key[lo + first])
        del sets, table
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id.

    Null and empty texts, and texts of spaces only, are copies of each other. Rows of one
    doc_id but different texts belong to the groups of their texts. Rows with a null doc_id
    all stay, since nothing tells them apart from documents of their own; they link
    others but stand for no group.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    every = written(texts.mapInArrow(_signatures(p), SIGNATURE), "signatures", batch=TEXTS)
    distinct = written(every.groupBy("key").agg(F.min("text_hash").alias("text_hash"), *(F.first(x).alias(x) for x in ("size", *WORDS))), "sets")
    found = candidates(distinct, distinct.count(), p.tree)
    nodes = written(found.union(found.select("root", "root").distinct()), "candidates")
    wanted = distinct.join(nodes.select(F.col("node").alias("key")), "key", "left_semi")
    held = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash").select("text", "key", "size", *WORDS).dropDuplicates(["key"])
    sets = written(held.mapInArrow(_sets(p), SETS), "shingles", batch=TEXTS)
    # a component is cut into blocks, and every two of its blocks are compared
    blocks = nodes.groupBy("root").agg(F.ceil(F.count("*") / p.block).alias("blocks"))
    placed = nodes.join(blocks, "root").select("root", "blocks", F.col("node").alias("key"), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    buckets = max(1, -(-dealt.count() // p.bucket_rows))
    dealt = dealt.join(sets, "key").withColumn("bucket", F.pmod(F.xxhash64("root", "low", "high"), F.lit(buckets)))
    roots = components(dealt.groupBy("bucket").applyInArrow(_confirm(p), "a long, b long"))
    # a key's own smallest row first, so that a group of copies is one row in the join
    first = every.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    placed = first.join(roots, first.key == roots.node, "left").groupBy(F.coalesce("root", "key")).agg(F.min("row").alias("row"))
    chosen = placed.select("row.doc_id", "row.text_hash")
    kept = docs.withColumn("_hash", F.xxhash64("text")).join(chosen.withColumnRenamed("text_hash", "_hash"), ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))
