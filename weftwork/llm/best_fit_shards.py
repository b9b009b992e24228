"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text form a group that no shard boundary splits. Items sorted by
size, largest first, enter the bin whose remaining capacity is the smallest that still
fits; bins wait in a balanced tree ordered by remaining capacity. For a fixed number of
shards the capacity is the smallest, in fine steps, with which that many bins do, once
groups above the mean have shards of their own.

The driver packs sizes, each with the number of groups that have it: the groups of one
size enter a bin together for as long as it is the tightest. Since different sizes add
up to no more than all bytes, there are fewer than sqrt(2 * bytes) of them. Which group of
a size enters which bin is settled where the groups lie, by their places in an order
of hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import without_clashes, written


class Tree:
    """An AVL tree of (remaining, bin) pairs: insert, and take the least pair that is not below a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, left, right, height]

    @staticmethod
    def _high(node) -> int:
        return node[3] if node else 0

    def _set(self, node):
        """The node with its height renewed, turned so that its sides differ by at most one."""
        lean = self._high(node[1]) - self._high(node[2])
        if abs(lean) > 1:
            near, far = (1, 2) if lean > 0 else (2, 1)
            child = node[near]
            if self._high(child[far]) > self._high(child[near]):
                grand = child[far]
                child[far], grand[near] = grand[near], child
                self._height(child)
                node[near] = child = grand
            node[near], child[far] = child[far], node
            self._height(node)
            node = child
        self._height(node)
        return node

    def _height(self, node) -> None:
        node[3] = 1 + max(self._high(node[1]), self._high(node[2]))

    def insert(self, key: tuple[int, int]) -> None:
        def down(node):
            if not node:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = down(node[side])
            return self._set(node)

        self.root = down(self.root)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least key of at least (size, -1), if there is one."""
        node, found = self.root, None
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is None:
            return None

        def least(node):
            if not node[1]:
                return node[0], node[2]
            key, node[1] = least(node[1])
            return key, self._set(node)

        def down(node):
            if found == node[0]:
                if not node[1] or not node[2]:
                    return node[1] or node[2]
                node[0], node[2] = least(node[2])
            else:
                side = 1 if found < node[0] else 2
                node[side] = down(node[side])
            return self._set(node)

        self.root = down(self.root)
        return found


Sizes = list[tuple[int, int]]  # (size, groups of it), largest size first


def best_fit(sizes: Sizes, capacity: int) -> list[Sizes]:
    """What each bin holds. A group above the capacity has a bin to itself. Equal bins are
    taken by number."""
    tree, bins = Tree(), []
    for size, n in sizes:
        while n:
            got = tree.take(size)
            if got is None:
                got = (max(capacity, size), len(bins))
                bins.append([])
            # what remains of the tightest bin is tighter still, so the next group enters it too
            fit = min(n, got[0] // size)
            bins[got[1]].append((size, fit))
            tree.insert((got[0] - fit * size, got[1]))
            n -= fit
    return bins


def halves(own: Sizes) -> tuple[Sizes, Sizes]:
    """Every other group, from the largest on, and the rest."""
    out, seen = ([], []), 0
    for size, n in own:
        second = (n + seen % 2) // 2
        for part, k in zip(out, (n - second, second), strict=True):
            if k:
                part.append((size, k))
        seen += n
    return out


def fixed_bins(sizes: Sizes, bins: int) -> list[Sizes]:
    """What each bin holds: all bins are used if there are as many groups.

    A group above the mean of what is left has a bin to itself, largest first, and the mean
    is taken anew; the rest enter the remaining bins, with the smallest capacity, in fine
    steps, for which no more are used. Bins that stay empty then, which few and coarse
    groups can leave, take every other group of the fullest bin that has two.
    """
    left, out, rest = sum(size * n for size, n in sizes), [], list(sizes)
    while rest and rest[0][0] * (bins - len(out)) > left:
        size, n = rest[0]
        out.append([(size, 1)])
        left -= size
        rest[:1] = [(size, n - 1)] if n > 1 else []
    if not rest:
        return out
    few = bins - len(out)
    low = max(-(-left // few), rest[0][0])
    step = max(1, low // 10_000)
    while len(found := best_fit(rest, low)) > few:
        low += step
        step += step // 2
    while len(found) < min(few, sum(n for _, n in rest)):
        full = max((k for k, own in enumerate(found) if sum(n for _, n in own) > 1), key=lambda k: sum(size * n for size, n in found[k]))
        found[full], other = halves(found[full])
        found.append(other)
    return out + found


@dataclass(frozen=True)
class Params:
    """slot_rows: rows, or groups, numbered by one task."""

    slot_rows: int = 4096


def sharded(docs: DataFrame, shards: int = 16, capacity: int | None = None, p: Params = Params()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text).

    size is the text's UTF-8 bytes plus 1, a null text having none (its crc32 is 0). The
    law is `bytes`: with a fixed number of shards their sizes are near equal, but for a
    group that is larger than the mean and has a shard to itself; with a
    capacity, as few shards as best fit finds hold at most that many bytes each, but for
    a group that is larger by itself. Rows of equal text, null being one text, share
    a shard. slot counts a shard's rows from 0 without gaps. grown_shard is null under this
    law. Rows that repeat, or have no doc_id, are rows of their own; extra columns are
    ignored; an empty table gives no rows.
    """
    spark, text = docs.sparkSession, F.col("text")
    group = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = without_clashes(docs, "doc_id", "text").select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), group.alias("group"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    counts = groups.groupBy("bytes").count().collect()  # fewer than sqrt(2 * all bytes)
    sizes = sorted(((r.bytes, r["count"]) for r in counts), reverse=True)
    bins = fixed_bins(sizes, shards) if capacity is None else best_fit(sizes, capacity)
    upto: dict[int, int] = {}
    parts = []
    for b, own in enumerate(bins):  # of a size's groups, the places from `low` on
        for n_bytes, n in own:
            low = upto.get(n_bytes, 0)
            parts.append((n_bytes, low, low + n, b))
            upto[n_bytes] = low + n
    parts = spark.createDataFrame(parts, "bytes long, low long, high long, shard int")
    placed = placing(groups, sum(n for _, n in sizes), ["bytes"], ["group"], "place", p).join(parts, "bytes").where("place >= low and place < high")
    placed = rows.join(placed.select("group", "shard"), "group").select("doc_id", "size", "text_crc32", "shard")
    n = rows.count()
    out = placing(placed, n, ["shard"], ["doc_id", "text_crc32", "size"], "slot", p)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def placing(rows: DataFrame, n: int, keys: list[str], order: list[str], name: str, p: Params) -> DataFrame:
    """Numbers the rows of each key from 0 by prefix sums: rows fall by hash of `order` into
    buckets, a bucket's first number is the count of the key's rows in earlier buckets, and
    only a bucket is ever sorted."""
    buckets = max(1, -(-n // p.slot_rows))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_first"))
    here = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    out = dealt.withColumn("_here", here).join(first, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_first") + F.col("_here")).drop("_bucket", "_first", "_here")
