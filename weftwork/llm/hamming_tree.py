"""SimHash near-duplicates through vantage-point trees over Hamming distance.

A node of a tree has a vantage point v and a radius r. Of the fingerprints that reach
it, those with distance at most r from v go inside and those with distance over
r - reach go outside, so that some go both ways. By the triangle inequality
any two fingerprints within `reach` bits of each other meet on one side at least:
either both are within r, or one is beyond r and the other beyond r - reach.

The top of one tree, grown on a bounded sample, deals the distinct fingerprints out
to shards; a fingerprint near a boundary goes to every shard that its ball overlaps.
Each shard grows its own tree down to small leaves and compares those exactly.

Sets of shingles at a similarity of 0.8 differ in some 15 % of their bits, and balls so wide
overlap every radius at the top of a tree. candidates() therefore takes longer
fingerprints and deals them out by some of their bits, in several trees, each by bits of
its own, so that a pair misses all shards with a small probability that is fixed beforehand;
inside a shard trees grow as above, wherever a radius tells fingerprints apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, partitions, without_clashes, written

SEED = 42
SLICE = 1 << 15


@dataclass(frozen=True)
class Params:
    """reach: bits that linked fingerprints may differ in. sample: at most so many
    fingerprints are seen by the driver, to grow the top of the tree. The distinct
    fingerprints are dealt to about n / shard_rows shards, but to least_shards at
    least, and to more than most_shards only where a shard would exceed large_rows:
    every doubling of the shards copies a quarter more rows to a second shard.
    leaf: fingerprints compared all with all."""

    reach: int = 3
    sample: int = 8192
    shard_rows: int = 65536
    least_shards: int = 8
    most_shards: int = 64
    large_rows: int = 1_000_000
    leaf: int = 384
    seed: int = 3


def fingerprint(text: str | None) -> int:
    """64 bits: bit b is set if it is set in over half of the hashes of the 3-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words)]
        shingles: Iterator[bytes] = iter(words)
        n = 1
    else:
        n = len(words) - 2
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for at in range(0, n, SLICE):
        h = np.fromiter(hashes, np.dtype("<u8"), min(SLICE, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; a null text counts as empty."""
    return without_clashes(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_fingerprints, "doc_id long, fp long")


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def away(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distances of points, words or rows of words, from one of them."""
    d = distance(points, v)
    return d if d.ndim == 1 else d.sum(axis=1, dtype=np.int64)


def choose(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple | None:
    """(vantage point, radius, share of the larger side): of a few candidates the one
    that splits points best; None if they cannot be split. points: words of 64 bits, or rows
    of such words."""
    best = None
    bits = 64 * (points.shape[1] if points.ndim > 1 else 1)
    seen = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    for v in points[rng.integers(0, len(points), 8)]:
        n = np.cumsum(np.bincount(away(seen, v), minlength=bits + 1))
        inside = n / n[-1]
        outside = 1 - np.concatenate([np.zeros(reach + 1), inside[: bits - reach]])  # distance over r - reach
        larger = np.maximum(inside, outside)
        r = int(np.argmin(larger))
        if best is None or larger[r] + inside[r] + outside[r] < best[3]:
            best = (v if v.ndim else int(v), r, float(larger[r]), float(larger[r] + inside[r] + outside[r]))
    return best[:3] if best and best[2] < 0.93 else None


def grow(points: np.ndarray, reach: int, leaf: int, rng: np.random.Generator) -> tuple[list[tuple[int, int, int, int]], int]:
    """(nodes, number of leaves). A node is (vantage, radius, inside, outside), where a
    child is the index of a node, or -1 - the number of a leaf."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def down(part: np.ndarray) -> int:
        nonlocal leaves
        split = choose(part, reach, rng) if len(part) > leaf else None
        if not split:
            leaves += 1
            return -leaves
        v, r, _ = split
        d = distance(part, np.uint64(v))
        at = len(nodes)
        nodes.append((v, r, 0, 0))
        nodes[at] = (v, r, down(part[d <= r]), down(part[d > r - reach]))
        return at

    down(points)
    return nodes, leaves


def _deal(nodes: list[tuple[int, int, int, int]], reach: int):
    """To every fingerprint the leaves that its ball overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            todo, found = [(0 if nodes else -1, np.arange(len(fp)))], []
            while todo:
                at, rows = todo.pop()
                if at < 0:
                    found.append((-1 - at, rows))
                elif len(rows):
                    v, r, inside, outside = nodes[at]
                    d = distance(fp[rows], np.uint64(v))
                    todo += [(inside, rows[d <= r]), (outside, rows[d > r - reach])]
            rows = pa.array(np.concatenate([x for _, x in found]))
            leaf = pa.array(np.concatenate([np.full(len(x), k, np.int32) for k, x in found]))
            yield pa.RecordBatch.from_arrays([leaf, batch.column(0).take(rows), batch.column(1).take(rows)], names=["leaf", "fp", "rep"])

    return run


def link_dense(fp: np.ndarray, at: np.ndarray, forest: Forest, reach: int) -> None:
    """Joins what is linked among fp[at], for sets that no radius splits.

    Points within reach of a centre are joined to it, so that pairs inside a ball need
    no comparison; two balls that are not yet joined are compared if their
    centres are close enough, until one link is found.
    """
    centres, balls, left = [], [], at
    while len(left):
        d = distance(fp[left], fp[left[0]])
        near = left[d <= reach]
        for x in near[1:].tolist():
            forest.join(int(near[0]), x)
        centres.append(int(near[0]))
        balls.append(near)
        left = left[d > reach]
    middle = fp[np.asarray(centres)]
    for i in range(1, len(balls)):
        for j in np.flatnonzero(distance(middle[:i], middle[i]) <= 3 * reach).tolist():
            if forest.find(centres[i]) == forest.find(centres[j]):
                continue
            a, b = balls[i], balls[j]
            step = max(1, (1 << 20) // len(b))
            if any((distance(fp[a[k : k + step], None], fp[None, b]) <= reach).any() for k in range(0, len(a), step)):
                forest.join(centres[i], centres[j])


def link(fp: np.ndarray, reach: int, leaf: int, rng: np.random.Generator) -> Forest:
    """The components of the distinct fingerprints fp, by a tree of their own."""
    forest = Forest(len(fp))
    todo = [np.arange(len(fp))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            d = distance(fp[at, None], fp[None, at])
            near = np.triu(d <= reach, 1)
            has = np.flatnonzero(near.any(axis=1))
            for i in has.tolist():
                for j in np.flatnonzero(near[i]).tolist():
                    forest.join(int(at[i]), int(at[j]))
        elif split := choose(fp[at], reach, rng):
            v, r, _ = split
            d = distance(fp[at], np.uint64(v))
            inside, outside = at[d <= r], at[d > r - reach]
            if max(len(inside), len(outside)) > 0.97 * len(at):
                link_dense(fp, at, forest, reach)
            else:
                todo += [inside, outside]
        else:
            link_dense(fp, at, forest, reach)
    return forest


def _link_shard(p: Params):
    def run(table: pa.Table) -> pa.Table:
        fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")  # the same rows whatever their order, and the smallest rep as root
        fp, rep = fp[order], rep[order]
        forest = link(fp, p.reach, p.leaf, np.random.default_rng(p.seed))
        root = np.asarray([forest.find(x) for x in range(len(fp))], dtype=np.int64)
        some = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(rep[some], pa.int64()), "b": pa.array(rep[root[some]], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text).

    Documents link when their fingerprints differ in at most p.reach bits;
    component_id is the smallest doc_id reachable by links, itself included. Null and
    empty texts, and texts of spaces only, have fingerprint zero and link like any
    other. Rows that repeat are in one component. Rows with a null doc_id are
    returned with their own fingerprint and the component of that fingerprint, but
    never name one: a component of such rows only is null. Extra columns are ignored;
    an empty table gives an empty result.

    Copies collapse to one row for each distinct fingerprint before anything is
    compared, and a shard returns a spanning forest, so a group of copies costs neither
    pairs nor a large task.
    """
    spark = docs.sparkSession
    every = written(fingerprints(docs), "fingerprints")
    distinct = every.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = distinct.where("rep is not null")
    n = named.count()
    shards = max(p.least_shards, min(n // p.shard_rows, p.most_shards), n // p.large_rows) if n > p.leaf else 1
    sample = named.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(p.sample).collect() if shards > 1 else []
    points = np.asarray([r.fp for r in sample], np.int64).view(np.uint64)
    nodes, _ = grow(points, p.reach, max(2, len(points) // shards), np.random.default_rng(p.seed)) if shards > 1 else ([], 1)
    dealt = named.mapInArrow(_deal(nodes, p.reach), "leaf int, fp long, rep long")
    dealt = dealt.repartition(2 * partitions(spark), "leaf")
    links = dealt.groupBy("leaf").applyInArrow(_link_shard(p), "a long, b long")
    roots = components(links)
    # written, so that the join below has a plain side that skewed fingerprints can be split against
    groups = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = every.join(written(groups, "groups"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest doc_id.

    A doc_id that repeats keeps one of its rows; rows with a null doc_id all stay, since
    nothing tells them apart from documents of their own.
    """
    found = near_duplicates(docs, p).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


# -- sets of shingles, by longer fingerprints

WIDE = 4
WORDS = [f"f{k}" for k in range(WIDE)]
ODD = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Wide:
    """least: Jaccard similarity of the sets to find. reach: bits of 64 * WIDE in which candidates
    may differ, first_reach: of the first 64. Sets at 0.8 differ in a bit with a probability of
    0.152 or, of five shingles and less, of 0.188, so that a pair is beyond reach with one below
    2e-8 or 1e-4. missed: probability that such a pair is together in no shard. shard_rows: in a
    shard, about; leaf: compared without a tree."""

    least: float = 0.8
    reach: int = 72
    first_reach: int = 25
    missed: float = 6e-5
    same: float = 1 - 0.152
    same_few: float = 1 - 0.188
    few: int = 5
    shard_rows: int = 4096
    leaf: int = 384
    seed: int = 3


def wide(hashes: np.ndarray) -> np.ndarray:
    """64 * WIDE bits of a set of hashes: of WIDE mixes of each, those set in over half."""
    h = hashes[:, None] * ODD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), SLICE):
        bits = np.unpackbits(h[at : at + SLICE].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def near(fp: np.ndarray, size: np.ndarray, p: Wide) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, within reach, of sets whose sizes allow the similarity. fp: rows of
    words, by ascending size."""
    first, lo = np.ascontiguousarray(fp[:, 0]), 0
    ends = np.searchsorted(size, size / p.least * (1 + 1e-9), side="right")
    while lo < len(fp):
        hi = min(len(fp), lo + max(1, (1 << 16) // (int(ends[lo]) - lo)))
        end = int(ends[hi - 1])
        at = np.flatnonzero(distance(first[lo:hi, None], first[lo:end]).ravel() <= p.first_reach)
        i, j = np.divmod(at, end - lo)
        some = np.flatnonzero((i < j) & (j + lo < ends[i + lo]))
        i, j = i[some] + lo, j[some] + lo
        some = np.flatnonzero(distance(fp[i], fp[j]).sum(axis=1, dtype=np.int64) <= p.reach)
        if len(some):
            yield i[some], j[some]
        lo = hi


def link_wide(fp: np.ndarray, size: np.ndarray, p: Wide) -> np.ndarray:
    """For each of the sets, by ascending size, the first of its component of candidates."""
    forest, label = Forest(len(fp)), np.arange(len(fp))
    todo, rng = [np.arange(len(fp))], np.random.default_rng(p.seed)
    while todo:
        at = todo.pop()
        split = choose(fp[at], p.reach, rng) if len(at) > p.leaf else None
        if split:
            v, r, _ = split
            d = away(fp[at], v)
            inside, outside = at[d <= r], at[d > r - p.reach]
            if len(inside) ** 2 + len(outside) ** 2 < 0.8 * len(at) ** 2:
                todo += [inside, outside]
                continue
        for i, j in near(fp[at], size[at], p):
            i, j = at[i], at[j]
            new = np.flatnonzero(label[i] != label[j])
            if len(new):
                for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
                    forest.join(x, y)
                old, now = np.unique(label[np.concatenate([i[new], j[new]])]), np.arange(len(fp))
                now[old] = [forest.find(x) for x in old.tolist()]
                label = now[label]
    return label


def _deal_wide(trees: int, trees_of_few: int, bits: int, p: Wide):
    """To every set its shard in each tree: the tree's number, and `bits` of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        taken = [rng.choice(64 * WIDE, bits, replace=False) for _ in range(trees_of_few)]
        for batch in batches:
            fp = np.stack([batch.column(2 + k).to_numpy().view(np.uint64) for k in range(WIDE)], axis=1)
            few = batch.filter(pc.less_equal(batch.column(1), p.few + 1))
            few_fp = fp[batch.column(1).to_numpy() <= p.few + 1]
            for tree, own in enumerate(taken):
                rows, words = (batch, fp) if tree < trees else (few, few_fp)
                shard = np.full(len(words), tree << bits, np.int64)
                for k, b in enumerate(own.tolist()):
                    shard |= ((words[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << k
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *rows.columns], names=["shard", *rows.schema.names])

    return run


def _link_wide(p: Wide):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("key", "ascending")])
        key, fp = table.column("key").to_numpy(), words_of(table)
        label = link_wide(fp, table.column("size").to_numpy(), p)
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(key[some], pa.int64()), "b": pa.array(key[label[some]], pa.int64())})

    return run


def words_of(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(x).to_numpy().view(np.uint64) for x in WORDS], axis=1)


def shards_of(n: int, p: Wide) -> tuple[int, int, int]:
    """(trees, trees for the sets of few shingles, bits) for n sets."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / p.shard_rows))))
    trees = [1 if not bits else int(np.ceil(np.log(p.missed) / np.log1p(-(x**bits)))) for x in (p.same, p.same_few)]
    return trees[0], max(trees), bits


def candidates(sets: DataFrame, n: int, p: Wide = Wide()) -> DataFrame:
    """(node, root) for the keys of sets(key long, size long, f0.. long; n rows, keys distinct) that
    have candidates: sets whose fingerprints differ in at most p.reach bits and whose sizes allow
    the similarity, and what these reach. An exact check has to follow."""
    dealt = without_clashes(sets, "key", "size", *WORDS).mapInArrow(_deal_wide(*shards_of(n, p), p), "shard long, key long, size long, " + ", ".join(f"{x} long" for x in WORDS))
    return components(dealt.groupBy("shard").applyInArrow(_link_wide(p), "a long, b long"))
