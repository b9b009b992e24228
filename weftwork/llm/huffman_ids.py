"""Token ids in canonical length-limited Huffman code, in blocks that decode alone.

The code comes from the counts of all ids (package-merge: the best code whose lengths
stay within a limit) and is canonical, so the file keeps its lengths only. Documents lie
in ascending doc_id order, cut into ranges (one written by each task) and, at document
boundaries, into blocks. A block is

    b"CHB2", then unsigned 32-bit: documents, those without a doc_id (they come first),
    ids, bytes of code;
    64-bit doc_ids; 32-bit ids of each document;
    16-bit lengths in bits of each run of STRIDE ids, of which checkpoints are the sums;
    the code, most significant bit first.

All numbers are little-endian. Codes have 16 bits at most, or as many as more than 32,768
ids need. Decoding looks up that many bits in a table that has the id and the length of
its code, for all checkpoints of a block side by side. Blocks
are rows of Parquet files, so Spark's own committers and stores serve as the file layer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, written
from .token_cache import ID
from .tokens import ranged, starts, unpacked

MAGIC, HEAD, STRIDE, PEEK = b"CHB2", struct.Struct("<4sIIII"), 64, 16


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """For each id the length of its code, 0 where its count is 0; ties go to the smaller id.
    Without a limit it follows the alphabet: PEEK, or one bit more than the ids need."""
    used = np.flatnonzero(counts)
    limit = limit or max(PEEK, len(used).bit_length() + 1)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the longest length")
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.int64)
    pairs, leaf_first = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([own, pairs])
        rank = np.argsort(both, kind="stable")
        leaf_first.append(rank < len(own))
        both = both[rank]
        pairs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, taken = np.zeros(len(own), np.int64), 2 * len(own) - 2
    for leaves in reversed(leaf_first):
        n = int(leaves[:taken].sum())
        lengths[:n] += 1
        taken = 2 * (taken - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray, peek: int = PEEK) -> tuple[np.ndarray, np.ndarray]:
    """(used ids by length, then id; the code of each): consecutive numbers, shifted where the length grows."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    steps = np.left_shift(np.int64(1), peek - lengths[used].astype(np.int64))
    first = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(used) else np.zeros(0, np.int64)
    return used, first >> (peek - lengths[used].astype(np.int64))


@dataclass
class Code:
    """Both directions of the code with these lengths."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.peek = max(PEEK, int(self.lengths.max(initial=0)))
        used, codes = canonical(self.lengths, self.peek)
        # code and length in one number, so that each id costs one lookup
        self.codes = np.zeros(len(self.lengths), np.uint32)
        self.codes[used] = codes << 5 | self.lengths[used]
        span = np.left_shift(1, self.peek - self.lengths[used].astype(np.int64))
        self.ids, self.used = np.zeros(1 << self.peek, ID), np.zeros(1 << self.peek, np.uint8)
        self.ids[: span.sum()] = np.repeat(used, span)
        self.used[: span.sum()] = np.repeat(self.lengths[used], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(code, bits of each run of STRIDE ids). If they fit one word, two ids' codes are
        joined first; the last of an odd number is joined with no bits."""
        own = self.codes[ids]
        if self.peek > 16:
            n, value, half = own & 31, (own >> 5).astype(np.uint64), STRIDE
        else:
            if len(own) % 2:
                own = np.append(own, np.uint32(0))
            one, two = own[::2], own[1::2]
            n = two & 31
            value = ((one >> 5 << n) | two >> 5).astype(np.uint64)
            n += one & 31
            half = STRIDE // 2
        end = np.cumsum(n, dtype=np.int64)
        runs = np.diff(end[np.append(np.arange(half - 1, len(end) - 1, half), len(end) - 1)], prepend=0)
        at = end - n
        value <<= (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5  # a pair is no longer than a word, so one begins in every word but maybe the last
        first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], runs.astype("<u2")

    def decode(self, data: bytes, runs: np.ndarray, n: int) -> np.ndarray:
        b = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = np.concatenate([[0], np.cumsum(runs.astype(np.int64))[:-1]])
        out = np.zeros((STRIDE, len(runs)), ID)
        last, mask = len(window) - 1, np.uint32((1 << self.peek) - 1)
        for k in range(STRIDE):
            peek = (window[np.minimum(at >> 3, last)] >> (32 - self.peek - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.ids[peek]
            at = at + self.used[peek]
        return out.T.ravel()[:n]


def pack_block(code: Code, doc_ids: list[int | None], rows: list[np.ndarray]) -> bytes:
    ids = np.concatenate(rows)
    data, runs = code.encode(ids)
    return b"".join([HEAD.pack(MAGIC, len(rows), doc_ids.count(None), len(ids), len(data)), np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), np.asarray([len(r) for r in rows], "<u4").tobytes(), runs.tobytes(), data])


def read_block(code: Code, block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    magic, docs, nulls, n, size = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size
    doc_ids = pa.array(np.frombuffer(block, "<i8", docs, at), mask=np.arange(docs) < nulls)
    counts = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    runs = np.frombuffer(block, "<u2", -(-n // STRIDE), at := at + 4 * docs)
    at += 2 * len(runs)
    return doc_ids, counts, code.decode(block[at : at + size], runs, n)


def _blocks(lengths: np.ndarray, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, own = Code(lengths), TaskContext.get().partitionId()
        doc_ids, rows, size, number, before = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            data = pack_block(code, doc_ids, rows)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["range", "block", "before", "n_tokens", "data"])

        for batch in batches:
            for doc_id, wide, ids in zip(batch.column("doc_id"), batch.column("wide"), batch.column("ids"), strict=True):
                x = unpacked(wide.as_py(), ids.as_py())
                doc_ids.append(doc_id.as_py())
                rows.append(x)
                size += len(x)
                if size >= block_tokens:
                    yield block()
                    doc_ids, rows, number, before, size = [], [], number + 1, before + size, 0
        if rows:
            yield block()

    return run


def write(docs: DataFrame, path: str, end_id: int, block_tokens: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(blocks, code): the written files. blocks: range, block, before (ids before it in
    its range), n_tokens, data. code: id, length.

    Ranges and, in a range, blocks are in ascending doc_id order. A null text is empty; a
    null doc_id comes first; rows that repeat a doc_id lie side by side. One shuffle
    carries the ids; the driver gets a count for each id of the vocabulary.
    """
    spark = docs.sparkSession
    table, counts = ranged(docs, path, end_id, partitions(spark))
    lengths = code_lengths(counts)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    code = written(spark.createDataFrame(rows, "id long, length int").coalesce(1), "code")
    dealt = table.select("range", "doc_id", "wide", "ids").repartitionById(partitions(spark), "range").sortWithinPartitions("doc_id", F.crc32("ids"))
    blocks = dealt.mapInArrow(_blocks(lengths, block_tokens), "range int, block int, before long, n_tokens long, data binary")
    return written(blocks, "blocks"), code


def _digests(lengths: np.ndarray, ranges: np.ndarray, before: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            base = before[np.searchsorted(ranges, batch.column("range").to_numpy())] + batch.column("before").to_numpy()
            for at, data in zip(base.tolist(), batch.column("data"), strict=True):
                doc_ids, counts, ids = read_block(code, data.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - counts + at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def lengths_of(code: DataFrame) -> np.ndarray:
    rows = code.collect()
    lengths = np.zeros(max((r.id for r in rows), default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    return lengths


def digests(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """Reads the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    ranges, before, _ = starts(blocks, "range", "n_tokens")
    return blocks.select("range", "before", "data").mapInArrow(_digests(lengths_of(code), ranges, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for data in batch.column("data"):
                doc_ids, counts, ids = read_block(code, data.as_py())
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids, rows], names=["doc_id", "ids"])

    return run


def read(spark: SparkSession, blocks: DataFrame, code: DataFrame) -> DataFrame:
    """doc_id and ids of every document in the files."""
    return blocks.select("data").mapInArrow(_documents(lengths_of(code)), "doc_id long, ids array<int>")
