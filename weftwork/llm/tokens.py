"""A written table of every document's token ids, which packing and encoding start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, without_clashes, written
from .token_cache import ID, encoder

SCHEMA = "part int, at long, doc_id long, n_tokens long, wide boolean, ids binary"
RANGED = SCHEMA + ", range int, counts binary"
NAMES = ["part", "at", "doc_id", "n_tokens", "wide", "ids", "range", "counts"]
BATCH = 256


def packed(ids: bytes) -> tuple[bool, bytes]:
    """(False, two bytes an id) if all ids fit, else (True, ids as they are)."""
    a = np.frombuffer(ids, ID)
    return (True, ids) if len(a) and int(a.max()) > 0xFFFF else (False, a.astype("<u2").tobytes())


def unpacked(wide: bool, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, ID) if wide else np.frombuffer(ids, "<u2").astype(ID)


def _tokenize(path: str, end_id: int, bounds: np.ndarray | None):
    end = np.asarray([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                some = batch.slice(k, BATCH)
                starts, counts, wides, rows = [], [], [], []
                for text in some.column(1):
                    ids = encode(text.as_py() or "") + end
                    wide, data = packed(ids)
                    n = len(ids) // ID.itemsize
                    starts.append(at)
                    counts.append(n)
                    wides.append(wide)
                    rows.append(data)
                    at += n
                n = some.num_rows
                out = [pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), some.column(0), pa.array(counts, pa.int64()), pa.array(wides), pa.array(rows, pa.binary())]
                if bounds is not None:
                    own = np.bincount(np.concatenate([unpacked(*x) for x in zip(wides, rows, strict=True)]))
                    own[: len(total)] += total[: len(own)]
                    total = own if len(own) >= len(total) else np.concatenate([own, total[len(own) :]])
                    at_bound = np.searchsorted(bounds, some.column(0).fill_null(-(1 << 63)).to_numpy(), "right")
                    out += [pa.array(at_bound, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=NAMES[: len(out)])
        if bounds is not None and len(total):
            none = [pa.array([x], k) for x, k in ((part, pa.int32()), (at, pa.int64()), (None, pa.int64()), (0, pa.int64()), (False, pa.bool_()), (None, pa.binary()), (0, pa.int32()), (total.astype("<i8").tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(none, names=NAMES)

    return run


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, its n_tokens and ids (each text's, then end_id), the task that wrote it
    (part) and the ids before it in that task (at). A null text is an empty one.

    Since the table is written, part and at stay what they are however often a later
    task runs again.
    """
    return written(without_clashes(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_tokenize(path, end_id, None), SCHEMA), "tokens", batch=TEXTS)


def ranged(docs: DataFrame, path: str, end_id: int, ranges: int) -> tuple[DataFrame, np.ndarray]:
    """(table, counts): as tokenized(), with each row's range of doc_ids (quantiles, so that
    ranges are about even; nulls are in the first), and the count of every id. Each task counts
    the ids it writes and leaves its counts in a row of their own."""
    docs = without_clashes(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = docs.approxQuantile("doc_id", shares, 1 / (4 * ranges)) if shares else []
    bounds = np.unique(np.asarray(bounds, np.int64))
    table = written(docs.mapInArrow(_tokenize(path, end_id, bounds), RANGED), "tokens")
    rows = table.where("counts is not null").select("counts").mapInArrow(_added, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return table.where("counts is null").drop("counts"), counts


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_py(), "<i8")
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(own[used], pa.int64())], names=["id", "n"])


def starts(table: DataFrame, key: str, n: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys in order, tokens before each, all tokens): prefix sums of n over the values of
    key. A value stands for one task's share, so the driver gets a number for each task."""
    rows = table.groupBy(key).agg(F.sum(n).alias("n")).collect()
    rows.sort(key=lambda r: r[0])
    sums = np.cumsum([0, *(r.n for r in rows)])
    return np.asarray([r[0] for r in rows], np.int64), sums[:-1].astype(np.int64), int(sums[-1])
