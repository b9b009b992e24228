"""Packing by concatenate and cut.

First pass: every task tokenizes its documents, writes them and so gives its token
total; prefix sums over the totals place each task's first token in one long row of all
tokens. Second pass: the row is cut at every multiple of the sequence length. A document
that a cut crosses has a piece on either side; a sequence that two tasks share is made of
both tasks' boundary records, which carry its number and their offset in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import starts, tokenized, unpacked

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(parts: np.ndarray, before: np.ndarray, width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = before[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("at").to_numpy()
            counts = batch.column("n_tokens").to_numpy()
            rows, first, length, crc, data = [], [], [], [], []
            for row, (at, n, wide, ids) in enumerate(zip(place.tolist(), counts.tolist(), batch.column("wide"), batch.column("ids"), strict=True)):
                own = unpacked(wide.as_py(), ids.as_py())
                begin = 0
                while begin < n:
                    end = min(n, begin + width - (at + begin) % width)
                    piece = own[begin:end]
                    rows.append(row)
                    first.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        data.append(piece.tobytes())
                    begin = end
            rows = np.asarray(rows, np.int64)
            at = place[rows] + np.asarray(first, np.int64)
            out = [batch.column("doc_id").take(pa.array(rows)), pa.array(first, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(counts[rows]), pa.array(at // width), pa.array(at % width)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array(data, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pieces(docs: DataFrame, path: str, end_id: int, width: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and with with_ids the piece's ids (little-endian
    unsigned 32-bit).

    All sequences are full but the last. Null and empty texts are their end id alone.
    Rows that repeat are packed as often as they occur; a null doc_id is kept. Extra
    columns are ignored. An empty table gives no pieces. No row is shuffled; the driver
    gets one total for each task of the first pass.
    """
    table = tokenized(docs, path, end_id)
    parts, before, _ = starts(table, "part", "n_tokens")
    return table.mapInArrow(_cut(parts, before, width, with_ids), SCHEMA + (", ids binary" if with_ids else ""))


def sequences(docs: DataFrame, path: str, end_id: int, width: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (width ids as little-endian unsigned 32-bit; the last padded with
    pad_id), n_tokens without the padding, and the pieces' doc_ids in order."""
    found = pieces(docs, path, end_id, width, with_ids=True)
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = found.groupBy("sequence_id").agg(own.alias("own"), F.sum("length").alias("n_tokens"))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(width) - F.col("n_tokens")).cast("int")))
    ids = F.aggregate(F.transform("own", lambda x: x.ids), F.lit(b""), lambda a, x: F.concat(a, x))
    return joined.select("sequence_id", F.concat(ids, pad).alias("ids"), "n_tokens", F.transform("own", lambda x: x.doc_id).alias("doc_ids"))
