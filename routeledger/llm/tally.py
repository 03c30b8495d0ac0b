"""Counting packed 64-bit keys over all blocks of a table.

Documents are dealt into blocks by a hash of their id. A block sends its distinct keys,
sorted, as a few bytes each; the keys fall into buckets by their upper bits, and a
bucket adds up the counts of all blocks. A key reaches its bucket at most once from each
block, so a key that holds a third of all occurrences costs no more than any other.
Buckets answer in the order of the keys they were sent, so keys need not travel back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

U64 = np.uint64
REQUEST = "block int, bucket int, keys binary, counts binary"
REPLY = "block int, bucket int, totals binary, distinct long, sum long"


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs(doc_id, text)`` as ``block, doc_id, text``, and the number of blocks.

    Two blocks and two buckets for each shuffle partition, so both grow with what the
    session is set up for. Rows without an id are dealt by their text.
    """
    n = 2 * shuffle_partitions(docs.sparkSession)
    by = F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text"))
    by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(by)
    return docs.select(
        F.pmod(by, F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
    ), n


def ordered(block: pa.Table) -> pa.Table:
    """The block's rows in an order that does not depend on how they arrived."""
    block = block.combine_chunks()
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the key, so sorted keys are sorted by bucket."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def packed(values: np.ndarray, width: int, cuts: np.ndarray) -> pa.Array:
    """``width`` low bytes of each value, one binary per stretch between the cuts."""
    raw = values.view(np.uint8).reshape(-1, values.dtype.itemsize)[:, :width]
    offsets = (cuts * width).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(raw).tobytes())
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), data]
    )


def unpacked(column: pa.Array, width: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the number of values in each row."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    count = int(offsets[-1] - offsets[0])
    if not count:
        return np.zeros(0, dtype=dtype), np.diff(offsets) // width
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    wide = np.zeros((count // width, np.dtype(dtype).itemsize), dtype=np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.reshape(-1).view(dtype), np.diff(offsets) // width


def request(
    block: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: int, every: bool = False
) -> pa.Table:
    """One row per bucket for sorted distinct ``keys``; with ``every`` also empty buckets."""
    at = bucket_of(keys, buckets)
    names = np.arange(buckets, dtype=U64) if every else np.unique(at)
    cuts = np.concatenate([np.searchsorted(at, names), [len(keys)]]).astype(np.int64)
    return pa.table({
        "block": pa.array(np.full(len(names), block), pa.int32()),
        "bucket": pa.array(names.astype(np.int32)),
        "keys": packed(keys, width, cuts),
        "counts": packed(counts.astype(np.uint32), 4, cuts),
    })


def tally(
    requests: DataFrame, width: int, answer: Callable[[np.ndarray], np.ndarray], counted=None
) -> DataFrame:
    """Replies to ``requests``: per row ``answer(totals)`` in the order of its keys.

    ``distinct`` and ``sum`` tell, in every row, how many keys of the bucket that
    ``counted`` selects occur and how often.
    """

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        keys, sizes = unpacked(column(bucket, "keys"), width, U64)
        counts, _ = unpacked(column(bucket, "counts"), 4, np.uint32)
        distinct, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        kept = totals[counted(distinct)] if counted else totals
        values = answer(totals)[inverse]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        n = bucket.num_rows
        return pa.table({
            "block": column(bucket, "block"), "bucket": column(bucket, "bucket"),
            "totals": packed(values, values.dtype.itemsize, cuts),
            "distinct": pa.array(np.full(n, int((kept > 0).sum())), pa.int64()),
            "sum": pa.array(np.full(n, int(kept.sum())), pa.int64()),
        })

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def replies(table: pa.Table, dtype: type) -> np.ndarray:
    """A block's replies in the order of its sorted keys."""
    table = table.sort_by("bucket").combine_chunks()
    return unpacked(column(table, "totals"), np.dtype(dtype).itemsize, dtype)[0]
