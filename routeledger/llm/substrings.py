"""Substring deduplication: Rabin-Karp hashes of every word window, counted in Spark.

First every window of every document is counted under a shortened hash. Those that
repeat are counted again under a second, independent 64-bit hash, which removes chance
collisions. Windows that repeat under both merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .rolling import U64, Words, slices
from .tally import REQUEST, blocks, column, ordered, packed, replies, request, tally, unpacked

WINDOW = 35
SHORT = 5  # bytes of the first hash that travel, besides the bucket
FULL = 8

FOUND = "block int, places binary"
KEPT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
    "removed array<struct<start:int,end:int>>"
)


def _block_windows(texts: pa.Array, size: int, seed: int, chosen: np.ndarray | None = None):
    """Hashes of all windows of a block, or of the ``chosen`` ones, in order."""
    hashes, seen = [], 0
    for _, part in slices(texts):
        words = Words(part)
        _, found = words.windows(words.hashes(seed), size, seed)
        if chosen is not None:
            kept = chosen[seen : seen + len(found)]
            seen += len(found)
            found = found[kept]
        hashes.append(found)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)


def repeated_windows(dealt: DataFrame, parts: int, size: int) -> DataFrame:
    """``block, places``: numbers of the repeated windows of each block, as 32-bit bytes."""

    def first(table: pa.Table) -> pa.Table:
        table = ordered(table)
        keys, counts = np.unique(
            _block_windows(column(table, "text"), size, 1), return_counts=True
        )
        return request(_block(table), keys, np.minimum(counts, 2), parts, SHORT)

    def again(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows or not known.num_rows:
            return EMPTY
        table = ordered(table)
        texts = column(table, "text")
        hashes = _block_windows(texts, size, 1)
        _, inverse = np.unique(hashes, return_inverse=True)
        chosen = replies(known, np.uint8)[inverse] > 0
        places = np.flatnonzero(chosen)
        keys = _block_windows(texts, size, 5, chosen)
        order = np.argsort(keys, kind="stable")
        out = request(_block(table), keys[order], places[order], parts, FULL)
        return out

    def confirmed(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        keys, sizes = unpacked(column(bucket, "keys"), FULL, U64)
        places, _ = unpacked(column(bucket, "counts"), 4, np.uint32)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        repeats = counts[inverse] > 1
        row = np.repeat(np.arange(len(sizes)), sizes)[repeats]
        cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
        return pa.table({
            "block": column(bucket, "block"), "places": packed(places[repeats], 4, cuts),
        })

    known = tally(
        dealt.groupBy("block").applyInArrow(first, REQUEST), SHORT,
        lambda totals: (totals > 1).astype(np.uint8),
    )
    second = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(again, REQUEST)
    return second.groupBy("bucket").applyInArrow(confirmed, FOUND)


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


EMPTY = pa.table({
    "block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()),
    "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()),
})


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` without the words of repeated windows.

    A word goes if a window of ``window`` words covers it whose words also start
    anywhere else, in the same document or another. Returns ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256``, ``kept_text`` (kept words, one space between) and
    ``removed`` (maximal intervals of words, end excluded). Rows are judged each, so
    repeated rows of at least ``window`` words lose everything. Null and empty texts
    have no words, texts of fewer words stay, an empty table gives no rows, and other
    columns are ignored. A block of documents (about half a shuffle partition)
    is in memory at a time.
    """
    small_batches(docs.sparkSession)
    dealt, parts = blocks(docs)
    found = repeated_windows(dealt, parts, window)

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.split()[0]: [] for f in KEPT.split(", ")})
        table = ordered(table)
        texts = column(table, "text")
        places = np.sort(unpacked(column(known.combine_chunks(), "places"), 4, np.uint32)[0])
        places = places.astype(np.int64)
        rows, seen = [], 0
        for _, part in slices(texts):
            words = Words(part)
            n = len(words)
            counts = np.diff(words.bounds)
            document = words.document()
            starts = np.flatnonzero(np.arange(n) <= words.bounds[1:][document] - window) if n else []
            here = places[np.searchsorted(places, seen) : np.searchsorted(places, seen + len(starts))]
            cover = np.zeros(n + 1, dtype=np.int64)
            if len(here):
                first = starts[here - seen]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            seen += len(starts)
            for d, text in enumerate(part.to_pylist()):
                marks = gone[words.bounds[d] : words.bounds[d + 1]]
                tokens = (text or "").encode().split()
                kept = b" ".join(compress(tokens, ~marks) if marks.any() else tokens)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                rows.append((int(counts[d]), int(marks.sum()), hashlib.sha256(kept).hexdigest(),
                             kept.decode(), spans))
        values = list(zip(*rows))
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({
            "doc_id": column(table, "doc_id"), "n_words": pa.array(values[0], pa.int64()),
            "n_removed": pa.array(values[1], pa.int64()), "kept_sha256": pa.array(values[2]),
            "kept_text": pa.array(values[3]), "removed": pa.array(values[4], spans_type),
        })

    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, KEPT)
