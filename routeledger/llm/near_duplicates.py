"""N-gram Jaccard join: banded MinHash signatures with exact verification.

Each text becomes its set of five-word shingles; texts with equal sets are one class.
A class has one key per tree, made of ``depth`` MinHash values, and classes that share a
key meet. The depth is the same for all texts: the largest at which a pair at the threshold
meets in some tree with the target probability.

Classes that met form groups, whose texts are compared exactly. A group is cut into
chunks and every pair of chunks is a task of its own, so no task holds a large group; it
counts links and reports them per class, never as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import components
from .rolling import U64, Words, mix, random_odd, slices

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
LEVELS = 8
RECALL = 0.9999
CHUNK = 256  # classes in one side of a comparison
TILE = 4096  # shingles multiplied at a time

SIGNED = "doc_id long, text_hash long, node binary, shingles int, prefixes array<long>"
VERIFIED = "node binary, root binary, links long, alone boolean"


def prefix_depth(threshold: float, trees: int, levels: int, recall: float) -> int:
    """Longest prefix at which a pair at the threshold meets with probability ``recall``."""
    depth = levels
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts, one after the other, and where each text starts."""
    words = Words(texts, lower=True)
    hashes = words.hashes(21)
    starts, found = words.windows(hashes, SHINGLE, 23)
    owner = words.document()[starts] if len(words) else starts
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))  # all words are one shingle
    if len(short):
        whole = [
            int.from_bytes(
                hashlib.blake2b(hashes[a : a + n].tobytes(), digest_size=8).digest(), "little"
            )
            for a, n in zip(words.bounds[short], counts[short])
        ]
        owner = np.concatenate([owner, short])
        found = np.concatenate([found, np.array(whole, dtype=U64)])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(found):
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])])
        owner, found = owner[fresh], found[fresh]
    return found, np.searchsorted(owner, np.arange(len(counts) + 1))


def sign(docs: DataFrame, depth: int, trees: int) -> DataFrame:
    """Class and prefix keys of each text; texts without words have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = random_odd(31, 0, trees * depth), random_odd(33, 0, trees * depth)
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                shingles, bounds = shingle_sets(texts)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                nodes: list[bytes | None] = [None] * len(size)
                prefixes: list[np.ndarray | None] = [None] * len(size)
                if len(full):
                    first = bounds[:-1][full]
                    one = np.add.reduceat(mix(shingles), first)
                    two = np.add.reduceat(mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)), first)
                    keys = np.zeros((len(full), trees), dtype=U64)
                    for tree in range(trees):
                        key = np.full(len(full), tree, dtype=U64)
                        for n in range(tree * depth, (tree + 1) * depth):
                            least = np.minimum.reduceat(shingles * factor[n] + shift[n], first)
                            key = mix(key ^ least)
                        keys[:, tree] = key
                    raw = np.column_stack([one, two]).tobytes()
                    for k, d in enumerate(full):
                        nodes[d] = raw[16 * k : 16 * k + 16]
                        prefixes[d] = keys[k].view(np.int64)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(nodes, pa.binary()),
                        pa.array(size, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "node", "shingles", "prefixes"],
                )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col("text").alias("text"),
    )
    return narrow.mapInArrow(run, SIGNED)


def overlaps(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets and of all their intersections."""
    shingles, bounds = shingle_sets(texts)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    _, column, uses = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(size), len(size)), dtype=np.float32)
    total = int(shared.sum())
    for start in range(0, total, TILE):
        a, b = np.searchsorted(column, [start, start + TILE])
        tile = np.zeros((len(size), min(TILE, total - start)), dtype=np.float32)
        tile[owner[a:b], column[a:b] - start] = 1
        both += tile @ tile.T
    return size, both


def labels(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component in a small adjacency matrix."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        lower = np.where(reach, label, len(linked)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        chunk = group["chunk"].to_numpy()
        copies = group["copies"].to_numpy()
        size, both = overlaps(group["text"].chunk(0))
        union = size[:, None] + size[None, :] - both
        linked = both >= threshold * union - 1e-6
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= chunk[:, None] != chunk[None, :]
        nodes = group["node"].to_pylist()
        links = linked @ copies
        roots = [nodes[k] for k in labels(linked)]
        return pa.table({
            "node": pa.array(nodes, pa.binary()), "root": pa.array(roots, pa.binary()),
            "links": pa.array(links, pa.int64()), "alone": group["chunks"].to_numpy() == 1,
        })

    return run


def near_duplicates(
    docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """Classes of ``docs(doc_id, text)`` whose shingle sets are similar.

    One row per row of ``docs``: ``doc_id``, ``text_hash``, ``class_id`` (smallest id of
    the rows reached over links), ``n_links`` (other rows with a Jaccard similarity of
    ``threshold`` or more) and ``leader`` (the first of its class by id and hash).
    Words are split at white space, A-Z in lower case; a text of one to four words is
    one shingle; null and empty texts link to nothing and lead themselves. Repeated rows
    link to each other and are leaders together. Texts of any length count whole, other
    columns are ignored, an empty table gives no rows. A pair below the threshold never
    links; one above is missed with a probability under 1 - ``recall``.
    """
    small_batches(docs.sparkSession)
    depth = prefix_depth(threshold, trees, LEVELS, recall)
    signed = staged(sign(docs, depth, trees), "signed")
    place = F.struct(F.col("doc_id"), F.col("text_hash"))
    classes = signed.filter("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least_id"),
        F.min(place).alias("place"), F.first("prefixes").alias("prefixes"),
    )
    classes = staged(classes, "classes")

    # Nodes of the tries: classes under one prefix hang on the smallest of them.
    met = classes.select("node", F.explode("prefixes").alias("prefix"))
    heads = met.groupBy("prefix").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    heads = heads.filter("n > 1").withColumn("k", F.xxhash64("prefix")).drop("n")
    edges = met.withColumn("k", F.xxhash64("prefix")).join(heads, ["k", "prefix"]).select(
        F.col("node").alias("u"), F.col("head").alias("v")
    )
    groups = staged(components(edges), "groups")

    # Chunks of the groups, and the text of one row per class.
    sizes = groups.groupBy("root").agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")
    ).withColumn("k", F.xxhash64("root"))
    members = (
        groups.withColumn("k", F.xxhash64("root")).join(sizes, ["k", "root"]).drop("k")
        .join(classes.select("node", "copies", "place"), "node")
        .select(
            "node", "root", "chunks", "copies", "place.doc_id", "place.text_hash",
            F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"),
        )
    ).alias("m")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col("text").alias("text"),
    ).alias("t")
    same = F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (
        F.col("m.text_hash") == F.col("t.text_hash")
    )
    held = texts.join(members, same).select(
        "node", "root", "chunks", "chunk", "copies", "text"
    ).dropDuplicates(["node"])
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = paired.select(
        "node", "root", "chunks", "chunk", "copies", "text",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
    )
    found = paired.groupBy("root", "low", "high").applyInArrow(verify(threshold), VERIFIED)
    found = staged(found, "verified")

    # What was compared in one piece is final; the pieces of larger groups are joined.
    pieces = found.filter("not alone")
    joined = components(pieces.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = found.filter("alone").select("node", "root").union(joined.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "copies", "least_id", "place").join(roots, "node", "left").join(
        links, "node", "left"
    ).select(
        "node", F.coalesce("root", "node").alias("root"), "least_id", "place",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    heads = named.groupBy("root").agg(
        F.min("least_id").alias("class_id"), F.min("place").alias("first")
    ).withColumn("k", F.xxhash64("root"))
    named = named.withColumn("k", F.xxhash64("root")).join(heads, ["k", "root"]).select(
        "node", "class_id", "n_links", "first", F.xxhash64("node").alias("k")
    )
    rows = signed.select("doc_id", "text_hash", "node").withColumn("k", F.xxhash64("node"))
    return rows.join(named, ["k", "node"], "left").select(
        "doc_id", "text_hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")))
        .alias("leader"),
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each class; texts without words all stay.

    The other columns stay as they are, whatever their names. Of repeated rows one stays.
    """
    marked = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"),
        F.coalesce(F.btrim(docs["text"], F.lit(" \t\n\x0b\x0c\r")), F.lit("")).alias("bare"),
    ).alias("d")
    kept = near_duplicates(docs, **settings).filter("leader").select("doc_id", "text_hash")
    kept = kept.distinct().alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (
        F.col("d.text_hash") == F.col("k.text_hash")
    )
    left = marked.join(kept, same, "left_semi")
    # Repeated rows share id and text: all but one go.
    full = left.filter("bare != ''").dropDuplicates(["doc_id", "text_hash"])
    return full.select("row.*").unionByName(left.filter("bare = ''").select("row.*"))
