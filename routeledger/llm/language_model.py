"""Language-model scoring by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of all orders and a
uniform one; the weights depend on how often the context occurs and are learned by
expectation-maximisation on held-out counts: each training token is held out once, its
estimates being those of all the others (counts less one).

Counts cover the whole training part. Blocks of documents send their distinct n-grams
to be counted and get the totals back; the text itself is shuffled once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches
from .rolling import U64, Words, mix, random_odd, slices
from .tally import REQUEST, blocks, column, ordered, replies, request, tally

ORDER = 2
FOLDS, FOLD = 7, 2  # documents of this fold are not learned from
WIDTH = 6  # bytes of an n-gram's hash that travel, besides the bucket
STEPS = 4  # classes per doubling in which estimates are counted for the weights
NEVER = -10_000  # class of an estimate of zero
ROUNDS = 200

END = U64(0x5851F42D4C957F2D)
OPEN = [U64(0x14057B7EF767814E) + U64(2 * m) for m in range(16)]  # contexts before a text
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)
CELLS = "bucket int, classes array<int>, n long, types long"
WEIGHTS = "context int, weights array<double>"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == FOLD


class Grams:
    """The n-grams of a block: for each order the key of every token's n-gram and context."""

    def __init__(self, table: pa.Table, order: int):
        texts = column(table, "text")
        found, sizes = [], []
        for _, part in slices(texts):
            words = Words(part, lower=True)
            hashes = words.hashes(3)
            counts = np.diff(words.bounds)
            # One end token after each text.
            tokens = np.insert(hashes, words.bounds[1:], END)
            found.append(tokens)
            sizes.append(counts + 1)
        self.sizes = np.concatenate(sizes)
        token = np.concatenate(found)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ids = column(table, "doc_id").to_pylist()
        self.ids = ids
        self.held = np.array([held_out(i) for i in ids])
        self.train = ~self.held[self.doc]
        # The lowest bit tells types (single tokens) from everything else.
        self.keys = [mix(token) | U64(1)]
        factor = random_odd(11, 0, order + 1)
        for m in range(1, order):
            shorter = np.empty_like(self.keys[-1])
            shorter[1:] = self.keys[-1][:-1]
            shorter[self.first] = OPEN[m]
            self.keys.append(mix(shorter * factor[m] + token) & ~U64(1))
        self.opened = int((~self.held).sum())

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and the place among them of every n-gram and opening context."""
        every = np.concatenate([*self.keys, np.array(OPEN[1:order], dtype=U64)])
        return np.unique(every, return_inverse=True)

    def counted(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and their counts in the block's training texts."""
        distinct, inverse = self.distinct(order)
        openings = np.full(order - 1, self.opened)
        weight = np.concatenate([*[self.train] * order, openings])
        return distinct, np.bincount(inverse, weights=weight, minlength=len(distinct)).astype(np.int64)

    def totals(self, known: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
        """Global counts of n-grams and contexts per token, all training tokens, types."""
        _, inverse = self.distinct(order)
        counts = replies(known, np.int64)[inverse]
        grams = np.split(counts[: order * len(self.doc)], order)
        # A context is the n-gram of one order less that ends at the token before.
        opened = counts[order * len(self.doc) :]
        contexts = []
        for m, shorter in enumerate(grams[:-1]):
            before = np.concatenate([shorter[:1], shorter[:-1]])
            before[self.first] = opened[m]
            contexts.append(before)
        return grams, contexts, sum(known["sum"].to_pylist()), sum(known["distinct"].to_pylist())


def classes(share: np.ndarray) -> np.ndarray:
    """Estimates in classes by their logarithm; zero has its own."""
    positive = share > 0
    safe = np.where(positive, share, 1.0)
    return np.where(positive, np.rint(np.log2(safe) * STEPS), NEVER).astype(np.int32)


def frequency(count: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count: 0, 1, 2-3, 4-7 …"""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int32)


def estimates(grams, contexts, total, less):
    """Relative frequencies by order, ``less`` being taken off every count."""
    below = [np.full(len(grams[0]), max(total - less, 0)), *[c - less for c in contexts]]
    return [
        np.where(d > 0, np.maximum(g - less, 0) / np.maximum(d, 1), 0.0)
        for g, d in zip(grams, below)
    ], below[-1]


def learn(cells: pd.DataFrame) -> pd.DataFrame:
    """Mixture weights of one frequency bucket by expectation-maximisation."""
    table = np.array(cells["classes"].tolist(), dtype=np.float64)
    shares = np.where(table <= NEVER, 0.0, np.exp2(table / STEPS))
    uniform = np.full((len(cells), 1), 1.0 / (float(cells["types"].iloc[0]) + 1))
    shares = np.hstack([uniform, shares])
    n = cells["n"].to_numpy(dtype=np.float64)[:, None]
    weights = np.full(shares.shape[1], 1.0 / shares.shape[1])
    for _ in range(ROUNDS):
        mixed = shares * weights
        mixed /= mixed.sum(axis=1, keepdims=True)
        fresh = (n * mixed).sum(axis=0) + 0.1  # every order keeps a little
        fresh /= fresh.sum()
        if np.abs(fresh - weights).max() < 1e-7:
            weights = fresh
            break
        weights = fresh
    return pd.DataFrame({"context": [int(cells["bucket"].iloc[0])], "weights": [weights.tolist()]})


def weight_table(found: list[dict], orders: int) -> np.ndarray:
    """A row of weights for each of 64 buckets; a bucket never seen takes its neighbour's."""
    table = np.zeros((64, orders + 1))
    table[:, 0] = 1.0
    for row in sorted(found, key=lambda r: r["context"]):
        table[row["context"] :] = row["weights"]
    return table


def score(docs: DataFrame, *, order: int = ORDER) -> DataFrame:
    """Log10 probabilities of the texts of ``docs(doc_id, text)``.

    Learns from the rows whose crc32 of the id modulo ``FOLDS`` is not ``FOLD`` and
    scores all rows. Tokens are white-space separated words, A-Z in lower case, then one
    end. ``base_score`` is the add-one unigram score. Null text is empty (one token), a
    null id counts as empty text, rows of equal id are scored each; with no training
    rows every token is equally likely; an empty table gives no rows. Other columns are
    ignored. The cells from which weights are learned are counts by classes of the
    estimates, so their number does not grow with the corpus.
    """
    small_batches(docs.sparkSession)
    parts = shuffle_partitions(docs.sparkSession)
    dealt, buckets = blocks(docs)
    dealt = dealt.repartition(parts, "block")

    def ask(table: pa.Table) -> pa.Table:
        table = ordered(table)
        keys, counts = Grams(table, order).counted(order)
        return request(table["block"][0].as_py(), keys, counts, buckets, WIDTH, every=True)

    def cells(table: pa.Table, known: pa.Table) -> pa.Table:
        grams = Grams(ordered(table), order)
        counts, contexts, total, types = grams.totals(known, order)
        shares, context = estimates(counts, contexts, total, 1)
        cell = frequency(context)[grams.train].astype(np.int64)
        for share in shares:  # one number per combination of classes
            cell = cell * (1 - NEVER) + (classes(share[grams.train]) - NEVER)
        cell, n = np.unique(cell, return_counts=True)
        parts = []
        for _ in shares:
            cell, last = np.divmod(cell, 1 - NEVER)
            parts.append(last + NEVER)
        distinct = np.column_stack([cell, *parts[::-1]])
        return pa.table({
            "bucket": pa.array(distinct[:, 0], pa.int32()),
            "classes": pa.array(distinct[:, 1:].tolist(), pa.list_(pa.int32())),
            "n": pa.array(n, pa.int64()),
            "types": pa.array(np.full(len(n), types), pa.int64()),
        })

    def rate(table: pa.Table, known: pa.Table) -> pa.Table:
        grams = Grams(ordered(table), order)
        counts, contexts, total, types = grams.totals(known, order)
        given = next((w for w in known["learned"].to_pylist() if w), [])
        weights = weight_table(given, order)
        shares, context = estimates(counts, contexts, total, 0)
        chosen = weights[frequency(context)]
        mixed = chosen[:, 0] / (types + 1)
        for m, share in enumerate(shares):
            mixed += chosen[:, m + 1] * share
        add = lambda x: np.add.reduceat(x, grams.first)
        base = np.log10((counts[0] + 1) / (total + (types + 1)))
        return pa.table({
            "doc_id": pa.array(grams.ids, pa.int64()), "held_out": pa.array(grams.held),
            "n_tokens": pa.array(grams.sizes, pa.int64()),
            "n_known": pa.array(add((counts[0] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(grams.ids), total), pa.int64()),
            "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(mixed))),
        })

    answers = tally(
        dealt.groupBy("block").applyInArrow(ask, REQUEST), WIDTH,
        lambda totals: totals.astype(np.int64), counted=lambda keys: keys & U64(1) == 1,
    ).repartition(parts, "block")
    seen = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cells, CELLS)
    gathered = seen.groupBy("bucket", "classes", "types").agg(F.sum("n").alias("n"))
    learned = gathered.groupBy("bucket").applyInPandas(learn, WEIGHTS)
    # At most 64 short rows; each block gets them with its answer from bucket 0.
    table = learned.agg(
        F.collect_list(F.struct("context", "weights")).alias("learned"),
        (F.count("*") * 0).cast("int").alias("bucket"),
    )
    told = answers.join(F.broadcast(table), "bucket", "left")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(rate, SCORES)
