"""Importance resampling towards a target text collection, over hashed word runs.

A batch's distinct words enter an Aho-Corasick automaton between two delimiters; each
carries its CRC-32 and its length in bytes. One scan per text emits these payloads in
order, neighbouring payloads are composed to the CRC of a run of words without touching
the text again, and the CRC modulo the buckets is the feature. Spark counts the buckets
of all texts of both collections, weighs every text by its buckets' log ratios and draws
the highest noisy weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .ranks import places

BUCKETS = 10_000
RUN = 1  # words of the longest run
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10

ROWS = 500  # texts turned into Python strings at a time
BATCH_BYTES = 4 << 20  # text whose distinct words share an automaton
LONG_WORD = 256  # longer words are hashed directly, so no automaton grows with one word

# ASCII letters in lower case and digits; other ASCII is a delimiter; further bytes stay.
PLAIN = bytes(
    b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)

SCHEMA = "n_words long, n_features long, buckets array<int>, counts array<int>"


def _shift_tables() -> np.ndarray:
    """For each power of two: the 32 columns that append so many zero bytes to a CRC."""
    polynomial = 0xEDB88320
    bit = np.array([polynomial, *(1 << np.arange(31))], dtype=np.uint32)  # one zero bit

    def apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for k in range(32):
            out ^= np.where(values >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
        return out

    for _ in range(3):  # one, two, four, eight zero bits
        bit = apply(bit, bit)
    tables = [bit]
    for _ in range(31):
        tables.append(apply(tables[-1], tables[-1]))
    return np.array(tables)


SHIFTS = _shift_tables()


def appended(crc: np.ndarray, lengths: np.ndarray, crc_next: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from theirs and the second one's length."""
    out = crc.astype(np.uint32)
    left = lengths.astype(np.int64)
    power = 0
    while left.any():
        odd = np.nonzero(left & 1)[0]
        if len(odd):
            values, moved = out[odd], np.zeros(len(odd), np.uint32)
            for k in range(32):
                moved ^= np.where(values >> np.uint32(k) & np.uint32(1), SHIFTS[power][k], np.uint32(0))
            out[odd] = moved
        left >>= 1
        power += 1
    return out ^ crc_next.astype(np.uint32)


class Dictionary:
    """An automaton over distinct words, each between spaces, with CRC and length."""

    def __init__(self, words: set[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        short = [w for w in words if len(w) <= LONG_WORD]
        for k, word in enumerate(short):
            self.automaton.add_word(f" {word.decode()} ", k)
        self.crc = np.fromiter(map(zlib.crc32, short), np.uint32, len(short))
        self.length = np.fromiter(map(len, short), np.int64, len(short))
        if short:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each of ``words``, from one scan over them."""
        if not len(self.crc):
            return self._direct(words)
        text = f" {b' '.join(words).decode()} "
        hits = np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64)
        crc, length = self.crc[hits], self.length[hits]
        if len(hits) == len(words):
            return crc, length
        # Words too long for the automaton: put theirs where they stand.
        long = np.fromiter((len(w) > LONG_WORD for w in words), bool, len(words))
        all_crc, all_length = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        all_crc[~long], all_length[~long] = crc, length
        all_crc[long], all_length[long] = self._direct([w for w in words if len(w) > LONG_WORD])
        return all_crc, all_length

    @staticmethod
    def _direct(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.fromiter(map(zlib.crc32, words), np.uint32, len(words)),
            np.fromiter(map(len, words), np.int64, len(words)),
        )


SPACE = np.frombuffer(zlib.crc32(b" ").to_bytes(4, "little"), np.uint32)


def run_crcs(crc: np.ndarray, length: np.ndarray, run: int) -> np.ndarray:
    """CRC-32 of every run of 1 to ``run`` neighbouring words, joined by one space."""
    found, whole = [crc], crc
    for k in range(1, min(run, len(crc))):
        spaced = appended(whole[:-1], np.ones(len(whole) - 1, np.int64), np.repeat(SPACE, len(whole) - 1))
        whole = appended(spaced, length[k:], crc[k:])
        found.append(whole)
    return np.concatenate(found)


def bucket_counts(
    texts: list[str | None], run: int, buckets: int
) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``SCHEMA`` for each text; the texts' distinct words share one automaton."""
    split = [(t or "").encode().translate(PLAIN).split() for t in texts]
    dictionary = Dictionary(set().union(*split))
    found = []
    for words in split:
        crc, length = dictionary.scan(words)
        if len(crc):
            crc = run_crcs(crc, length, run)
        values, counts = np.unique(crc % np.uint32(buckets), return_counts=True)
        found.append((len(words), len(crc), values.astype(np.int32), counts.astype(np.int32)))
    return found


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, cut where their bytes pass ``BATCH_BYTES``."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def features(docs: DataFrame, key: str | None, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``key`` (if given), ``n_words``, ``n_features`` and the bucket counts of each row's ``text``.

    A null text has no words. Repeated rows stay, other columns are left out.
    """
    small_batches(docs.sparkSession)
    kept = [F.lit(None).cast("long").alias("key") if key is None else docs[key].alias("key")]
    slim = docs.select(*kept, docs["text"].alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(n, ROWS) for b in batches for n in range(0, b.num_rows, ROWS))
        for part in parts:
            rows = [
                r for g in _groups(part.column("text").to_pylist()) for r in bucket_counts(g, run, buckets)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    _lists([r[2] for r in rows]), _lists([r[3] for r in rows]),
                ],
                names=["key", "n_words", "n_features", "buckets", "counts"],
            )

    found = slim.mapInArrow(count, f"key {kind}, {SCHEMA}")
    return found.drop("key") if key is None else found.withColumnRenamed("key", key)


def totals(found: DataFrame) -> DataFrame:
    """``(bucket, n)`` over all rows of ``found``, combined in each task before the shuffle."""
    pairs = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A bucket's gain: floor of 1000 ln of its smoothed share in the target over the corpus.

    The result is one number per bucket, whose count is the parameter ``buckets``.
    """
    counts = totals(corpus).withColumnRenamed("n", "s").join(
        totals(target).withColumnRenamed("n", "t"), "bucket", "full"
    )
    s_of, t_of = np.zeros(buckets), np.zeros(buckets)
    for bucket, s, t in counts.select("bucket", "s", "t").collect():
        s_of[bucket], t_of[bucket] = s or 0, t or 0
    ratio = (t_of + 1) * (s_of.sum() + buckets) / ((s_of + 1) * (t_of.sum() + buckets))
    return [int(g) for g in np.floor(1000 * np.log(ratio))]


def weight(gain: list[int]) -> Column:
    """The floored mean gain over a row's features; 0 without any."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(
        F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"),
        lambda acc, p: acc + p["counts"] * F.get(table, p["buckets"]),
    )
    n = F.col("n_features")
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0).cast("long"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Floored Gumbel noise of a row, from a hash of the seed and its id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, *, run: int = RUN, buckets: int = BUCKETS,
    seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Features are runs of 1 to ``run`` words of ``text``, repeats counted; ``target`` needs
    a column ``text`` only. Of the rows with ``least_words`` words the ``percent`` with the
    highest scores get a ``rank`` from 1, ties to the smaller ``doc_id`` (null last); equal
    rows share id, score and so neighbouring ranks. Null, empty and wordless texts have no
    features, weight 0 and no rank. Texts of any length are scanned whole. An empty target
    or corpus counts 0 everywhere; other columns take no part.
    """
    corpus = staged(features(docs.select("doc_id", "text"), "doc_id", run, buckets), "features")
    gain = gains(corpus, features(target.select("text"), None, run, buckets), buckets)
    scored = corpus.select(
        "doc_id", "n_features", weight(gain).alias("weight"),
        (F.col("n_words") >= least_words).alias("drawable"),
    ).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("row_id", F.monotonically_increasing_id())
    order = [
        F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(),
        F.col("row_id"),
    ]
    drawn = scored.filter("drawable").count() * percent // 100
    ranked = places(scored, order, "ranked")
    return ranked.select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"),
    )
