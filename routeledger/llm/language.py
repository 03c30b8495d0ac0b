"""Language identification by compression with one raw-content dictionary per language.

A text is compressed once with every language's dictionary; the smallest result names
the language. Long texts are compressed in blocks, so that a text's own repetitions
never outweigh the dictionaries; every block counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches

UNKNOWN = "und"
SAMPLE_DOCS = 300  # training documents per language, those with the smallest id hash
PIECE_CHARS = 300  # a sampled text is cut into pieces, which are dealt by hash
DICTIONARY_BYTES = 112_000  # per language at most
ALL_BYTES = 128 * DICTIONARY_BYTES  # shared evenly by more languages, so none is favoured
LEVEL = 5
BLOCK_BYTES = 4 * 1024
MIN_MARGIN = 0.004
ROWS = 500  # rows turned into Python strings at a time

# ASCII letters in lower case, other ASCII as a space; further letters stay.
PLAIN = bytes(
    b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

FOUND = [
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
]


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary per label of ``labelled(doc_id, text, lang)``.

    A bounded sample: of every label the ``SAMPLE_DOCS`` documents with the smallest hash
    of the id, their whole texts cut into pieces, and of the pieces, in the order of a
    hash, up to ``DICTIONARY_BYTES``, or an equal share of ``ALL_BYTES`` (a piece at
    least) if that is less. Rows without text or label teach nothing; no label at all
    gives no dictionary.
    """
    rows = labelled.select(
        F.col("lang").alias("lang"), F.col("text").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("h"),
    ).filter("lang is not null and text is not null")
    labels = rows.select("lang").distinct().count()
    most_bytes = max(PIECE_CHARS, min(DICTIONARY_BYTES, ALL_BYTES // max(1, labels)))
    # Only labels and hashes are ranked; Spark ranks inside each task before it shuffles.
    first = Window.partitionBy("lang").orderBy("h")
    chosen = (
        rows.select("lang", "h")
        .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_DOCS)
        .groupBy("lang").agg(F.max("h").alias("most"))
    )
    sample = rows.join(F.broadcast(chosen), "lang").filter("h <= most")
    pieces = sample.select(
        "lang",
        F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0)))
        .alias("piece"),
    ).distinct()
    dealt = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    per_language = 4 * most_bytes // PIECE_CHARS
    kept = pieces.withColumn("n", F.row_number().over(dealt)).filter(F.col("n") <= per_language)
    found: dict[str, list[bytes]] = {}
    for lang, piece, _ in kept.orderBy("lang", "n").collect():
        found.setdefault(lang, []).append(plain(piece))
    # A dictionary's end is the cheapest to refer to; all of it is within reach.
    return {lang: b" ".join(p)[:most_bytes] for lang, p in found.items()}


def plain(text: str) -> bytes:
    """What is compressed: letters, with one space for whatever else stands between them."""
    return b" ".join(text.encode().translate(PLAIN).split())


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.labels = sorted(raw)
        self.letter = regex.compile(r"\p{L}")
        self.packers = []
        for label in self.labels:
            content = zstandard.ZstdCompressionDict(
                raw[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=LEVEL)
            self.packers.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False
                )
            )

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.labels or not self.letter.search(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(plain(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        margin = 1 - sizes[best] / min(rest) if rest else 1.0
        return self.labels[best], margin, margin >= MIN_MARGIN


def identify(docs: DataFrame, raw: dict[str, bytes]) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted`` to ``docs``; other columns stay.

    ``score`` is the share of bytes that the best dictionary saves against the second
    best; below ``MIN_MARGIN`` the text is not ``accepted`` (a single label always is).
    Only the text is looked at. Ties go to the label that sorts first. Null texts, texts
    without a letter, and any text where ``raw`` is empty are ``und`` with score 0.
    Columns of ``docs`` may have any names; those with the three names are replaced. Each row is judged alone, so
    repeated rows get equal results and an empty table gives none.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    slim = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("row"))
    schema = T.StructType([slim.schema["row"], *FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(raw)
        parts = (b.slice(n, ROWS) for b in batches for n in range(0, b.num_rows, ROWS))
        for part in parts:
            row = part.column(0)
            found = [model.predict(t) for t in row.field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=["row", "lang_pred", "score", "accepted"],
            )

    out = slim.mapInArrow(run, schema)
    return out.select("row.*", "lang_pred", "score", "accepted")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return docs.filter(~held_out(F.col("doc_id"), 3, 1))
