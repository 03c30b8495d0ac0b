"""Line deduplication by overlapping three-line windows.

Windows of three consecutive non-blank lines are hashed; of equal windows in the whole
table the first stays, and the lines that any later one covers are removed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import small_batches

SPAN = 3
CUT = "text string, removed int"


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(text: Column, span: int) -> Column:
    """``(line, hash, check)`` of each window: the place of its first non-blank line."""
    full = F.filter(text_lines(text), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    digests = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))

    def windows(d: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(d) - (span - 1))
        rolled = F.transform(starts, lambda i: F.struct(
            i.alias("line"), F.xxhash64(*[F.element_at(d, i + n).a for n in range(span)]).alias("a"),
            F.xxhash64(*[F.element_at(d, i + n).b for n in range(span)]).alias("b"),
        ))
        return F.when(F.size(d) >= span, rolled)

    return bind(digests, windows)


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Starts of windows that occur earlier: ``doc_id, text_hash, starts array<int>``.

    Earlier means a smaller ``(doc_id, text_hash, line)``, null ids first. The first
    places are found with partial aggregation, so a window that stands in a third of
    all documents reaches its task as one row per map task; the join back to the places
    is an ordinary one that Spark may split where a window is frequent.
    """
    places = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.explode(line_windows(F.col("text"), span)).alias("w"),
    ).select("doc_id", "text_hash", "w.line", "w.a", "w.b")
    place = F.struct("doc_id", "text_hash", "line")
    firsts = (
        places.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first")
    )
    # The third key makes Spark shuffle both sides for the join, so that it can split a
    # frequent window over several tasks.
    firsts = firsts.withColumn("k", F.xxhash64("a", "b"))
    places = places.withColumn("k", F.xxhash64("a", "b"))
    later = places.join(firsts, ["k", "a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("starts"))


def cut_lines(texts: pd.Series, starts: pd.Series, span: int) -> pd.DataFrame:
    """Texts without the non-blank lines that ``span`` lines from each start cover."""
    out = []
    for text, found in zip(texts, starts):
        if found is None or len(found) == 0:
            out.append((text, 0))
            continue
        gone = {int(s) + n for s in found for n in range(span)}
        kept, number = [], 0
        for line in text.split("\n"):
            full = bool(line.strip(" \t\r"))
            number += full
            if not (full and number in gone):
                kept.append(line)
        out.append(("\n".join(kept), len(gone)))
    return pd.DataFrame(out, columns=["text", "removed"])


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and ``lines_removed`` added.

    The other columns stay, whatever their names (``lines_removed`` is replaced). Blank
    lines neither count nor go. Texts of fewer than ``span`` non-blank lines, empty and
    null texts stay as they are. Rows that share id and text are one document and get
    the same result; rows that share only the id are told apart by their text. Within
    one text a repetition is a later occurrence too. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in own]).alias("row"),
        docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"),
    ).alias("d")
    found = repeated(docs, span).alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (
        F.col("d.text_hash") == F.col("r.text_hash")
    )
    cut = F.pandas_udf(lambda texts, starts: cut_lines(texts, starts, span), CUT)
    joined = rows.join(found, same, "left").select("row", cut("row.text", "starts").alias("cut"))
    kept = [
        (F.col("cut.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in own
    ]
    return joined.select(*kept, F.col("cut.removed").alias("lines_removed"))
