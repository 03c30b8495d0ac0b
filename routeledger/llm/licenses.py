"""License scans by diagonal voting over rolling word k-grams.

Every k-gram of a text is joined to the positions of equal k-grams in the templates.
Hits with the same offset between text and template lie on one diagonal; the hits of
one place on a diagonal are merged to a run, runs on neighbouring diagonals (a word
inserted or left out) to a span, and a span counts if it covers enough of its template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import ascii_lower

K = 3
DRIFT = 2  # words by which neighbouring runs of one span may be shifted
MIN_COVER = 0.8  # share of a template's words a span has to cover
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases whose places are counted, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Well-known wording of further licenses.
NOTICES = [
    ("gpl", "gnu general public license version 3"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification "
     "are permitted provided that the following conditions are met"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of "
     "this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose "
     "with or without fee is hereby granted"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
]


def words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def grams(tokens: Column, k: int) -> Column:
    """All runs of ``k`` words, joined by a space, in order."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (k - 1))
    joined = F.transform(
        starts, lambda i: F.concat_ws(" ", *[F.element_at(tokens, i + n) for n in range(k)])
    )
    return F.when(F.size(tokens) >= k, joined)


def template_grams(spark, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """One row per k-gram of each template; the templates are a fixed short list."""
    rows = [(n, label, text, base) for n, (label, text, base) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, phrase string, base boolean")
    tokens = words(F.col("phrase"))
    return frame.select(
        "template", "label", "base", F.size(tokens).alias("template_words"),
        F.posexplode(bind(tokens, lambda w: grams(w, k))).alias("template_pos", "gram"),
    )


def spans(
    docs: DataFrame, templates: list[tuple[str, str, bool]], k: int = K, drift: int = DRIFT
) -> DataFrame:
    """Places of templates in ``docs(doc_id, text)``.

    One row per span: the document (id and hash of the text, so rows that share both
    are one document), template, label, ``start`` and ``end`` in words, ``cover`` (share
    of the template's words found in order) and ``exact`` (all of them, consecutively).
    Joining on the words of the k-gram verifies each hit, so no hash decides. Null and
    empty texts have no spans, texts of any length are scanned whole, extra columns
    are ignored and an empty table gives no rows.
    """
    key = ["doc_id", "text_hash"]
    rolled = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(bind(words(F.col("text")), lambda w: grams(w, k))).alias("pos", "gram"),
    )
    known = F.broadcast(template_grams(docs.sparkSession, templates, k))
    hits = rolled.join(known, "gram").drop("gram").distinct()
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("template_pos"))

    # Runs: hits on one diagonal, one template long at most.
    place = ["template", "label", "base", "template_words", "diagonal"]
    runs = hits.groupBy(*key, *place).agg(
        F.count("*").alias("votes"), F.min("template_pos").alias("first"),
        (F.max("template_pos") + k).alias("last"),
    )
    runs = runs.withColumn("start", F.col("diagonal") + F.col("first"))
    runs = runs.withColumn("end", F.col("diagonal") + F.col("last"))

    # Spans: runs whose diagonals differ by a few words at most, a chain at a time.
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    chained = runs.withColumn("new", F.coalesce(gap > drift, F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("new").over(along))
    found = chained.groupBy(*key, "template", "label", "base", "template_words", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.least(F.sum(F.col("votes") + (k - 1)), F.first("template_words")).alias("covered"),
        F.sum((F.col("votes") + (k - 1) == F.col("template_words")).cast("int")).alias("places"),
        F.min(F.when(F.col("votes") + (k - 1) == F.col("template_words"), F.col("start")))
        .alias("first_exact"),
        F.max(F.when(F.col("votes") + (k - 1) == F.col("template_words"), F.col("start")))
        .alias("last_exact"),
    )
    return found.select(
        *key, "template", "label", "base", "start", "end", "places", "first_exact", "last_exact",
        (F.col("covered") / F.col("template_words")).alias("cover"),
    )


def scan(docs: DataFrame, *, min_cover: float = MIN_COVER) -> DataFrame:
    """License labels of each row of ``docs(doc_id, text)``.

    ``n_base`` counts the exact places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest start among them; ``labels`` adds the
    templates of which a span covers ``min_cover``. ``score`` is the best cover.
    A document without any has empty labels, null words and score 0. Repeated rows
    each get the same result.
    """
    templates = [(*p, True) for p in PHRASES] + [(*p, False) for p in NOTICES]
    found = spans(docs, templates)
    base = F.col("base")
    exact = base & (F.col("places") > 0)
    labels = F.array_sort(F.collect_set(F.when(F.col("cover") >= min_cover, F.col("label"))))
    per_document = found.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(base, F.col("places"))).alias("n_base"),
        F.min(F.when(base, F.col("first_exact"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last_exact"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(exact, F.col("label")))))
        .alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    ).alias("d")
    p = per_document.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (
        F.col("d.text_hash") == F.col("p.text_hash")
    )
    return rows.join(p, same, "left").select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
