"""A corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
Null, empty and letterless texts leave at the first stage, with the documents whose
language is not clear; a document that loses all its lines to earlier ones leaves at the
second; of each class of near duplicates one stays; documents that hold a benchmark item
leave; the rest is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.llm import decontaminate, language, lines, near_duplicates, packing
from routeledger.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries come from the documents themselves."""
    raw = language.dictionaries(language.training_rows(docs.select("doc_id", "text", "lang")))
    return language.identify(docs, raw).filter("accepted").drop("lang_pred", "score", "accepted")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines repeated from earlier documents; emptied documents go."""
    left = lines.without_repeats(docs)
    whole = (F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\s]")
    return left.filter(whole).drop("lines_removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

# Compression, MinHash and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
