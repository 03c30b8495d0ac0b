"""One named query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    language,
    language_model,
    licenses,
    lines,
    manifest,
    near_duplicates,
    packing,
    personal,
    resampling,
    sharding,
    substrings,
    topk,
)
from .common import held_out, table


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs).select("doc_id", "class_id", "n_links")


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("text_hash")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substrings.remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.without_repeats(docs)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    raw = language.dictionaries(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), raw)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "lang_pred", "score", "accepted",
    )


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audit(table(spark, folder, "documents"))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.digest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_topk": op2_topk,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_manifest": op11_manifest,
    "op12_resampling": op12_resampling,
    "op13_personal_data": op13_personal_data,
}
