"""Sinks: endpoint and finding tables, and one text document per repository.

A dataset is a folder of batches and a manifest of those that were written whole. Readers
take the batches named there, the last one of each name, so a batch that is run again
replaces itself and one that was cut off is never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string, attempt string, committed_at timestamp"


def _attempt(path: str) -> tuple[str, str]:
    attempt = uuid.uuid4().hex
    return attempt, f"{path}/data/attempt={attempt}"


def _commit(spark: SparkSession, path: str, batch: str | None, attempt: str) -> None:
    """One row in the manifest, written after all files of the attempt are in place."""
    row = spark.createDataFrame([(batch or attempt, attempt)], "batch string, attempt string")
    row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{path}/manifest"
    )


def append_endpoints(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add ``rows`` to the dataset; a ``batch`` of that name added before is replaced."""
    attempt, folder = _attempt(path)
    rows.write.parquet(folder)
    _commit(rows.sparkSession, path, batch, attempt)


def append_documents(
    lines: DataFrame, path: str, batch: str | None = None, compression: str | None = None
) -> None:
    """One text document per repository under ``repo=…``, as a batch.

    ``lines`` holds ``(repo, section, at, copy, line)``. They are ordered by range, so a
    large document spans several files, to be read one after the other by name. With
    ``compression`` (``gzip``) each file holds its text packed, and readers unpack it.
    """
    order = ["repo", "section", "at", "copy"]
    attempt, folder = _attempt(path)
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("repo", F.col("line").alias("value"))
        .write.partitionBy("repo").text(folder, compression=compression)
    )
    _commit(lines.sparkSession, path, batch, attempt)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of the last committed attempt of each batch; a name per batch."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = manifest.groupBy("batch").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("a"))
    return sorted(f"{path}/data/attempt={r.a}" for r in last.collect())


def read_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows of a dataset."""
    return spark.read.parquet(*committed(spark, path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(value, repo)``: the lines of all committed documents."""
    lines = spark.read.schema("value string, attempt string, repo string").option(
        "basePath", f"{path}/data"
    )
    return lines.text(committed(spark, path)).drop("attempt")
