"""Helpers shared by the operators: given tables, staged tables and ASCII case."""

from __future__ import annotations

import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python at most ``BATCH_ROWS`` at a time, so batches stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach, as the session names it.

    Only a session inside one process, as in tests, may do without the setting.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="routeledger-"))
        folder = context.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back.

    It cuts the lineage between rounds of an iteration and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """``make()`` once in each Python worker process, also for functions sent by value."""
    home = "routeledger-worker"
    store = sys.modules.setdefault(home, types.ModuleType(home)).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
