"""Lookup joins that survive hot keys, and staging of shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD = 64

# Rows of one key that a task should join, and the most keys that are heavy at once.
KEY_ROWS = 1_000_000
HEAVY_KEYS = 10_000


def heavy_keys(left: DataFrame, on: list[str]) -> DataFrame:
    """``(*on, _tasks)``: keys with more rows than one task should join, and how many should.

    Rows are counted by key with map-side combining. The bound grows with the table, so
    fewer than ``HEAVY_KEYS`` keys are heavy whatever its size.
    """
    bound = max(KEY_ROWS, left.count() // HEAVY_KEYS)
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    return counted.select(*on, F.ceil(F.col("_n") / bound).cast("int").alias("_tasks"))


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    spread: list[str],
    small: bool = True,
    costly: bool = False,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds at most one row per key.

    ``right`` is staged, which sums its bytes on the way: up to ``BROADCAST_BYTES`` it is
    broadcast, so ``left`` is not shuffled at all. Beyond, or where the caller knows it to
    be large (``small=False``), both sides are sort-merged. The rows of a heavy key are
    then spread over as many tasks as its count asks for, by a hash of ``spread`` (columns
    that vary within one key), and its one right row is copied to each; other keys are
    neither spread nor copied. ``left`` is read three times on this way; where it is
    ``costly`` to work out, it is staged first.
    """
    if small:
        right, held = measured(right, "lookup")
        if held <= BROADCAST_BYTES:
            return left.join(F.broadcast(right), on, how)
    if costly:
        left = stage(left, "lookup-left")
    heavy = F.broadcast(stage(heavy_keys(left, on), "heavy-keys"))
    tasks = F.coalesce("_tasks", F.lit(1))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), tasks).cast("int")
    salted_left = left.join(heavy, on, "left").withColumn("_salt", salt).drop("_tasks")
    copies = F.explode(F.sequence(F.lit(0), tasks - 1))
    salted_right = right.join(heavy, on, "left").withColumn("_salt", copies).drop("_tasks")
    return salted_left.join(salted_right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a session inside one process (local tests) may do without the setting; on a
    cluster a private folder would lose rows, so its absence is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="routeledger-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stage(df, name)`` and about how many bytes its rows take, summed while writing."""
    seen = Observation()
    width = F.octet_length(F.to_json(F.struct("*"))) + ROW_OVERHEAD
    staged = stage(df.observe(seen, F.sum(width).alias("bytes")), name)
    return staged, seen.get["bytes"] or 0


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where several branches read one costly result, and between rounds of an
    iteration. The table outlives lost executors, cuts the lineage, and gives
    Catalyst its real size, which is what decides on a broadcast later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

