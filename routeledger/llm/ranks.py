"""Places of rows in a total order, without one task or the driver seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Within a task, monotonically_increasing_id counts up from zero in its lower bits.
IN_TASK = (1 << 33) - 1


def dealt(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` staged in ranges of ``by``, with ``part`` (the range) and ``at`` (place in it).

    ``by`` should end in a column that tells equal rows apart, so that even a third of all
    rows with one key is cut into ranges.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = ordered.select(
        "*", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK)).alias("at"),
    )
    return staged(numbered, name)


def places(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos``, the row's place (from 0) in the order ``by``.

    Only the row counts of the ranges are brought together, one number per task.
    """
    rows = dealt(df, by, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    found = rows.join(F.broadcast(starts), "part")
    return found.select(*[f"`{c}`" for c in df.columns], (F.col("start") + F.col("at")).alias("pos"))


def places_in(df: DataFrame, key: str, by: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos`` (place from 0 among the rows of its ``key``) and ``n`` (all of them).

    ``key`` must not be null; ``by`` is the order inside a key. A key may span any number
    of ranges: one count per key and range is summed, and joined back to the rows.
    """
    rows = dealt(df, [F.col(key), *by], name)
    inside = Window.partitionBy(key).orderBy("part")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
        .select(
            key, "part", "first",
            F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"),
            F.sum("own").over(Window.partitionBy(key)).alias("n"),
        )
    )
    found = rows.join(starts, [key, "part"])
    return found.select(
        *[f"`{c}`" for c in df.columns],
        (F.col("start") + F.col("at") - F.col("first")).alias("pos"), "n",
    )
