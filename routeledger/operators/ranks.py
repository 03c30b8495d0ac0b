"""Places of rows inside a key, without one task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import stage

# Within a task, monotonically_increasing_id counts up from zero in its lower bits.
_IN_TASK = (1 << 33) - 1


def number_within(df: DataFrame, keys: list[str], by: list[Column], name: str) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2 … among the rows of equal ``keys``, in the order ``by``.

    The rows are staged in ranges of ``keys`` and ``by``, so a key with a third of all rows
    spans many ranges; only one count per key and range is summed up. ``keys`` are not
    null, and ``by`` tells the rows of a key apart.
    """
    order = [*[F.col(k) for k in keys], *by]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(
        dealt.select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)).alias("_at"),
        ),
        name,
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_own"))
        .withColumn("_start", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    )
    number = F.col("_start") + F.col("_at") - F.col("_first")
    return rows.join(starts, [*keys, "_part"]).select(
        *[f"`{c}`" for c in df.columns], number.cast("long").alias("number")
    )
