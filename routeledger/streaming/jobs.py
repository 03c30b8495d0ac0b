"""Streaming forms of redaction and of the scan.

They reuse the batch code. Redaction is stateless. A scan depends on facts of other
files of the repository (prefixes, aliases, mounts), so a micro-batch names the repos
that changed and rescans those from the file table. New endpoints that nothing protects
are counted in windows of commit time, which a state store keeps until the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.redact import redact_frame
from ..operators.joins import lookup
from ..plans.scan import scan


def redact_stream(
    rows: DataFrame, out: str, checkpoint: str, columns: list[str] | None = None
) -> StreamingQuery:
    """Redact a stream of rows and append it as Parquet."""
    return (
        redact_frame(rows, columns)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rescan_stream(
    changes: DataFrame,
    read_files: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Rescan the repos named in ``changes(repo, rel_path)``, one folder per batch.

    The folder is named by the batch and overwritten, so a batch that is run again
    after a failure leaves the same result.
    """

    def rescan(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("repo").distinct()
        files = lookup(read_files(), changed, ["repo"], "left_semi", spread=["rel_path"])
        scan(files).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(rescan)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_counts(endpoints: DataFrame, window: str = "1 hour") -> DataFrame:
    """``(repo, window_start, n)``: new endpoints without protection by time of their commit.

    For a stream with a watermark on ``committed_at`` and for a table alike; endpoints
    without a time are in no window.
    """
    offending = endpoints.filter(F.col("is_new") & ~F.col("auth_required"))
    return (
        offending.groupBy("repo", F.window("committed_at", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("repo", F.col("w.start").alias("window_start"), "n")
    )


def open_counts_stream(
    endpoints: DataFrame, out: str, checkpoint: str, window: str = "1 hour", late: str = "1 hour"
) -> StreamingQuery:
    """Append each window once it is closed, i.e. ``late`` behind the newest commit.

    Rows of a closed window are dropped, and the newest windows wait for later rows.
    """
    return (
        open_counts(endpoints.withWatermark("committed_at", late), window)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
