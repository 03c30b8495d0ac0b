"""Commit history as tables: blame text and commit facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The record header of porcelain blame output, and the short-sha length.
BLAME_HEADER = r"^([0-9a-f]{40}) (\d+) (\d+)(?: (\d+))?$"
SHORT_SHA = 10


def blame_records(text: DataFrame) -> DataFrame:
    """Porcelain rows ``(repo, path, pos, raw)`` with the sha each belongs to."""
    is_header = F.col("raw").rlike(BLAME_HEADER)
    in_order = (
        Window.partitionBy("repo", "path")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    header = F.when(
        is_header,
        F.struct(
            F.regexp_extract("raw", BLAME_HEADER, 1).alias("sha"),
            F.regexp_extract("raw", BLAME_HEADER, 3).cast("int").alias("line"),
        ),
    )
    return (
        text.withColumn("is_header", is_header)
        .withColumn("record", F.last(header, ignorenulls=True).over(in_order))
        .filter(F.col("record").isNotNull())
    )


def blame_lines(records: DataFrame) -> DataFrame:
    """``(repo, path, line, sha)``, one row per content line."""
    return (
        records.filter(~F.col("is_header") & F.col("raw").startswith("\t"))
        .select("repo", "path", F.col("record.line").alias("line"), F.col("record.sha").alias("sha"))
        .distinct()
    )


def blame_authors(records: DataFrame) -> DataFrame:
    """``(repo, sha, author, author_time)``; given once per sha, the first one counts."""
    facts = records.filter(~F.col("is_header")).select(
        "repo",
        F.col("record.sha").alias("sha"),
        F.struct("path", "pos").alias("at"),
        F.when(F.col("raw").startswith("author "), F.trim(F.substring("raw", 8, 2**31 - 1))).alias("author"),
        F.when(
            F.col("raw").startswith("author-time "), F.trim(F.substring("raw", 13, 2**31 - 1))
        ).alias("author_time"),
    )
    known = facts.filter(F.col("author").isNotNull() | F.col("author_time").isNotNull())
    return known.groupBy("repo", "sha").agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
            for c in ("author", "author_time")
        ]
    )


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT_SHA)


def blame_ranges(lines: DataFrame) -> DataFrame:
    """``(repo, path, first, last, sha)``: runs of lines ``(repo, path, line, sha)`` of one commit."""
    in_order = Window.partitionBy("repo", "path").orderBy("line")
    goes_on = (F.lag("sha").over(in_order) == F.col("sha")) & (
        F.lag("line").over(in_order) == F.col("line") - 1
    )
    begins = F.when(goes_on, 0).otherwise(1)
    runs = lines.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    return (
        runs.groupBy("repo", "path", "run", "sha")
        .agg(F.min("line").alias("first"), F.max("line").alias("last"))
        .select("repo", "path", "first", "last", "sha")
    )


def commit_time(epoch: Column) -> Column:
    """Epoch seconds (number or text) as a timestamp; unreadable text is null."""
    return F.timestamp_seconds(epoch.cast("string").try_cast("bigint"))


def iso_utc(time: Column) -> Column:
    """ISO text with offset, in UTC whatever the session's time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_seconds(time).cast("decimal(18,6)")
    utc = zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
