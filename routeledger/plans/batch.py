"""The four callable queries and the batch job with its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as ops
from ..operators import provenance, remedy, report
from ..operators.joins import stage
from ..sources.sinks import append_documents, append_endpoints, read_endpoints
from .scan import scan


def compare(endpoints: DataFrame, registry: DataFrame, repos: DataFrame | None = None) -> dict:
    """``matches``, ``posture`` and ``rejects`` of any frame of endpoint rows."""
    rows, rejects = ops.split_rejects(endpoints)
    matches = ops.match(rows, registry)
    return {
        "matches": matches,
        "posture": ops.posture(matches, registry, repos),
        "rejects": rejects,
    }


def window_commits(history: dict, since: str | None) -> tuple[DataFrame, DataFrame]:
    """The commits and added files of the window ``since`` (a ref name or a time).

    ``history`` holds the tables commits, refs, blame, file_changes and, for windows
    from a ref, ref_files ``(repo, ref, path)``; with a column ``blob`` there, and blobs
    ``(repo, blob, lines)``, renamed files do not count as added. Each repo is resolved by itself: from
    the ref of that name where it has one, else from the time. Repos for which it is
    neither have no window and are listed by ``window_rejects``.
    """
    commits, refs = history["commits"], history["refs"]
    head = refs.filter(F.col("name") == "HEAD")
    since = since or provenance.DEFAULT_WINDOW
    baseline = refs.filter(F.col("name") == since)
    named = baseline.select("repo").distinct()
    from_ref = provenance.commits_since_ref(
        commits, head.join(named, "repo", "left_semi"), baseline
    )
    from_date = stage(
        provenance.commits_since_date(
            commits, head.join(named, "repo", "left_anti"), provenance.window_start(since)
        ),
        "window",
    )
    added = provenance.added_in_commits(history["file_changes"], from_date)
    if (files := history.get("ref_files")) is not None:
        at_head = files.filter(F.col("ref") == "HEAD").join(named, "repo", "left_semi")
        added = added.unionByName(
            provenance.added_since_ref(
                at_head, files.filter(F.col("ref") == since), history.get("blobs")
            )
        )
    return from_ref.unionByName(from_date), added


def window_rejects(history: dict, since: str | None) -> DataFrame:
    """Repos in which ``since`` names no ref and is no time either: ``(repo, reason)``."""
    since = since or provenance.DEFAULT_WINDOW
    named = history["refs"].filter(F.col("name") == since)
    heads = history["refs"].filter(F.col("name") == "HEAD").select("repo").distinct()
    return (
        heads.join(named.select("repo"), "repo", "left_anti")
        .filter(provenance.window_start(since).isNull())
        .select("repo", F.lit(f"no ref or time {since!r}").alias("reason"))
    )


def annotate_since(
    endpoints: DataFrame,
    history: dict,
    since: str | None = None,
    scan_root: str | DataFrame = "",
) -> DataFrame:
    window, added = window_commits(history, since)
    return provenance.annotate(
        endpoints, history["blame"], history["commits"], stage(window, "window"), added, scan_root
    )


def new_unauthenticated(
    endpoints: DataFrame, history: dict, since: str | None = None
) -> DataFrame:
    """Endpoints introduced in the window (default: one week) that nothing protects."""
    return ops.new_unauthenticated(annotate_since(endpoints, history, since))


def remediation(endpoints: DataFrame, files: DataFrame) -> DataFrame:
    return remedy.diff_texts(remedy.remedy_diffs(ops.normalize_rows(endpoints), files))


def run_batch(
    files: DataFrame,
    out: str,
    config: DataFrame | None = None,
    runtime: DataFrame | None = None,
    history: dict | None = None,
    since: str | None = None,
    registry: DataFrame | None = None,
    new_only: bool = False,
    batch: str | None = None,
) -> dict:
    """Scan, optionally attribute and compare, and append the results under ``out``.

    Each result is a dataset of batches (see ``sinks``): a ``batch`` that is run again
    replaces its rows, without a name every run adds its own. Attribution is skipped without ``history``, comparison without ``registry``.
    Returns the written tables, read back.
    """
    spark = files.sparkSession
    endpoints = scan(files, config, runtime=runtime)
    if history is not None and since:
        endpoints = annotate_since(endpoints, history, since)
        append_endpoints(window_rejects(history, since), f"{out}/window_rejects", batch)
    endpoints = stage(endpoints, "endpoints")
    append_endpoints(endpoints, f"{out}/endpoints", batch)
    written = {"endpoints": endpoints}
    if registry is None:
        return written
    result = compare(endpoints, registry, files.select("repo").distinct())
    matches = stage(result["matches"], "matches")
    posture = stage(ops.posture(matches, registry, files.select("repo").distinct()), "posture")
    append_endpoints(report.findings(matches), f"{out}/findings", batch)
    append_endpoints(posture, f"{out}/posture", batch)
    gates = ops.gate(matches, new_only and bool(since), files.select("repo").distinct())
    append_endpoints(gates, f"{out}/gate", batch)
    for fmt in ("json", "sarif"):
        append_documents(report.render(matches, posture, fmt), f"{out}/{fmt}", batch)
    return written | {
        name: read_endpoints(spark, f"{out}/{name}") for name in ("findings", "posture", "gate")
    }
