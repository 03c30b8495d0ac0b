"""Commit windows over the history graph and attribution of endpoints to commits."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.history import commit_time, short_sha
from . import contraction
from .joins import lookup, stage
from .renames import renames

# The window used when none is given.
DEFAULT_WINDOW = "1 week ago"

# Commits of one repo that a single task may walk (about 30 MB of shas).
GROUP_LIMIT = 200_000

# Lines of a file that one group of the range join holds.
RANGE_BIN = 256

_RELATIVE = re.compile(r"^\s*(\d+)\s+(second|minute|hour|day|week|month|year)s?(?:\s+ago)?\s*$")


def window_start(since: str) -> Column:
    """``N unit(s) ago`` or an ISO date/time as a timestamp column; null for other text."""
    relative = _RELATIVE.match(since)
    if relative:
        number, unit = relative.groups()
        return F.current_timestamp() - F.expr(f"INTERVAL {number} {unit}")
    return F.try_to_timestamp(F.lit(since))


def first_parent_sizes(commits: DataFrame) -> DataFrame:
    """``(repo, sha, parent, size)``: size counts the commits of the first-parent subtree.

    Pointer doubling: after round k a commit knows its 2^k-th first-parent ancestor
    and the number of descendants closer than 2^k, so the rounds are the logarithm of
    the history's depth. Sums are combined before the shuffle, which keeps commits
    with many children harmless.
    """
    first = F.try_element_at("parents", F.lit(1))
    known = commits.select("repo", F.col("sha").alias("parent"))
    base = stage(
        commits.select("repo", "sha", first.alias("parent"))
        .join(known.withColumn("_known", F.lit(True)), ["repo", "parent"], "left")
        .select("repo", "sha", F.when(F.col("_known"), F.col("parent")).alias("parent")),
        "first-parents",
    )
    state = base.select("repo", "sha", F.col("parent").alias("far"), F.lit(1).cast("bigint").alias("size"))
    while not state.filter(F.col("far").isNotNull()).isEmpty():
        gained = (
            state.filter(F.col("far").isNotNull())
            .groupBy("repo", F.col("far").alias("sha"))
            .agg(F.sum("size").alias("gain"))
        )
        hop = state.select("repo", F.col("sha").alias("far"), F.col("far").alias("next"))
        state = stage(
            lookup(
                state.join(gained, ["repo", "sha"], "left"), hop, ["repo", "far"], spread=["sha"],
                small=False,
            ).select(
                "repo", "sha", F.col("next").alias("far"),
                (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
            ),
            "subtree-sizes",
        )
    return base.join(state.select("repo", "sha", "size"), ["repo", "sha"])


def commit_chains(commits: DataFrame) -> DataFrame:
    """Cut the history into vertex-disjoint first-parent chains.

    Returns ``(repo, sha, chain, pos)``: ``chain`` is the sha of the newest commit
    of the chain and ``pos`` the distance from it. Every parent passes its chain on
    to the one child with the largest subtree, so any first-parent path changes
    chains at most log2(n) times. Positions come from pointer doubling: finished
    commits leave the working set and the open ones have distinct join keys.
    """
    sizes = first_parent_sizes(commits)
    links = (
        sizes.filter(F.col("parent").isNotNull())
        .groupBy("repo", F.col("parent").alias("sha"))
        .agg(F.max_by("sha", F.struct("size", "sha")).alias("next"))
    )
    state = stage(
        commits.select("repo", "sha")
        .join(links, ["repo", "sha"], "left")
        .select(
            "repo",
            "sha",
            F.coalesce("next", "sha").alias("chain"),
            F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("pos"),
            F.col("next").isNull().alias("done"),
        ),
        "chains",
    )
    finished, pending = [state.filter("done")], state.filter("NOT done")
    while not pending.isEmpty():
        ahead = reduce(DataFrame.unionByName, [*finished, pending]).select(
            "repo",
            F.col("sha").alias("chain"),
            F.col("chain").alias("next"),
            F.col("pos").alias("further"),
            F.col("done").alias("at_head"),
        )
        # Only the open commits are written again.
        state = stage(
            pending.drop("done").join(ahead, ["repo", "chain"]).select(
                "repo",
                "sha",
                F.col("next").alias("chain"),
                (F.col("pos") + F.col("further")).alias("pos"),
                F.col("at_head").alias("done"),
            ),
            "chains",
        )
        finished.append(state.filter("done"))
        pending = state.filter("NOT done")
    return reduce(DataFrame.unionByName, finished).drop("done")


def _reachable_by_chains(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """``reachable`` for histories of any size, spread over the cluster.

    Along a chain everything behind the entry point is reached, so the state is one number
    per ``(repo, label, chain)`` and a round follows all links between chains that
    the last round newly opened. The rounds number the nesting of merges, not the
    length of the history.
    """
    places = commit_chains(commits)
    child = places.select(
        "repo", F.col("sha").alias("child"), F.col("chain").alias("from_chain"),
        F.col("pos").alias("from_pos"),
    )
    parent = places.select(
        "repo", F.col("sha").alias("parent"), F.col("chain").alias("to_chain"),
        F.col("pos").alias("to_pos"),
    )
    links = stage(
        commits.select("repo", F.col("sha").alias("child"), F.explode("parents").alias("parent"))
        .join(child, ["repo", "child"])
        .join(parent, ["repo", "parent"])
        # A link inside a chain leads to an older place that is reached anyway.
        .filter(F.col("from_chain") != F.col("to_chain"))
        .select("repo", "from_chain", "from_pos", "to_chain", "to_pos"),
        "chain-links",
    )
    entry = stage(
        starts.join(places, ["repo", "sha"])
        .groupBy("repo", "label", "chain")
        .agg(F.min("pos").alias("pos"))
        # Everything at or behind ``pos`` is reached; ``before`` is the older bound.
        .withColumn("before", F.lit(None).cast("bigint")),
        "entries",
    )
    frontier = entry
    while not frontier.isEmpty():
        # The frontier is unique per (repo, label, chain): spread the links over salts.
        opened = (
            lookup(
                links,
                frontier.select(
                    "repo", F.col("chain").alias("from_chain"),
                    F.struct("label", "pos", "before").alias("f"),
                ).groupBy("repo", "from_chain").agg(F.collect_list("f").alias("fs")),
                ["repo", "from_chain"],
                how="inner",
                spread=["from_pos", "to_chain"],
                small=False,
            )
            .select("*", F.explode("fs").alias("f"))
            .filter(
                (F.col("from_pos") >= F.col("f.pos"))
                & (F.col("f.before").isNull() | (F.col("from_pos") < F.col("f.before")))
            )
            .groupBy("repo", F.col("f.label").alias("label"), F.col("to_chain").alias("chain"))
            .agg(F.min("to_pos").alias("new_pos"))
        )
        entry = stage(
            entry.select("repo", "label", "chain", F.col("pos").alias("old_pos"))
            .join(opened, ["repo", "label", "chain"], "full_outer")
            .select(
                "repo",
                "label",
                "chain",
                F.least("old_pos", "new_pos").alias("pos"),
                F.col("old_pos").alias("before"),
            ),
            "entries",
        )
        frontier = entry.filter(F.col("before").isNull() | (F.col("pos") < F.col("before")))
    bounds = entry.groupBy("repo", "chain").agg(
        F.collect_list(F.struct("label", "pos")).alias("bounds")
    )
    return (
        lookup(places, bounds, ["repo", "chain"], how="inner", spread=["sha"], small=False)
        .select("repo", "sha", "pos", F.explode("bounds").alias("b"))
        .filter(F.col("pos") >= F.col("b.pos"))
        .select("repo", F.col("b.label").alias("label"), "sha")
    )


def _walk_group(key: tuple, history: pd.DataFrame) -> pd.DataFrame:
    parents = dict(zip(history.sha, history.parents))
    found = []
    for label in sorted({x for labels in history.labels for x in labels}):
        todo = [s for s, labels in zip(history.sha, history.labels) if label in labels]
        seen = set(todo)
        while todo:
            fresh = {p for p in parents[todo.pop()] if p in parents} - seen
            seen |= fresh
            todo += fresh
        found += [(key[0], label, sha) for sha in seen]
    return pd.DataFrame(found, columns=["repo", "label", "sha"])


def reachable(
    commits: DataFrame, starts: DataFrame, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``(repo, label, sha)``: each start and all its ancestors.

    ``starts`` is ``(repo, label, sha)``; several labels are followed at once. Repos
    are counted first: those of at most ``group_limit`` commits are walked one group
    per repo, larger ones are contracted until that holds for what is left of them, and
    those that do not shrink so far go by chains, so no task ever holds more than the limit.
    """
    labels = starts.groupBy("repo", "sha").agg(F.collect_set("label").alias("labels"))
    sizes = commits.groupBy("repo").agg((F.count(F.lit(1)) > group_limit).alias("large"))
    # Nothing is reached in a repo without a start.
    counted = stage(sizes.join(starts.select("repo"), "repo", "left_semi"), "repos")
    rows = lookup(commits.select("repo", "sha", "parents"), counted, ["repo"], "inner", spread=["sha"])
    small = (
        rows.filter(~F.col("large"))
        .join(labels, ["repo", "sha"], "left")
        .select(
            "repo", "sha",
            F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
            F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        )
        .groupBy("repo")
        .applyInPandas(_walk_group, "repo string, label string, sha string")
    )
    large = counted.filter("large")
    if large.isEmpty():
        return small
    return small.unionByName(
        contraction.reachable(
            rows.filter("large").drop("large"), large, starts, group_limit, _reachable_by_chains
        )
    )


def commits_since_ref(commits: DataFrame, head: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(repo, sha)`` reachable from the head and not from the baseline."""
    starts = head.select("repo", F.lit("head").alias("label"), "sha").unionByName(
        baseline.select("repo", F.lit("baseline").alias("label"), "sha")
    )
    return (
        reachable(commits, starts)
        .groupBy("repo", "sha")
        .agg(F.bool_or(F.col("label") == "baseline").alias("old"))
        .filter(~F.col("old"))
        .select("repo", "sha")
    )


def commits_since_date(commits: DataFrame, head: DataFrame, since: Column) -> DataFrame:
    """``(repo, sha)`` reachable from the head with a commit time at or after ``since``."""
    reached = reachable(
        commits, head.select("repo", F.lit("head").alias("label"), "sha")
    ).select("repo", "sha")
    recent = commits.filter(commit_time(F.col("commit_time")) >= since).select("repo", "sha")
    return reached.join(recent, ["repo", "sha"], "left_semi")


def added_since_ref(
    head_files: DataFrame, baseline_files: DataFrame, blobs: DataFrame | None = None
) -> DataFrame:
    """``(repo, path)`` present at the head and absent at the baseline.

    Where the file lists name their contents (column ``blob``), a file moved from a path
    that is gone counts as renamed, not as added; see ``renames``.
    """
    keys = ["repo", "path"]
    new = head_files.select(*keys).join(baseline_files.select(*keys), keys, "left_anti")
    if "blob" not in head_files.columns or "blob" not in baseline_files.columns:
        return new
    moved = renames(head_files, baseline_files, blobs).select(*keys)
    return new.join(moved, keys, "left_anti")


def added_in_commits(file_changes: DataFrame, window: DataFrame) -> DataFrame:
    """``(repo, path)`` with an add inside the window's commits."""
    adds = file_changes.filter(F.col("change") == "A").select("repo", "sha", "path")
    return (
        lookup(adds, window, ["repo", "sha"], how="left_semi", spread=["path"], costly=True)
        .select("repo", "path")
        .distinct()
    )


def _touched(located: DataFrame, blame: DataFrame) -> DataFrame:
    """``located`` endpoints with the sha of the range of lines that holds theirs (or null).

    Ranges are cut at multiples of ``RANGE_BIN`` lines, so the join is by equal keys and a
    long file's ranges are many small groups; a range of a whole file costs a row per bin.
    """
    first, last = ("first", "last") if "first" in blame.columns else ("line", "line")
    spans = blame.select(
        "repo", F.col("path").alias("_path"), F.col(first).alias("_first"), F.col(last).alias("_last"),
        F.col("sha").alias("_sha"),
    )
    files = located.select("repo", "_path").distinct()
    near = lookup(spans, files, ["repo", "_path"], "left_semi", spread=["_first"], costly=True)

    def bin_of(line: Column) -> Column:
        return F.floor(line / RANGE_BIN).cast("int")

    cut = near.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_first")), bin_of(F.col("_last")))))
    at = located.withColumn("_bin", bin_of(F.col("line_number")))
    keys = ["repo", "_path", "_bin"]
    inside = F.col("l.line_number").between(F.col("s._first"), F.col("s._last"))
    same = reduce(Column.__and__, [F.col(f"l.{k}") == F.col(f"s.{k}") for k in keys])
    return at.alias("l").join(cut.alias("s"), same & inside, "left").select("l.*", "s._sha").drop("_bin")


def annotate(
    endpoints: DataFrame,
    blame: DataFrame,
    commits: DataFrame,
    window: DataFrame,
    added: DataFrame,
    scan_root: str | DataFrame = "",
) -> DataFrame:
    """Mark endpoints whose definition line was last touched inside the window.

    ``blame`` holds ranges ``(repo, path, first, last, sha)`` that do not overlap, or a row
    ``(repo, path, line, sha)`` per line.

    ``scan_root`` is the scanned directory inside the repository: one for all, or rows
    ``(repo, scan_root)``, at most one per repo, those without one being scanned at the
    top. Endpoints found at
    run time have line 0, which no blame row has, so they are never new.
    """
    bare = endpoints.drop("is_new", "change_type", "commit", "author", "committed_at")
    if isinstance(scan_root, str):
        rooted = bare.withColumn("_root", F.lit(scan_root))
    else:
        rooted = lookup(
            bare, scan_root.select("repo", F.col("scan_root").alias("_root")), ["repo"],
            spread=["source_file", "line_number", "method"],
        )
    root = F.nullif(F.btrim("_root", F.lit("/")), F.lit(""))
    located = rooted.withColumn("_path", F.concat_ws("/", root, "source_file")).drop("_root")
    touched = _touched(located, blame)
    # One commit may have touched a third of all lines (an import): spread by file.
    meta = commits.select("repo", F.col("sha").alias("_sha"), "author", "author_time").join(
        window.select("repo", F.col("sha").alias("_sha"), F.lit(True).alias("_in")),
        ["repo", "_sha"],
    )
    spread = ["source_file", "line_number", "method"]
    known = lookup(touched, meta, ["repo", "_sha"], spread=spread, costly=True)
    flagged = known.join(
        added.select("repo", F.col("path").alias("_path"), F.lit(True).alias("_added")),
        ["repo", "_path"],
        "left",
    )
    new = F.coalesce("_in", F.lit(False))
    return flagged.select(
        *bare.columns,
        new.alias("is_new"),
        F.when(new, F.when(F.col("_added"), "added").otherwise("modified")).alias("change_type"),
        F.when(new, short_sha(F.col("_sha"))).alias("commit"),
        F.when(new, F.col("author")).alias("author"),
        F.when(new, commit_time(F.col("author_time"))).alias("committed_at"),
    )
