"""Histories of any size made small, so that what is left of a repository fits one walk."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import stage

# One commit in so many stays in a round, and how often the others' pointers are doubled:
# a run of commits shrinks to about a third per round.
RESTING = 8
JUMPS = 3

# A round that leaves more than this share of the links is the last one.
STALLED = 0.95

# Within a task, monotonically_increasing_id counts up from zero in its lower bits.
_IN_TASK = (1 << 33) - 1


def numbered(commits: DataFrame, repos: DataFrame) -> tuple[DataFrame, int]:
    """``(id, code, repo, sha, parents)`` and the number of repos.

    Ids are gapless numbers times the number of repos, plus the repo's ``code``; rows of
    one sha are united.
    """
    codes = stage(
        repos.select("repo", (F.row_number().over(Window.orderBy("repo")) - 1).alias("code")), "codes"
    )
    n_repos = codes.count()
    united = (
        commits.filter(F.col("sha").isNotNull())
        .groupBy("repo", "sha")
        .agg(F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents"))
    )
    rows = stage(
        united.select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)).alias("_at"),
        ),
        "commits",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    nodes = rows.join(F.broadcast(starts), "_part").join(F.broadcast(codes), "repo").select(
        ((F.col("_start") + F.col("_at")) * n_repos + F.col("code")).alias("id"),
        "code", "repo", "sha", "parents",
    )
    return nodes, n_repos


def _round(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """One round: the edges left, and ``(id, into)`` of the commits that were merged."""
    def rests(commit: Column) -> Column:
        return F.pmod(F.xxhash64(commit, F.lit(salt)), F.lit(RESTING)) == 0

    one = (F.col("next") == F.col("last")) & (F.col("next") >= 0) & ~rests(F.col("id"))
    step = stage(
        edges.groupBy(F.col("parent").alias("id"))
        .agg(F.min("child").alias("next"), F.max("child").alias("last"))
        .select("id", F.when(one, F.col("next")).otherwise(F.col("id")).alias("into"))
        # A pointer is final if what it leads to stays.
        .withColumn("final", (F.col("into") == F.col("id")) | rests(F.col("into"))),
        "steps",
    )
    for _ in range(JUMPS):
        ahead = step.select(
            F.col("id").alias("into"), F.col("into").alias("further"), F.col("final").alias("there")
        )
        moved = step.filter(~F.col("final")).join(ahead, "into", "left").select(
            "id", F.coalesce("further", "into").alias("into"),
            F.coalesce("there", F.lit(True)).alias("final"),
        )
        step = stage(step.filter("final").unionByName(moved), "steps")
    step = step.select("id", F.when(F.col("final"), F.col("into")).otherwise(F.col("id")).alias("into"))
    stays = step.filter(F.col("id") == F.col("into")).select(F.col("id").alias("parent"))
    left = (
        edges.join(stays, "parent", "left_semi")
        .join(step.withColumnRenamed("id", "child"), "child", "left")
        # A commit without children that is no start reaches nothing.
        .filter((F.col("child") < 0) | F.col("into").isNotNull())
        .select(F.coalesce("into", "child").alias("child"), "parent")
        .filter(F.col("child") != F.col("parent"))
    )
    return stage(left, "edges"), step.filter(F.col("id") != F.col("into"))


def _walk(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    real = edges[edges.child >= 0]
    parents = real.groupby("child")["parent"].agg(list).to_dict()
    entries: dict[str, list[int]] = {}
    for start, labels in edges.loc[edges.child < 0, ["parent", "labels"]].itertuples(index=False):
        for label in labels:
            entries.setdefault(label, []).append(start)
    reached: dict[int, list[str]] = {}
    for label, todo in sorted(entries.items()):
        seen = set(todo)
        while todo:
            fresh = set(parents.get(todo.pop(), ())) - seen
            seen |= fresh
            todo += fresh
        for commit in seen:
            reached.setdefault(commit, []).append(label)
    return pd.DataFrame({"id": list(reached), "labels": list(reached.values())})


def reachable(commits: DataFrame, repos: DataFrame, starts: DataFrame, limit: int, rest) -> DataFrame:
    """``(repo, label, sha)`` of the commits of ``repos``: each start and all its ancestors.

    A commit that no label starts from and that has one child is reached with that child,
    so it is merged into it; one without children is dropped. Merging runs of such commits
    leaves a third of them per round, so all rounds together move a small multiple of
    the history, in numbers instead of shas. Once every repo has at most ``limit`` links, each
    is walked as one group; repos that do not shrink that far go to ``rest``, which has the
    arguments ``(commits, starts)`` and this result. Merged commits then get the labels of
    what they were merged into, last round first.
    """
    nodes, n_repos = numbered(commits, repos)
    labels = stage(
        starts.join(nodes.select("id", "repo", "sha"), ["repo", "sha"])
        .groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels")),
        "starts",
    )
    # A start has a child of its own, a negative number: it is neither merged nor dropped.
    virtual = (-F.col("id") - 1).alias("child")
    links = nodes.select("code", F.col("id").alias("child"), F.explode("parents").alias("sha")).join(
        nodes.select("code", "sha", F.col("id").alias("parent")), ["code", "sha"]
    )
    edges = stage(
        links.select("child", "parent").filter(F.col("child") != F.col("parent"))
        .unionByName(labels.select(virtual, F.col("id").alias("parent"))),
        "edges",
    )
    code = F.pmod("parent", F.lit(n_repos))
    merged: list[DataFrame] = []
    held = edges.count()
    while True:
        large = edges.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        if large.isEmpty():
            break
        edges, gone = _round(edges, len(merged))
        merged.append(gone)
        before, held = held, edges.count()
        if held > STALLED * before:
            break
    large = stage(large.select("code"), "large") if not large.isEmpty() else None
    coded = edges.withColumn("code", code)
    small = coded if large is None else coded.join(F.broadcast(large), "code", "left_anti")
    known = [
        stage(
            small.join(labels.select(virtual, "labels"), "child", "left")
            .groupBy("code").applyInPandas(_walk, "id bigint, labels array<string>"),
            "reached",
        )
    ]
    if large is not None:
        links = coded.join(F.broadcast(large), "code")
        real = links.filter("child >= 0")
        ids = links.select("code", F.col("parent").alias("sha")).union(real.select("code", "child")).distinct()
        above = real.groupBy(F.col("child").alias("sha")).agg(F.collect_set("parent").alias("parents"))
        left = stage(
            ids.join(above, "sha", "left").select(
                F.col("code").alias("repo"), "sha",
                F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"),
            ),
            "contracted",
        )
        entries = labels.select(
            F.pmod("id", F.lit(n_repos)).alias("repo"), F.explode("labels").alias("label"), F.col("id").alias("sha")
        ).join(F.broadcast(large.withColumnRenamed("code", "repo")), "repo", "left_semi")
        found = rest(left, entries).groupBy(F.col("sha").alias("id"))
        known.append(stage(found.agg(F.array_sort(F.collect_set("label")).alias("labels")), "reached"))
    for gone in reversed(merged):
        have = reduce(DataFrame.unionByName, known).withColumnRenamed("id", "into")
        known.append(stage(gone.join(have, "into").select("id", "labels"), "reached"))
    return (
        reduce(DataFrame.unionByName, known).join(nodes.select("id", "repo", "sha"), "id")
        .select("repo", F.explode("labels").alias("label"), "sha")
    )
