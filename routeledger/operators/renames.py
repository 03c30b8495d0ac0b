"""Renames between two file lists: added files paired with removed ones, one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup, stage
from .ranks import number_within

# The least similarity of a changed rename.
SIMILAR = 0.5

# Lines in more files of a repo than this are ranked by how many; the rest count as rare.
COMMON = 16

_SIDE = ["repo", "path", "blob"]


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def unpaired(head_files: DataFrame, baseline_files: DataFrame) -> DataFrame:
    """``(repo, path, blob, side)``: files at one ref only, side ``added`` or ``removed``."""
    keys = ["repo", "path"]
    new = head_files.select(*_SIDE).join(baseline_files.select(*keys), keys, "left_anti")
    old = baseline_files.select(*_SIDE).join(head_files.select(*keys), keys, "left_anti")
    return new.withColumn("side", F.lit("added")).unionByName(
        old.withColumn("side", F.lit("removed"))
    )


def _paired_by_rank(files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Added and removed files of equal ``keys``, the n-th by path with the n-th."""
    ranked = stage(
        number_within(files.filter("blob IS NOT NULL"), [*keys, "side"], [F.col("path")], name),
        f"{name}-ranked",
    )

    def side(which: str, path: str) -> DataFrame:
        rows = ranked.filter(F.col("side") == which)
        return rows.select(*keys, "number", F.col("path").alias(path))

    pairs = side("added", "path").join(side("removed", "old_path"), [*keys, "number"])
    return stage(pairs.select("repo", "path", "old_path"), f"{name}-pairs")


def _without(files: DataFrame, pairs: DataFrame) -> DataFrame:
    taken = pairs.select("repo", "path", F.lit("added").alias("side")).unionByName(
        pairs.select("repo", F.col("old_path").alias("path"), F.lit("removed").alias("side"))
    )
    return files.join(taken, ["repo", "path", "side"], "left_anti")


def exact_renames(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of equal content, ``(repo, path, old_path)``, and the files left over.

    Equal base names are paired first. Files of one content, such as empty ones, may be
    any share of all files: they are ranked by path and joined by rank, not by content.
    """
    files = stage(files.withColumn("base", _base(F.col("path"))), "files")
    same_name = _paired_by_rank(files, ["repo", "blob", "base"], "same-name")
    rest = stage(_without(files, same_name), "renamed")
    any_name = _paired_by_rank(rest, ["repo", "blob"], "any-name")
    return same_name.unionByName(any_name), stage(_without(rest, any_name), "changed")


def line_sets(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """``files`` with ``lines``, the set of hashes of their lines; empty sets go.

    ``blobs`` holds ``(repo, blob, lines)``, one row per content; only contents that are
    still wanted are joined.
    """
    wanted = files.select("repo", "blob").distinct()
    kept = lookup(blobs, wanted, ["repo", "blob"], "left_semi", spread=["blob"])
    joined = lookup(files, kept.select("repo", "blob", "lines"), ["repo", "blob"], "inner", spread=["path"])
    return joined.withColumn("lines", F.array_distinct("lines")).filter(F.size("lines") > 0)


def _similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a), F.size(b))


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs ``(repo, path, old_path)`` that are similar, with their ``score``."""
    def side(which: str, path: str, lines: str) -> DataFrame:
        rows = sets.filter(F.col("side") == which)
        return rows.select("repo", F.col("path").alias(path), F.col("lines").alias(lines))

    both = pairs.join(side("added", "path", "a"), ["repo", "path"]).join(
        side("removed", "old_path", "b"), ["repo", "old_path"]
    )
    scored = both.select("repo", "path", "old_path", _similarity(F.col("a"), F.col("b")).alias("score"))
    return scored.filter(F.col("score") >= SIMILAR)


def _unique_names(sets: DataFrame) -> DataFrame:
    """Pairs whose base name occurs once among the added and once among the removed files."""
    def side(which: str, path: str) -> DataFrame:
        rows = sets.filter(F.col("side") == which).groupBy("repo", "base")
        return rows.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(path)).filter("n = 1").drop("n")

    return side("added", "path").join(side("removed", "old_path"), ["repo", "base"]).drop("base")


def _sharing_rare_lines(sets: DataFrame) -> DataFrame:
    """Pairs that may be similar: they share one of the rarest lines of both.

    Two sets with an overlap of at least ``SIMILAR`` of the larger share a line among the
    first ``n - ceil(SIMILAR * n) + 1`` of each in any common order, here the rarest first;
    so lines that stand in most files seldom make a candidate.
    """
    tokens = sets.select("repo", "path", "side", F.explode("lines").alias("line"))
    common = tokens.groupBy("repo", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON)
    counted = lookup(tokens, common, ["repo", "line"], spread=["path"])
    ordered = counted.groupBy("repo", "path", "side").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "line"))).alias("o")
    )
    keep = F.size("o") - F.ceil(F.size("o") * SIMILAR).cast("int") + 1
    first = stage(
        ordered.select("repo", "path", "side", F.explode(F.slice("o", F.lit(1), keep)).alias("o"))
        .select("repo", "path", "side", "o.line"),
        "rare-lines",
    )
    removed = first.filter("side = 'removed'").select("repo", "line", F.col("path").alias("old_path"))
    added = first.filter("side = 'added'").select("repo", "line", "path")
    return added.join(removed, ["repo", "line"]).select("repo", "path", "old_path").distinct()


def best_pairs(scored: DataFrame) -> DataFrame:
    """One-to-one pairs, the best first: rounds that take every pair best for both its ends.

    Ties go to the smaller path, then to the smaller old path, so the order is total and
    the rounds give what taking pairs one by one in that order would.
    """
    open_pairs, found = stage(scored, "open-pairs"), None
    while not open_pairs.isEmpty():
        order = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("old_path").alias("o"))
        by_new = open_pairs.groupBy("repo", "path").agg(F.min(order).alias("best"))
        by_old = open_pairs.groupBy("repo", "old_path").agg(F.min(order).alias("best"))
        taken = stage(
            by_new.select("repo", "path", F.col("best.o").alias("old_path"), "best")
            .join(by_old, ["repo", "old_path", "best"])
            .select("repo", "path", "old_path", (-F.col("best.s")).alias("score")),
            "taken-pairs",
        )
        found = taken if found is None else found.unionByName(taken)
        open_pairs = stage(
            open_pairs.join(taken.select("repo", "path"), ["repo", "path"], "left_anti")
            .join(taken.select("repo", "old_path"), ["repo", "old_path"], "left_anti"),
            "open-pairs",
        )
    return open_pairs if found is None else found


def renames(head_files: DataFrame, baseline_files: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """``(repo, path, old_path, score)``: added files that are removed ones under a new path.

    Files are ``(repo, path, blob)`` rows, a null blob pairs with nothing. Equal contents
    come first (score 1). With ``blobs(repo, blob, lines)``, the hashes of a content's
    lines, changed files follow: first those whose base name is unique on both sides, then
    all that share at least ``SIMILAR`` of the larger file's distinct lines, best pairs
    first. Each file is used once.
    """
    exact, rest = exact_renames(unpaired(head_files, baseline_files))
    found = exact.withColumn("score", F.lit(1.0))
    if blobs is None:
        return found
    sets = stage(line_sets(rest, blobs), "line-sets")
    named = stage(_scored(_unique_names(sets), sets), "named-pairs")
    others = stage(_without(sets, named), "other-sets")
    moved = best_pairs(_scored(_sharing_rare_lines(others), others))
    return found.unionByName(named).unionByName(moved)
