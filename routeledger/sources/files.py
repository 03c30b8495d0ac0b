"""Source-file tables: reading, directory exclusion and language dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories skipped by default, and suffixes per language.
EXCLUDED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".idea", ".vscode",
    "__pycache__", ".venv", "venv", "env", ".env", ".tox", ".mypy_cache",
    ".pytest_cache", "site-packages", ".eggs", "build", "dist",
    "node_modules", "bower_components", "target", ".gradle", "out",
    "tests", "test", "__tests__", "examples", "example", "fixtures",
]
LANGUAGE_SUFFIXES = {
    "python": [".py"],
    "java": [".java"],
    "javascript": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"],
}


def language_of(path: Column) -> Column:
    """Language by suffix, ignoring case; null for other files."""
    low = F.lower(path)
    result = F.lit(None).cast("string")
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        hit = F.lit(False)
        for suffix in suffixes:
            hit = hit | low.endswith(suffix)
        result = F.when(hit, language).otherwise(result)
    return result


def in_excluded_directory(path: Column, excluded: list[str] | None = None) -> Column:
    """True if any directory of ``path`` (not its last part) is excluded."""
    names = EXCLUDED_DIRECTORIES if excluded is None else excluded
    if not names:
        return F.lit(False)
    parts = F.split(path, "/")
    return F.arrays_overlap(
        F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(n) for n in names])
    )


def select_sources(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Files worth scanning, with their language: narrow, on paths only."""
    return files.withColumn("language", language_of(F.col("rel_path"))).filter(
        F.col("language").isNotNull() & ~in_excluded_directory(F.col("rel_path"), excluded)
    )


def _source_glob() -> str:
    """A path pattern of the known suffixes in any case, for the file listing."""
    each = [
        "".join(f"[{c}{c.upper()}]" for c in suffix.removeprefix("."))
        for suffixes in LANGUAGE_SUFFIXES.values() for suffix in suffixes
    ]
    return "*.{" + ",".join(each) + "}"


def read_tree(
    spark: SparkSession, root: str, repo: str | None = None, excluded: list[str] | None = None
) -> DataFrame:
    """The source files of a directory tree as ``(repo, rel_path, content)``.

    Excluded folders are never listed and other files never opened (see ``trees``). Keep a
    fleet's files as a Parquet table of these columns, as a listing asks for every folder.
    Without ``repo`` the first directory level names the repository. Files that are not
    UTF-8 have null content and yield no endpoints (see ``unreadable``). A store that only
    Spark reads is listed by Spark, which goes into every folder.
    """
    from . import trees

    names = EXCLUDED_DIRECTORIES if excluded is None else excluded
    if trees.reachable(root):
        found = trees.read_files(trees.list_tree(spark, root, names), root)
        inside, content = F.col("rel_path"), F.col("content")
    else:
        found = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", _source_glob()).load(root)
        )
        base = F.lit(root.rstrip("/") + "/")
        inside = F.substr("path", F.instr("path", base) + F.length(base))
        found = found.filter(~in_excluded_directory(inside, names))
        content = F.expr("try_validate_utf8(CAST(content AS STRING))")
    if repo is None:
        name, rel = F.substring_index(inside, "/", 1), F.regexp_replace(inside, "^[^/]*/", "")
    else:
        name, rel = F.lit(repo), inside
    return found.select(name.alias("repo"), rel.alias("rel_path"), content.alias("content"))


def unreadable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("content").isNull()).select(
        "repo", "rel_path", F.lit("not UTF-8 text").alias("reason")
    )
