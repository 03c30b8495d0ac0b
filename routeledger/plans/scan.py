"""The scan: source files to endpoints, over many repositories at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import java_routes, js_routes, python_routes, python_syntax
from ..operators.compare import normalize_rows
from ..operators.joins import stage
from ..sources.files import select_sources, unreadable
from ..sources.runtime import runtime_endpoints, supersede


def staged_syntax(files: DataFrame) -> DataFrame:
    """Syntax rows of the Python files that can matter, written once."""
    chosen = files.filter(
        (F.col("language") == "python") & python_syntax.may_matter(F.col("content"))
    )
    return stage(python_syntax.python_syntax(chosen), "python-syntax")


def staged_js_lines(files: DataFrame) -> DataFrame:
    """Mount and route lines of the JavaScript files, written once."""
    chosen = files.filter(F.col("language") == "javascript")
    return stage(js_routes.route_lines(chosen), "js-lines")


def java_sources(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language") == "java")


def scan(
    files: DataFrame,
    config: DataFrame | None = None,
    excluded: list[str] | None = None,
    runtime: DataFrame | None = None,
) -> DataFrame:
    """Endpoints of ``(repo, rel_path, content)`` in the canonical schema.

    ``config`` holds resolved word lists per repo, ``excluded`` replaces the default
    directory names, ``runtime`` is a runtime inventory that supersedes the static
    JavaScript rows of its repos. File content is read by narrow stages only; what
    is shuffled is syntax facts and the lines of files that name a route.
    """
    sources = select_sources(files, excluded)
    branches = [
        python_routes.python_endpoints(staged_syntax(sources), config),
        java_routes.java_endpoints(java_sources(sources), config),
        js_routes.js_endpoints(staged_js_lines(sources), config),
    ]
    endpoints = reduce(DataFrame.unionByName, branches)
    if runtime is not None:
        endpoints = supersede(endpoints, runtime_endpoints(runtime, config))
    return normalize_rows(endpoints)


def scan_errors(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """``(repo, rel_path, reason)`` of the files that yield nothing."""
    sources = select_sources(files, excluded)
    readable = sources.filter(
        (F.col("language") == "python") & F.col("content").isNotNull()
    )
    syntax = python_syntax.python_syntax(readable)
    return python_syntax.parse_errors(syntax).unionByName(unreadable(sources))
