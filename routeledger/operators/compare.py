"""Endpoints against the registry: status, posture, gate and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path, path_shape
from ..schemas import ENDPOINTS
from .joins import lookup

# Canonical framework names and the language of each framework.
FRAMEWORK_NAMES = {
    "fastapi": "FastAPI",
    "flask": "Flask",
    "spring": "Spring",
    "spring boot": "Spring Boot",
    "springboot": "Spring Boot",
    "express": "Express",
}
FRAMEWORK_LANGUAGES = {
    "FastAPI": "python",
    "Flask": "python",
    "Spring": "java",
    "Spring Boot": "java",
    "Express": "javascript",
}

_ROW = ["source_file", "line_number"]


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def framework_name(framework: Column) -> Column:
    """Canonical name; unknown names are kept trimmed."""
    trimmed = F.trim(framework)
    return F.coalesce(_mapping(FRAMEWORK_NAMES)[F.lower(trimmed)], trimmed)


def normalize_rows(endpoints: DataFrame) -> DataFrame:
    """Any frame of endpoint rows in the canonical schema; absent columns get defaults."""
    present = set(endpoints.columns)
    defaults = {"auth_required": F.lit(False), "is_new": F.lit(False)}

    def column(field):
        default = defaults.get(field.name, F.lit(None))
        value = F.col(field.name) if field.name in present else default
        if field.name in defaults:
            value = F.coalesce(value, default)
        return value.cast(field.dataType)

    columns = {f.name: column(f) for f in ENDPOINTS.fields}
    columns["method"] = F.upper(columns["method"])
    columns["framework"] = framework_name(columns["framework"])
    columns["language"] = F.coalesce(
        columns["language"], _mapping(FRAMEWORK_LANGUAGES)[columns["framework"]]
    )
    return endpoints.select(*[c.alias(n) for n, c in columns.items()])


def split_rejects(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical rows, and those without a framework name."""
    rows = normalize_rows(endpoints)
    blank = F.coalesce(F.col("framework") == "", F.lit(True))
    return rows.filter(~blank), rows.filter(blank)


def with_registered(endpoints: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``registered``: some registry entry has the same shape and method.

    An exact match implies an equal shape, so one join covers both.
    """
    shapes = (
        registry.select("repo", "shape", "method")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    joined = lookup(
        endpoints.withColumn("shape", path_shape(F.col("path"))),
        shapes,
        ["repo", "shape", "method"],
        spread=_ROW,
    )
    return joined.withColumn(
        "registered", F.coalesce("_known", F.lit(False))
    ).drop("_known", "shape")


def match(endpoints: DataFrame, registry: DataFrame) -> DataFrame:
    """Endpoints with ``registered`` and ``status``."""
    return with_registered(endpoints, registry).withColumn(
        "status",
        F.when(~F.col("registered"), "shadow")
        .when(~F.col("auth_required"), "missing_auth")
        .otherwise("documented"),
    )


def coverage(endpoints: DataFrame, registry: DataFrame, repos: DataFrame) -> DataFrame:
    """Share of distinct parsed keys that are registered; 1.0 where nothing was parsed."""
    keys = (
        endpoints.select("repo", normalize_path(F.col("path")).alias("path"), "method")
        .distinct()
        .withColumn("source_file", F.col("path"))
        .withColumn("line_number", F.lit(0))
    )
    ratios = (
        with_registered(keys, registry)
        .groupBy("repo")
        .agg(F.avg(F.col("registered").cast("double")).alias("ratio"))
    )
    return repos.join(ratios, "repo", "left").select(
        "repo", F.coalesce("ratio", F.lit(1.0)).alias("coverage_ratio")
    )


def posture(matches: DataFrame, registry: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per repo: counts and the coverage ratio.

    Rows are first counted per ``(repo, path, method)`` with map-side combining, so
    repeated keys of a hot repo collapse before the per-repo step.
    """
    def total(condition: Column) -> Column:
        return F.count_if(condition)

    keys = matches.groupBy(
        "repo", normalize_path(F.col("path")).alias("path"), "method"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        total(F.col("status") == "shadow").alias("shadow"),
        total(~F.col("auth_required")).alias("open"),
        total(F.col("is_new")).alias("new"),
        F.bool_or("registered").alias("registered"),
    )
    per_repo = keys.groupBy("repo").agg(
        F.sum("n").alias("parsed_routes_count"),
        F.sum("shadow").alias("shadow_count"),
        F.sum("open").alias("missing_auth_count"),
        F.sum("new").alias("new_count"),
        F.avg(F.col("registered").cast("double")).alias("coverage_ratio"),
    )
    known = (
        registry.select("repo", "path", "method")
        .distinct()
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("registered_routes_count"))
    )
    joined = per_repo.join(known, "repo", "full_outer")
    if repos is not None:
        joined = repos.select("repo").distinct().join(joined, "repo", "left")
    zero = F.lit(0).cast("bigint")
    counts = [
        "parsed_routes_count", "registered_routes_count",
        "shadow_count", "missing_auth_count", "new_count",
    ]
    return joined.select(
        "repo",
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("coverage_ratio", F.lit(1.0)).alias("coverage_ratio"),
    )


def gate(
    matches: DataFrame, new_only: bool = False, repos: DataFrame | None = None
) -> DataFrame:
    """``(repo, violations, passed)``; shadow and open rows each count once per list.

    ``repos`` adds the repositories without endpoints, which pass with 0 violations.

    With ``new_only`` every row of a key that has a new row counts, old rows too.
    """
    keys = matches.groupBy("repo", "path", "method").agg(
        F.sum(
            (F.col("status") == "shadow").cast("bigint")
            + (~F.col("auth_required")).cast("bigint")
        ).alias("violations"),
        F.bool_or("is_new").alias("any_new"),
    )
    counted = F.col("violations")
    if new_only:
        counted = F.when(F.col("any_new"), counted).otherwise(F.lit(0))
    counts = keys.select("repo", counted.alias("violations"))
    if repos is not None:
        none = repos.select("repo", F.lit(0).cast("bigint").alias("violations"))
        counts = counts.unionByName(none)
    totals = counts.groupBy("repo").agg(F.sum("violations").alias("violations"))
    return totals.withColumn("passed", F.col("violations") == 0)


def shadow_endpoints(endpoints: DataFrame, registry: DataFrame) -> DataFrame:
    return match(endpoints, registry).filter(F.col("status") == "shadow")


def new_unauthenticated(endpoints: DataFrame) -> DataFrame:
    """Rows introduced in the window that nothing protects."""
    return endpoints.filter(F.col("is_new") & ~F.col("auth_required"))


def with_location(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn(
        "location", F.concat_ws(":", "source_file", F.col("line_number").cast("string"))
    )
