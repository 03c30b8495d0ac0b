"""OpenAPI specifications to a registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path, path_shape

# The operations that count.
REGISTRY_VERBS = ["get", "post", "put", "delete", "patch", "options", "head"]

_OBJECT = "map<string,string>"


def invalid_specs(specs: DataFrame) -> DataFrame:
    """Specifications that are not JSON objects: ``(repo, reason)``."""
    return specs.filter(F.from_json("spec_json", _OBJECT).isNull()).select(
        "repo", F.lit("not a JSON object").alias("reason")
    )


def registry(specs: DataFrame, strict: bool = False) -> DataFrame:
    """``(repo, path, shape, method)``, distinct, from ``(repo, spec_json)``.

    With ``strict`` an unreadable specification fails the job; otherwise it yields
    no rows and shows up in ``invalid_specs``.
    """
    root = F.from_json("spec_json", _OBJECT)
    if strict:
        root = F.coalesce(
            root, F.raise_error(F.lit("specification is not a JSON object")).cast(_OBJECT)
        )
    items = specs.select("repo", root.alias("root")).select(
        "repo", F.explode(F.from_json(F.col("root")["paths"], _OBJECT)).alias("key", "item")
    )
    verbs = items.select(
        "repo", "key", F.explode(F.map_keys(F.from_json("item", _OBJECT))).alias("verb")
    ).filter(F.lower("verb").isin(REGISTRY_VERBS))
    return verbs.select(
        "repo",
        normalize_path(F.col("key")).alias("path"),
        path_shape(F.col("key")).alias("shape"),
        F.upper("verb").alias("method"),
    ).distinct()
