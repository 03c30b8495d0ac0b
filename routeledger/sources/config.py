"""Per-repo authentication word lists: replace or extend the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.auth import DEFAULT_LISTS, AuthRules
from ..operators.joins import lookup

_LISTS = [
    T.StructField(name, T.ArrayType(T.StringType()))
    for field in DEFAULT_LISTS
    for name in (field, "extend_" + field)
]
_CONFIG_JSON = T.StructType([T.StructField("auth", T.StructType(_LISTS)), *_LISTS])


def read_config_json(configs: DataFrame) -> DataFrame:
    """``(repo, config_json)`` to one row per repo with the ten optional lists.

    The lists stand under ``auth`` or, without that key, at the root.
    """
    parsed = configs.select("repo", F.from_json("config_json", _CONFIG_JSON).alias("c"))
    return parsed.select(
        "repo",
        *[
            F.when(F.col("c.auth").isNotNull(), F.col(f"c.auth.{f.name}"))
            .otherwise(F.col(f"c.{f.name}"))
            .alias(f.name)
            for f in _LISTS
        ],
    )


def _default(field: str):
    return F.array(*[F.lit(w) for w in DEFAULT_LISTS[field]])


def resolve_config(config: DataFrame) -> DataFrame:
    """The five lists in force per repo: a replacement wins over an extension."""
    present = set(config.columns)

    def column(name: str):
        return F.col(name) if name in present else F.lit(None).cast("array<string>")

    return config.select(
        "repo",
        *[
            F.coalesce(
                F.array_distinct(column(field)),
                F.array_union(
                    _default(field),
                    F.coalesce(column("extend_" + field), F.array().cast("array<string>")),
                ),
            ).alias(field)
            for field in DEFAULT_LISTS
        ],
    )


def with_rules(
    rows: DataFrame, config: DataFrame | None, spread: list[str]
) -> tuple[DataFrame, AuthRules]:
    """Attach each repo's lists to ``rows``; without a config the defaults are literals.

    ``config`` has one row per repo (see ``resolve_config``); a repo may own a third
    of ``rows``, hence the spread lookup.
    """
    if config is None:
        return rows, AuthRules.defaults()
    renamed = config.select(
        "repo", *[F.col(f).alias("cfg_" + f) for f in DEFAULT_LISTS]
    )
    joined = lookup(rows, renamed, ["repo"], spread=spread)
    filled = joined.withColumns(
        {"cfg_" + f: F.coalesce(F.col("cfg_" + f), _default(f)) for f in DEFAULT_LISTS}
    )
    return filled, AuthRules.from_columns()
