"""Route path normalisation and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD


# Each step uses the one before it once: a path function is often applied to the
# result of another, and repeated references would multiply in the plan.
_UNROOTED = r"\A(?!/)"
_PARAMETER = rf"<(?:{WORD}+:)?({WORD}+)>|\{{({WORD}+)\}}"


def normalize_path(path: Column) -> Column:
    """Canonical path: leading slash, no trailing slash, parameters as ``:name``."""
    trimmed = F.rtrim(F.coalesce(path, F.lit("")), F.lit("/"))
    rooted = F.regexp_replace(trimmed, _UNROOTED, "/")
    return F.regexp_replace(rooted, _PARAMETER, ":$1$2")


def path_shape(path: Column) -> Column:
    """Path with every parameter name replaced by ``{}``."""
    return F.regexp_replace(normalize_path(path), rf":{WORD}+", ":{}")


def join_router_path(prefix: Column, path: Column) -> Column:
    """Join a mount prefix and a route path the way a live router does."""
    both = F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit("")))
    rooted = F.regexp_replace(F.regexp_replace(both, "/{2,}", "/"), _UNROOTED, "/")
    return F.regexp_replace(rooted, r"(?s)(?<=.)/\z", "")


def mount_prefix(regexp_source: Column, fast_slash: Column) -> Column:
    """Recover a mount prefix from the source text of a compiled path regexp."""
    bare = F.regexp_replace(F.regexp_replace(regexp_source, r"^\^", ""), r"\$\z", "")
    for tail in (r"\\/\?\(\?=\\/\|\$\)", r"\(\?=\\/\|\$\)", r"\\/\?\z"):
        bare = F.regexp_replace(bare, tail, "")
    plain = F.regexp_replace(bare, r"\\/", "/")
    return F.when(
        regexp_source.isNull() | F.coalesce(fast_slash, F.lit(False)), F.lit("")
    ).otherwise(plain)
