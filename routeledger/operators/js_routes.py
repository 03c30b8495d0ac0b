"""Express: mounts, direct routes and route chains over fluent logical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.auth import IDENTIFIER
from ..functions.brackets import JS_VERBS, chained_calls_udf, split_arguments_udf
from ..functions.paths import normalize_path
from ..functions.text import SPACE, join_present
from ..sources.config import with_rules
from .joins import lookup
from .logical_lines import logical_lines

# What ALL stands for.
ALL_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]

_NAME = r"[A-Za-z_$][\p{L}\p{N}_$]*"
_QUOTE = "['\"`]"
_MOUNT = rf"{_NAME}\.use{SPACE}*\({SPACE}*([^)]*)\)"
_CHAIN = rf"{_NAME}\.route{SPACE}*\({SPACE}*({_QUOTE})[^'\"`]*\1{SPACE}*\)"
_DIRECT = (
    rf"({_NAME})\.({JS_VERBS}){SPACE}*\({SPACE}*({_QUOTE})([^'\"`]*)\3{SPACE}*(,.*)?$"
)


def may_matter(content: Column) -> Column:
    """Files in which a verb, ``route`` or ``use`` call is given a literal (a superset)."""
    return content.rlike(rf"\.(?:{JS_VERBS}|route|use){SPACE}*\({SPACE}*{_QUOTE}")


def route_lines(files: DataFrame) -> DataFrame:
    """The logical lines that mount a router or declare a route (stage these)."""
    text = F.col("text")
    return (
        logical_lines(files.filter(may_matter(F.col("content"))), fluent=True)
        .withColumn("is_chain", text.rlike(_CHAIN))
        .filter(F.col("is_chain") | text.rlike(_DIRECT) | text.rlike(_MOUNT))
    )


def mount_facts(lines: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """``(repo, rel_path, line, ordinal, router_ident, prefix, has_auth)``."""
    calls = lines.filter(F.col("text").rlike(_MOUNT)).select(
        "repo",
        "rel_path",
        F.col("start_line").alias("line"),
        F.posexplode(F.regexp_extract_all("text", F.lit(_MOUNT), F.lit(1))).alias(
            "ordinal", "inner"
        ),
    )
    calls = calls.filter(F.col("inner").rlike(rf"^{_QUOTE}")).withColumn(
        "args", split_arguments_udf("inner")
    )
    calls, rules = with_rules(calls, config, ["rel_path", "line"])
    later = F.slice("args", 2, F.size("args"))
    names = F.filter(later, lambda a: a.rlike(IDENTIFIER))
    between = F.slice("args", 2, F.greatest(F.size("args") - 2, F.lit(0)))
    return calls.filter(F.size(names) > 0).select(
        "repo",
        "rel_path",
        "line",
        "ordinal",
        F.element_at(names, -1).alias("router_ident"),
        F.btrim(F.element_at("args", 1), F.lit("'\"`")).alias("prefix"),
        F.exists(between, rules.handler_argument).alias("has_auth"),
    )


def js_mounts(facts: DataFrame) -> DataFrame:
    """One row per router: the last prefix wins, authentication sticks."""
    return facts.groupBy("repo", "router_ident").agg(
        F.max_by("prefix", F.struct("rel_path", "line", "ordinal")).alias("prefix"),
        F.bool_or("has_auth").alias("has_auth"),
    )


def route_calls(lines: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Route declarations with their authentication arguments; a chain hides a direct one."""
    text = F.col("text")
    direct = F.struct(
        F.regexp_extract(text, _DIRECT, 1).alias("owner"),
        F.regexp_extract(text, _DIRECT, 2).alias("verb"),
        F.regexp_extract(text, _DIRECT, 4).alias("path"),
        F.ltrim(F.regexp_extract(text, _DIRECT, 5), F.lit(",")).alias("args"),
    )
    # The batches get null for every line that is not a chain.
    chained = chained_calls_udf(F.when(F.col("is_chain"), text))
    calls = (
        lines.filter(F.col("is_chain") | text.rlike(_DIRECT))
        .withColumn("chained", chained)
        .select(
            "repo",
            "rel_path",
            "start_line",
            F.posexplode(F.coalesce("chained", F.array(direct))).alias("ordinal", "c"),
        )
        .select("repo", "rel_path", "start_line", "ordinal", "c.*")
        .withColumn("arguments", split_arguments_udf("args"))
    )
    calls, rules = with_rules(calls, config, ["rel_path", "start_line"])
    return calls.select(
        "repo",
        "rel_path",
        "start_line",
        "ordinal",
        F.col("owner").alias("router_ident"),
        F.upper("verb").alias("verb"),
        F.col("path").alias("route_path"),
        F.filter("arguments", rules.handler_argument).alias("hits"),
    )


def resolve_calls(calls: DataFrame, mounts: DataFrame) -> DataFrame:
    """Join declarations to their mounts: prefix and mount-level authentication."""
    joined = lookup(
        calls, mounts, ["repo", "router_ident"], spread=["rel_path", "start_line"]
    )
    mounted = F.coalesce("has_auth", F.lit(False))
    inline = F.size("hits") > 0
    info = join_present(
        F.when(
            mounted,
            F.concat(F.lit("mount-level middleware on '"), "router_ident", F.lit("'")),
        ),
        F.when(inline, F.concat(F.lit("inline middleware: "), F.array_join("hits", ", "))),
    )
    methods = F.when(
        F.col("verb") == "ALL", F.array(*[F.lit(m) for m in ALL_METHODS])
    ).otherwise(F.array("verb"))
    return joined.select(
        "repo",
        normalize_path(F.concat(F.coalesce("prefix", F.lit("")), "route_path")).alias("path"),
        F.explode(methods).alias("method"),
        (mounted | inline).alias("auth_required"),
        info.alias("auth_info"),
        F.col("rel_path").alias("source_file"),
        F.col("start_line").cast("int").alias("line_number"),
        F.lit("Express").alias("framework"),
        F.lit("javascript").alias("language"),
    )


def js_endpoints(lines: DataFrame, config: DataFrame | None = None) -> DataFrame:
    return resolve_calls(
        route_calls(lines, config), js_mounts(mount_facts(lines, config))
    )
