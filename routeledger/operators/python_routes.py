"""FastAPI and Flask: rules and cross-file resolution over the syntax rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..functions.text import WORD, join_present
from ..sources.config import with_rules
from .joins import lookup

# Verbs and the further decorator names that make a route.
VERBS = ["get", "post", "put", "delete", "patch", "options", "head"]
ROUTE_NAMES = [*VERBS, "route", "api_route"]

# Order of the parts of a function's address inside the whole scan.
_FUNCTION = ["repo", "rel_path", "fn", "dec"]


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def mount_facts(syntax: DataFrame) -> DataFrame:
    """``(repo, rel_path, ordinal, router_var, prefix)`` of every constant mount prefix."""
    mounts = syntax.select("repo", "rel_path", F.posexplode("mounts").alias("ordinal", "m"))
    key = F.when(F.col("m.call") == "include_router", "prefix").otherwise("url_prefix")
    prefix = F.try_element_at(
        F.filter("m.constants", lambda c: c["name"] == key), F.lit(1)
    )
    return mounts.select(
        "repo",
        "rel_path",
        "ordinal",
        F.col("m.target").alias("router_var"),
        prefix["value"].alias("prefix"),
    ).filter(F.col("router_var").isNotNull() & F.col("prefix").isNotNull())


def include_prefixes(syntax: DataFrame) -> DataFrame:
    """One prefix per ``(repo, router_var)``; the last in ``(rel_path, ordinal)`` wins."""
    return (
        mount_facts(syntax)
        .groupBy("repo", "router_var")
        .agg(F.max_by("prefix", F.struct("rel_path", "ordinal")).alias("prefix"))
    )


def alias_names(syntax: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Distinct ``(repo, alias)``: names bound to an authentication dependency."""
    bound = syntax.select("repo", "rel_path", F.explode("assigns").alias("a")).filter(
        F.col("a.text").rlike("Depends|Security")
    )
    bound, rules = with_rules(bound, config, ["rel_path"])
    return (
        bound.filter(rules.expression(F.col("a.text")))
        .select("repo", F.col("a.target").alias("alias"))
        .distinct()
    )


def _is_route(d: Column) -> Column:
    return F.lower(d["attr"]).isin(ROUTE_NAMES) & d["path"].isNotNull()


def route_candidates(syntax: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Decorated functions that declare a route, with everything a file alone decides.

    ``exprs`` keeps the expressions to test against aliases, only where no
    authentication was found in the file itself.
    """
    functions = syntax.select(
        "repo",
        "rel_path",
        F.exists("modules", lambda m: m.contains("flask")).alias("has_flask"),
        F.exists("modules", lambda m: m.contains("fastapi")).alias("has_fastapi"),
        F.filter(
            "assigns",
            lambda a: a["callee"].endswith("APIRouter") | a["callee"].endswith("Blueprint"),
        ).alias("routers"),
        F.posexplode("functions").alias("fn", "f"),
    ).filter(F.exists("f.decorators", _is_route))
    functions, rules = with_rules(functions, config, ["rel_path", "fn"])

    decorators = F.col("f.decorators")
    own_exprs = F.filter("f.exprs", lambda e: e["text"] != "")
    first = F.try_element_at(
        F.filter(own_exprs, lambda e: rules.expression(e["text"])), F.lit(1)
    )
    guards = F.filter(
        F.transform(
            F.filter(decorators, lambda d: ~F.lower(d["attr"]).isin(ROUTE_NAMES)),
            lambda d: d["attr"],
        ),
        rules.keyword,
    )
    flask_caller = F.exists(
        F.filter(decorators, _is_route),
        lambda d: F.lower(d["caller"]).contains("bp")
        | F.lower(d["caller"]).contains("blueprint")
        | ((d["attr"] == "route") & ~F.col("has_fastapi")),
    )
    framework = F.when(
        (F.col("has_flask") & ~F.col("has_fastapi")) | F.coalesce(flask_caller, F.lit(False)),
        "Flask",
    ).otherwise("FastAPI")
    routes = functions.withColumns(
        {
            "sig": first,
            "guards": guards,
            "framework": framework,
            "own_texts": F.transform(own_exprs, lambda e: e["text"]),
        }
    ).select("*", F.posexplode(decorators).alias("dec", "d")).filter(_is_route(F.col("d")))

    dependencies = F.col("d.dependencies")
    routes = routes.withColumn("dec_auth", rules.expression(dependencies))
    dec_auth = F.col("dec_auth")
    local = F.col("sig").isNotNull() | dec_auth | (F.size("guards") > 0)
    info = join_present(
        F.concat(
            F.lit("Argument "), F.col("sig.param"), F.lit(" "), F.col("sig.slot"),
            F.lit(": "), F.col("sig.text"),
        ),
        F.when(dec_auth, F.concat(F.lit("Decorator dependencies: "), dependencies)),
        F.when(
            F.size("guards") > 0,
            F.concat(F.lit("Flask Decorators: "), F.array_join("guards", ", ")),
        ),
    )
    constructor = F.flatten(
        F.transform(
            F.filter("routers", lambda a: a["target"] == F.col("d.caller")),
            lambda a: F.filter(
                a["constants"], lambda c: c["name"].isin("prefix", "url_prefix")
            ),
        )
    )
    methods = (
        F.when(F.lower("d.attr").isin(VERBS), F.array(F.upper("d.attr")))
        .when(F.col("d.methods").isNotNull(), F.transform("d.methods", F.upper))
        .otherwise(F.array(F.lit("GET")))
    )
    texts = F.concat(
        F.col("own_texts"),
        F.when(dependencies != "", F.array(dependencies)).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return routes.select(
        *_FUNCTION,
        F.coalesce("d.caller", F.lit("")).alias("caller"),
        F.col("d.path").alias("raw_path"),
        methods.alias("methods"),
        F.col("f.line").alias("line_number"),
        "framework",
        F.coalesce(_last(constructor)["value"], F.lit("")).alias("local_prefix"),
        local.alias("auth_local"),
        info.alias("auth_info"),
        F.when(~local, texts).alias("exprs"),
    )


def alias_hits(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """First expression per candidate that names an alias, found by token equality.

    A whole-word search for every alias in every expression would be a nested loop;
    an identifier is found as a whole word exactly when it is one of the tokens.
    """
    tokens = (
        candidates.filter(F.size("exprs") > 0)
        .select(*_FUNCTION, F.posexplode("exprs").alias("ordinal", "expr"))
        .select(
            "*",
            F.explode(
                F.array_distinct(
                    F.regexp_extract_all("expr", F.lit(rf"({WORD}+)"), F.lit(1))
                )
            ).alias("alias"),
        )
    )
    matched = lookup(
        tokens, aliases, ["repo", "alias"], how="left_semi", spread=["rel_path", "fn"]
    )
    return matched.groupBy(*_FUNCTION).agg(F.min_by("expr", "ordinal").alias("alias_expr"))


def resolve_routes(
    candidates: DataFrame, prefixes: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Apply cross-file prefixes and aliases: candidates to endpoints."""
    named = prefixes.withColumnRenamed("router_var", "caller")
    prefixed = lookup(candidates, named, ["repo", "caller"], spread=["rel_path", "fn"])
    joined = prefixed.join(alias_hits(candidates, aliases), _FUNCTION, "left")
    by_alias = F.col("alias_expr").isNotNull()
    path = F.concat(F.coalesce("prefix", F.lit("")), "local_prefix", "raw_path")
    return joined.select(
        "repo",
        normalize_path(path).alias("path"),
        F.explode("methods").alias("method"),
        (F.col("auth_local") | by_alias).alias("auth_required"),
        F.when(by_alias, F.concat(F.lit("alias dependency: "), "alias_expr"))
        .otherwise(F.col("auth_info"))
        .alias("auth_info"),
        F.col("rel_path").alias("source_file"),
        "line_number",
        "framework",
        F.lit("python").alias("language"),
    )


def python_endpoints(syntax: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Endpoints of staged syntax rows (read three times, so stage them first)."""
    return resolve_routes(
        route_candidates(syntax, config),
        include_prefixes(syntax),
        alias_names(syntax, config),
    )
