"""Runtime route inventories and live router stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import join_router_path, mount_prefix, normalize_path
from ..operators.joins import lookup, stage
from .config import with_rules

# Internal middleware names that say nothing about the application.
NOISE_NAMES = [
    "<anonymous>", "bound dispatch", "expressInit", "query",
    "serveStatic", "jsonParser", "urlencodedParser", "router", "handle",
]

DUMP_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("entry", T.StringType()),
        T.StructField(
            "routes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("method", T.StringType()),
                        T.StructField("middleware", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def _reason() -> Column:
    error = F.get_json_object("dump_json", "$.error")
    return F.when(F.try_parse_json("dump_json").isNull(), "not JSON").when(
        error != "", F.concat(F.lit("error: "), error)
    )


def invalid_dumps(dumps: DataFrame) -> DataFrame:
    """Dumps that cannot stand for a runtime inventory: ``(repo, entry, reason)``.

    Their repositories keep their static rows, so look at these before relying on them.
    """
    return dumps.select("repo", "entry", _reason().alias("reason")).filter("reason IS NOT NULL")


def read_dumps(dumps: DataFrame) -> DataFrame:
    """``(repo, entry, dump_json)`` to ``(repo, entry, path, method, middleware)``.

    Dumps listed by ``invalid_dumps`` and dumps without routes give no rows.
    """
    parsed = dumps.filter(_reason().isNull()).select(
        "repo",
        "entry",
        F.explode(F.from_json("dump_json", DUMP_SCHEMA)["routes"]).alias("r"),
    )
    return parsed.select("repo", "entry", "r.path", "r.method", "r.middleware")


def runtime_endpoints(routes: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Endpoints of a runtime inventory; line 0 marks them as found at run time."""
    routes, rules = with_rules(routes, config, ["entry", "path", "method"])
    chain = F.coalesce("middleware", F.array().cast("array<string>"))
    guard = F.try_element_at(F.filter(chain, rules.middleware), F.lit(1))
    return routes.select(
        "repo",
        normalize_path(F.coalesce("path", F.lit("/"))).alias("path"),
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"),
        guard.isNotNull().alias("auth_required"),
        F.concat(
            F.lit("runtime middleware: "), guard,
            F.lit(" (chain: "), F.array_join(chain, ", "), F.lit(")"),
        ).alias("auth_info"),
        F.substring_index("entry", "/", -1).alias("source_file"),
        F.lit(0).alias("line_number"),
        F.lit("Express").alias("framework"),
        F.lit("javascript").alias("language"),
    )


def supersede(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Runtime rows replace every static JavaScript row of the same repo."""
    covered = runtime.select("repo").distinct()
    is_js = F.col("language") == "javascript"
    kept = lookup(
        static.filter(is_js), covered, ["repo"], "left_anti", spread=["source_file", "line_number"]
    )
    return static.filter(~is_js).unionByName(kept).unionByName(runtime)


def _clean(names: Column) -> Column:
    return F.filter(names, lambda n: (n != "") & ~n.isin(NOISE_NAMES))


def _levels(layers: DataFrame) -> DataFrame:
    """``(app, level, names, starts)``: middleware of each level, in order of first use.

    A name that was used before at its level changes nothing further down, so a level has
    an entry per distinct name, however many layers it holds.
    """
    firsts = (
        layers.filter((F.col("kind") == "use") & (F.col("name") != "") & ~F.col("name").isin(NOISE_NAMES))
        .groupBy("app", "level", "name").agg(F.min("pos").alias("pos"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return (
        firsts.groupBy("app", "level").agg(ordered.alias("u"))
        .select("app", "level", F.col("u.name").alias("names"), F.col("u.pos").alias("starts"))
    )


def _mount_chains(routers: DataFrame) -> DataFrame:
    """``(app, level, chain)`` per router: its mounts from the outermost, each as a pointer.

    Pointer doubling: after a round a router knows twice as many of its mounts, so the
    rounds are the logarithm of the nesting. Routers below no top level router go.
    """
    state = stage(
        routers.select(
            "app", F.col("layer_id").cast("string").alias("level"), F.col("level").alias("up"),
            F.array(F.struct("step", "inherits")).alias("chain"),
        ),
        "mounts",
    )
    rounds = state.count().bit_length() + 1
    while not state.filter("up <> ''").isEmpty():
        if rounds == 0:
            raise ValueError("a router layer is its own ancestor")
        rounds -= 1
        above = state.select(
            "app", F.col("level").alias("up"), F.col("up").alias("further"), F.col("chain").alias("before")
        )
        known = lookup(state.filter("up <> ''"), above, ["app", "up"], "inner", spread=["level"])
        grown = known.select("app", "level", F.col("further").alias("up"), F.concat("before", "chain").alias("chain"))
        state = stage(state.filter("up = ''").unionByName(grown), "mounts")
    return state.drop("up")


def flatten_router(layers: DataFrame) -> DataFrame:
    """Router-stack layers to ``(app, path, method, middleware)``.

    ``layers`` holds ``(app, layer_id, parent_id, pos, kind, path, regexp_source,
    fast_slash, methods, name, handlers)`` with kind route, router or use. Middleware
    of a ``use`` layer applies to the later siblings and everything below them. A layer
    only learns how many of its level's names stand before it; the names themselves are
    joined once per router and once per route, so a level may hold any number of layers.
    """
    leveled = layers.withColumn("level", F.coalesce(F.col("parent_id").cast("string"), F.lit("")))
    names = stage(_levels(leveled), "levels")
    known = lookup(
        leveled.filter(F.col("kind").isin("route", "router")), names, ["app", "level"], spread=["layer_id"]
    )
    none = F.array().cast("array<string>")
    # The names that stand before a layer are a head of its level's list.
    before = F.size(F.filter(F.coalesce("starts", F.array().cast("array<int>")), lambda p: p < F.col("pos")))
    known = known.withColumn("inherits", F.slice(F.coalesce("names", none), F.lit(1), before))
    routers = known.filter("kind = 'router'").select(
        "app", "layer_id", "level", "inherits",
        mount_prefix(F.col("regexp_source"), F.col("fast_slash")).alias("step"),
    )
    chains = _mount_chains(routers).select(
        "app", "level",
        F.aggregate(
            "chain", F.lit(""), lambda path, mount: join_router_path(path, mount["step"])
        ).alias("prefix"),
        F.array_distinct(F.flatten(F.transform("chain", lambda mount: mount["inherits"]))).alias("inherited"),
    )
    routes = known.filter("kind = 'route'")
    below = lookup(routes.filter("level <> ''"), chains, ["app", "level"], "inner", spread=["layer_id"])
    top = routes.filter("level = ''").withColumn("prefix", F.lit("")).withColumn("inherited", none)
    return top.unionByName(below).select(
        "app",
        join_router_path(F.col("prefix"), F.col("path")).alias("path"),
        F.explode(F.transform("methods", F.upper)).alias("method"),
        F.array_distinct(
            F.concat("inherited", "inherits", _clean(F.coalesce("handlers", none)))
        ).alias("middleware"),
    )
