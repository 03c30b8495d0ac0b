"""Inputs derived from the given tables by fixed rules, so that work grows with them.

The tables hold no source code, registries or history; these adapters build them
with string functions, and every row of the base table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..sources import history as history_source


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; a scan of fewer splits than cores is spread over the cores.

    The small test tables are single row groups, hence single tasks. A table of many
    splits is left alone, so nothing is shuffled at scale. The filter is true for every
    row, but as the optimiser moves nothing past it, the tests and texts that a query puts
    on top of the rows are worked out by the tasks they are spread over, not by the few
    that read the splits.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("region", "nation") or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores).filter(F.spark_partition_id() >= 0)


def fill(template: str | Column, **values: Column) -> Column:
    """``template`` with each ``%name%`` replaced by a column."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit(f"%{name}%"), value.cast("string"))
    return text


def pick(index: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


# --- paths -----------------------------------------------------------------------

DIRECTORIES = ["src", "tests", "lib/build", "node_modules/x", "SRC/Tests", "pkg/out/a", "testing"]
SUFFIXES = [".py", ".PY", ".java", ".js", ".tsx", ".mjs", ".go", ".cjs", "/tests"]


def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    """One path per part: excluded and kept directories, all suffixes."""
    part = table(spark, folder, "part")
    return part.select(
        F.lower("p_brand").alias("repo"),
        F.concat(
            pick(F.col("p_partkey") % 7, DIRECTORIES), F.lit("/f"),
            F.col("p_partkey").cast("string"), pick(F.col("p_size") % 9, SUFFIXES),
        ).alias("rel_path"),
    )


TREE_FOLDERS = ["src", "src/tests", "lib/core", "lib/build/x", ".git/hooks", "docs", "out"]
TREE_SUFFIXES = [".py", ".java", ".TS", ".md", ".js"]


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``(rel_path, content)``: a file per document, some in excluded folders or no sources."""
    docs = table(spark, folder, "documents")
    k = F.col("doc_id")
    path = F.concat(
        F.lower("source"), F.lit("/"), pick(k % 7, TREE_FOLDERS), F.lit("/d"), k.cast("string"),
        pick(k % 5, TREE_SUFFIXES),
    )
    return docs.select(path.alias("rel_path"), F.col("text").alias("content"))


def raw_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs as route paths in all the spellings that normalise."""
    pages = table(spark, folder, "pages")
    tail = F.regexp_replace(
        F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1), "/[0-9]+", "/%p%"
    )
    k = F.col("page_id")
    styled = F.replace(
        tail, F.lit("%p%"),
        pick(k % 5, ["{id}", "<int:id>", "<slug>", ":id", "{f:path}"]),
    )
    shaped = (
        F.when(k % 7 == 0, F.lit(""))
        .when(k % 7 == 1, F.concat(styled, F.lit("///")))
        .when(k % 7 == 2, F.substr(styled, F.lit(2)))
        .when(k % 7 == 3, F.lit("//"))
        .otherwise(styled)
    )
    return pages.select("page_id", shaped.alias("raw"))


# --- observed endpoints and registries --------------------------------------------

def observed_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """One endpoint row per line item; one repo holds a third of all rows."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    path = F.concat(
        F.lit("/v"), (F.col("l_quantity").cast("int") % 3).cast("string"),
        F.lit("/p"), (p % 150).cast("string"),
        pick(n % 3, ["/{key}", "/<int:item>", "/:id"]),
        F.when(p % 7 == 0, "/").otherwise(""),
    )
    return table(spark, folder, "lineitem").select(
        F.when(k % 3 == 0, "mono")
        .otherwise(F.concat(F.lit("svc-"), (F.col("l_suppkey") % 40).cast("string")))
        .alias("repo"),
        normalize_path(path).alias("path"),
        F.upper(pick(F.col("l_suppkey") % 4, ["get", "Post", "PUT", "delete"])).alias("method"),
        (p % 5 != 0).alias("auth_required"),
        F.lit(None).cast("string").alias("auth_info"),
        F.concat(F.lit("app\\m"), (k % 500).cast("string"), F.lit(".py")).alias("source_file"),
        (p % 90).cast("int").alias("line_number"),
        pick(n % 3, ["FastAPI", "Flask", "Spring Boot"]).alias("framework"),
        pick(n % 3, ["python", "python", "java"]).alias("language"),
        ((k + p) % 9 == 0).alias("is_new"),
        F.when((k + p) % 9 == 0, "modified").alias("change_type"),
        F.lit(None).cast("string").alias("commit"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("timestamp").alias("committed_at"),
    )


def openapi_specs(spark: SparkSession, folder: str) -> DataFrame:
    """One specification per repo, as JSON text, from the line items' versions and parts.

    ``svc-7`` has none, ``idle`` has no endpoints, ``broken`` is not JSON.
    """
    p, v = F.col("l_partkey") % 150, F.col("l_quantity").cast("int") % 3
    repo = F.when(F.col("l_orderkey") % 3 == 0, "mono").otherwise(
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 40).cast("string"))
    )
    keys = (
        table(spark, folder, "lineitem")
        .select(repo.alias("repo"), p.alias("p"), v.alias("v"))
        .filter(((F.col("p") + F.col("v")) % 3 != 0) & (F.col("repo") != "svc-7"))
        .distinct()
    )
    item = fill(
        '"/v%v%/p%p%/{key}/": %body%', v=F.col("v"), p=F.col("p"),
        body=F.when(F.col("p") % 11 == 0, F.lit('"todo"'))
        .when(F.col("p") % 2 == 0, F.lit('{"get": {}, "POST": {}, "parameters": [1]}'))
        .otherwise(F.lit('{"get": {"tags": ["a"]}, "Delete": {}, "trace": {}}')),
    )
    # At most 450 paths per repo by construction.
    bodies = keys.groupBy("repo").agg(F.array_sort(F.collect_list(item)).alias("items"))
    specs = bodies.select(
        "repo",
        F.concat(
            F.lit('{"openapi": "3.0.0", "paths": {'), F.array_join("items", ", "), F.lit("}}")
        ).alias("spec_json"),
    )
    regions = table(spark, folder, "region")
    extra = regions.filter(F.col("r_regionkey") < 2).select(
        pick(F.col("r_regionkey"), ["idle", "broken"]).alias("repo"),
        pick(
            F.col("r_regionkey"), ['{"paths": {"/ping": {"head": {}}}}', "{not json"]
        ).alias("spec_json"),
    )
    return specs.unionByName(extra)


# --- Python sources ---------------------------------------------------------------

# Three shapes of module, dealt by the part's key, in a watering service of own making.
PYTHON_VALVES = '''"Valves of section %k%."
from fastapi import APIRouter
from ..shared import Ledger, Warden

bed%v% = APIRouter(tags=["water"], prefix="/%kind%")


@bed%v%.post(
    "/valves/{valve}/flow",
    status_code=202,
)
async def set_flow_%k%(valve: int%param%, litres: float = 1.5):
    return {"valve": valve, "litres": litres}


@bed%v%.delete("/valves/{valve}"%deps%)
def close_%k%(valve: int):
    return None
'''
PYTHON_ROTA = '''from fastapi import APIRouter

# Watering hours.
PERIODS = ["dawn", "dusk"]
bed%v% = APIRouter(prefix="/%kind%")

@bed%v%.api_route(path="/rota/", methods=["get", "Head"]%deps%)
def rota_%k%(period: str = PERIODS[0], *, dry: bool = True%named%):
    return period

@bed%v%.get("/rota/{day}/")
@audited
def day_%k%(day, /, by: Ledger = None):
    return day
'''
PYTHON_PLOTS = '''from flask import Blueprint
from .locks import %guard%

plots = Blueprint("plots", __name__, url_prefix="/%kind%")


@plots.route("/plot/<int:row>/soil", methods=("GET", "PATCH"))
@%guard%
def soil_%k%(row):
    return row


@plots.get("/plot")
def listing_%k%():
    return []
'''
PYTHON_SITE = '''import os
from typing import Annotated

from fastapi import Depends, FastAPI

site = FastAPI(title=os.environ["GARDEN"])
Ledger = Annotated[dict, Depends(open_ledger)]
Warden = Annotated[dict, Depends(authenticated_warden)]
site.include_router(bed2, tags=["plain"])
site.include_router(bed1, prefix="/south")
site.include_router(bed0, prefix="/north")
'''
PYTHON_LATER = '''from service import site
site.register_blueprint(plots, url_prefix="/estate")
site.include_router(bed1, prefix="/south-wing")
'''
PARAMS = [", by=Security(verify_badge)", ", book=Depends(open_ledger)", ", by: Warden", ""]
NAMED = [", who=Depends(get_principal)", "", "", ""]
DEPENDENCIES = [
    "", ", dependencies=[Depends(badge_token)]", ", dependencies=[Depends(open_ledger)]",
]
GUARDS = ["login_required", "timed"]


def python_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A module per part; every 97th does not parse, every 11th lies under tests/."""
    k, size = F.col("p_partkey"), F.col("p_size")
    shape = fill(
        pick(k % 3, [PYTHON_VALVES, PYTHON_ROTA, PYTHON_PLOTS]),
        v=k % 5, kind=F.lower("p_type"), k=k, param=pick(size % 4, PARAMS),
        named=pick(size % 4, NAMED), deps=pick(size % 3, DEPENDENCIES),
        guard=pick(size % 2, GUARDS),
    )
    return table(spark, folder, "part").select(
        F.lower("p_brand").alias("repo"),
        F.concat(
            F.when(k % 11 == 10, "tests/").otherwise("api/"), F.lit("part_"),
            k.cast("string"), F.lit(".py"),
        ).alias("rel_path"),
        F.when(k % 97 == 96, F.concat(shape, F.lit("\ndef broken(:\n"))).otherwise(shape)
        .alias("content"),
    )


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    repos = table(spark, folder, "part").select(F.lower("p_brand").alias("repo")).distinct()
    mains = repos.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit("service.py").alias("rel_path"), F.lit(PYTHON_SITE).alias("content")),
                F.struct(F.lit("zz.py").alias("rel_path"), F.lit(PYTHON_LATER).alias("content")),
            )
        ).alias("f"),
    ).select("repo", "f.*")
    return python_parts(spark, folder).unionByName(mains)


# --- Java sources -----------------------------------------------------------------

# Two shapes of controller, dealt by the supplier's key: a ferry's berths and its slips.
JAVA_BERTHS = '''package net.tides.ferry;

import org.springframework.web.bind.annotation.*;

%typeguard%@RequestMapping("/%nation%")
@RestController
class Crossing%k% {

    private final Board board = new Board();

    @Secured({"PILOT"%tail%})
    @PutMapping(
            consumes = "application/json",
            path = "/c%k%/{berth}/gate")
    Gate shift(@PathVariable String berth, @RequestBody Gate wanted) {
        return board.shift(berth, wanted);
    }

    @DeleteMapping
    void drop() {
        board.clear();
    }

    @RequestMapping(method = {RequestMethod.GET, RequestMethod.OPTIONS}, path = "/c%k%/slots/")
%note%    @PostAuthorize("returnObject.open")
    Slots slots() {
        return board.slots();
    }
}
'''
JAVA_SLIPS = '''package net.tides.quay;

@RestController
public class Quay%k% {

    @Deprecated
    @GetMapping("/%nation%/q%k%")
    @PreAuthorize("hasAuthority('QUAY')")
    public List<Slip> slips() { return List.of(); }

    @PatchMapping(value = "/%nation%/q%k%/{slip}", name = "/unused")

    @RolesAllowed("late")
    public Slip mend(@PathVariable int slip) {
        return null;
    }
}

enum Tide { LOW, HIGH }
'''


def java_files(spark: SparkSession, folder: str) -> DataFrame:
    """A controller per supplier: type-level guards, multi-line and cut-off annotation runs."""
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    k = F.col("s_suppkey")
    shape = fill(
        pick(k % 2, [JAVA_BERTHS, JAVA_SLIPS]), k=k, nation=F.lower("n_name"),
        typeguard=F.when(k % 5 == 0, '@RolesAllowed("CREW")\n').otherwise(""),
        tail=F.when(k % 6 == 2, ', "DECK(2"').otherwise(""),
        note=F.when(k % 4 == 0, "    // moved\n").otherwise(""),
    )
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("java-"), (k % 7).cast("string")).alias("repo"),
        F.concat(F.lit("src/C"), k.cast("string"), F.lit(".java")).alias("rel_path"),
        shape.alias("content"),
    )


# --- JavaScript sources -----------------------------------------------------------

# Three shapes of route file, dealt by the customer's key, in a pottery of own making.
JS_HEAT = '''import { Router } from "express";

export const shelf%m% = Router();

shelf%m%.put("/k%k%/:kiln/heat", %guard%async (req, res) => {
  await res.send(`${req.params.kiln}`);
});

shelf%m%.route("/k%k%/glazes")
  .get(listGlazes)
  .delete(ensureLoggedIn, dropGlaze);
'''
JS_CLAY = '''"use strict";
const shelf%m% = require("express").Router();
shelf%m%.all("/k%k%/ash", limit({ max: 3, skip: (r) => r.ip === "::1" }), sweep);
shelf%m%.route("/k%k%/clay/:lot").patch(wedge(1, "a, b)"), protectLot(), weigh).post(weigh);
'''
JS_FIRE = '''const shelf%m% = express.Router();
kiln.%verb%(`/k%k%/any`, handler.authorise);
shelf%m%.post("/k%k%/fire",
  passport.authenticate("bearer"),
  (req, res) => res.sendStatus(204));
'''
JS_KILN = '''const kiln = express();
kiln.use(compress);
kiln.use("/attic", stamp(), shelf2);
kiln.use("/loft", verifyPass, shelf1);
kiln.use("/yard", shelf0);
kiln.use("/cellar", shelf3);
'''
JS_LATER = 'kiln.use("/cellar/new", cors, shelf3);\n'
JS_GUARDS = ["", "requireLogin, ", "jwtCheck({ aud: 'kiln' }), "]
JS_VERBS = ["options", "get", "delete", "patch"]


def js_customers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    shape = fill(
        pick(k % 3, [JS_HEAT, JS_CLAY, JS_FIRE]), k=k, m=F.floor(k / 3) % 6,
        guard=pick(F.floor(k / 3) % 3, JS_GUARDS), verb=pick(k % 4, JS_VERBS),
    )
    return table(spark, folder, "customer").select(
        F.lower("c_mktsegment").alias("repo"),
        F.concat(F.lit("routes/c"), k.cast("string"), F.lit(".js")).alias("rel_path"),
        shape.alias("content"),
    )


def js_files(spark: SparkSession, folder: str) -> DataFrame:
    repos = (
        table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("repo")).distinct()
    )
    apps = repos.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit("kiln.js").alias("rel_path"), F.lit(JS_KILN).alias("content")),
                F.struct(F.lit("z/more.js").alias("rel_path"), F.lit(JS_LATER).alias("content")),
            )
        ).alias("f"),
    ).select("repo", "f.*")
    return js_customers(spark, folder).unionByName(apps)


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        python_files(spark, folder)
        .unionByName(java_files(spark, folder))
        .unionByName(js_files(spark, folder))
    )


# --- runtime inventories ----------------------------------------------------------

def runtime_dumps(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """A dump with two routes per event, with the columns ``keys`` of the event."""
    k = F.col("event_id")
    dump = fill(
        '{"routes": [{"path": "/%t%/{id}/", "method": "post", "middleware": ["helmet", %mw%"%t%"]},'
        ' {"path": null, "middleware": null}]}',
        t=F.col("event_type"), mw=F.when(k % 3 == 0, '"requireAuth", ').otherwise(""),
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("rt-"), (F.col("user_id") % 10).cast("string")).alias("repo"),
        F.concat(F.lit("srv/app"), (k % 4).cast("string"), F.lit(".js")).alias("entry"),
        dump.alias("dump_json"),
        *keys,
    )


def router_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Router stacks: per nation a router inside its region's router, routes per supplier.

    Every app is a region; ``use`` layers stand before, between and after the routes. Two
    more apps hold all line items as routes of one level, with guards between the orders,
    and all suppliers as routers, each inside that of a third of its key.
    """
    text, names = "string", "array<string>"
    none = F.lit(None)
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")

    def layer(layer_id, parent_id, pos, kind, path=none, source=none, methods=none, name=none, handlers=none):
        return [
            layer_id.cast("bigint").alias("layer_id"), parent_id.cast("bigint").alias("parent_id"),
            pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), path.cast(text).alias("path"),
            source.cast(text).alias("regexp_source"),
            (F.lit(False) if source is not none else none.cast("boolean")).alias("fast_slash"),
            methods.cast(names).alias("methods"), name.cast(text).alias("name"),
            handlers.cast(names).alias("handlers"),
        ]

    app = F.concat(F.lit("app"), F.col("n_regionkey").cast(text)).alias("app")
    r_app = F.concat(F.lit("app"), F.col("r_regionkey").cast(text)).alias("app")
    rid = F.col("r_regionkey") * 1000
    nid = 10000 + F.col("n_nationkey") * 1000
    sid = 1000000 + F.col("s_suppkey")
    seated = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    top = [
        region.select(r_app, *layer(rid + 1, none, F.lit(0), "use", name=F.lit("helmet"))),
        region.select(r_app, *layer(rid + 2, none, F.lit(1), "use", name=F.lit("jsonParser"))),
        region.select(
            r_app,
            *layer(
                rid + 3, none, F.lit(2), "route", path=F.lit("/health/"),
                methods=F.array(F.lit("get"), F.lit("head")), handlers=F.array(F.lit("<anonymous>")),
            ),
        ),
        region.select(
            r_app,
            *layer(
                rid, none, F.lit(3), "router",
                source=F.concat(F.lit(r"^\/r"), F.col("r_regionkey").cast(text), F.lit(r"\/?(?=\/|$)")),
            ),
        ),
    ]
    nations = [
        nation.select(app, *layer(nid + 1, F.col("n_regionkey") * 1000, F.col("n_nationkey") * 2, "use",
                                  name=F.concat(F.lit("mw"), F.col("n_nationkey").cast(text)))),
        nation.select(
            app,
            *layer(
                nid, F.col("n_regionkey") * 1000, F.col("n_nationkey") * 2 + 1, "router",
                source=F.concat(F.lit(r"^\/n"), F.col("n_nationkey").cast(text), F.lit(r"\/api\/?(?=\/|$)")),
            ),
        ),
    ]
    routes = seated.select(
        app,
        *layer(
            sid, nid, F.col("s_suppkey") * 2 + 1, "route",
            path=F.concat(F.lit("/s"), F.col("s_suppkey").cast(text)),
            methods=F.array(F.lit("get")),
            handlers=F.array(F.lit("requireAuth"), F.lit("helmet"), F.lit("handle")),
        ),
    )
    late = nation.select(
        app, *layer(nid + 2, nid, F.lit(50), "use", name=F.lit("audit"))
    )
    item, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    guard = F.col("o_orderkey") * 8
    s = F.col("s_suppkey")
    app_name = lambda name: F.lit(name).alias("app")
    wide = [
        item.select(
            app_name("wide"),
            *layer(line, none, line, "route", path=F.concat(F.lit("/w"), line.cast(text), F.lit("/")),
                   methods=F.array(F.lit("put")), handlers=F.array(F.lit("pack"))),
        ),
        order.filter(F.col("o_orderkey") % 50 == 7).select(
            app_name("wide"),
            *layer(guard, none, guard, "use",
                   name=F.concat(F.lit("guard"), (F.floor(F.col("o_orderkey") / 50) % 5).cast(text))),
        ),
    ]
    deep = [
        supplier.select(
            app_name("deep"),
            *layer(s * 4 + 1, F.when(s > 0, F.floor(s / 3) * 4 + 1), s * 2 + 1, "router",
                   source=F.concat(F.lit(r"^\/d"), s.cast(text), F.lit(r"\/?(?=\/|$)"))),
        ),
        supplier.select(
            app_name("deep"),
            *layer(s * 4 + 2, s * 4 + 1, F.lit(0), "use", name=F.concat(F.lit("m"), (s % 7).cast(text))),
        ),
        supplier.select(
            app_name("deep"),
            *layer(s * 4 + 3, s * 4 + 1, F.lit(1), "route", path=F.lit("/leaf"),
                   methods=F.array(F.lit("post")), handlers=F.array(F.lit("requireAuth"), F.lit("m3"))),
        ),
    ]
    result = routes.unionByName(late)
    for frame in top + nations + wide + deep:
        result = result.unionByName(frame)
    return result


# --- history ----------------------------------------------------------------------

def _sha(key: Column) -> Column:
    digest = F.md5(key.cast("string").cast("binary"))
    return F.concat(digest, F.substring(digest, 1, 8))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Three histories of orders: a main line with merged and abandoned branches.

    Inside a repo the commits are numbered i. Every i with i % 4 = 3 starts from i - 1
    on a branch and is merged by i + 1, except those with i % 20 = 19.
    """
    k = F.col("o_orderkey")
    i = F.floor(k / 3)
    before = _sha(k - 3)
    parents = (
        F.when(i == 0, F.array().cast("array<string>"))
        .when((i % 4 == 0) & ((i - 1) % 20 == 19), F.array(_sha(k - 6)))
        .when(i % 4 == 0, F.array(_sha(k - 6), before))
        .otherwise(F.array(before))
    )
    time = F.unix_timestamp("o_orderdate")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("h"), (k % 3).cast("string")).alias("repo"),
        i.alias("i"),
        _sha(k).alias("sha"),
        parents.alias("parents"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("author"),
        time.alias("author_time"),
        time.alias("commit_time"),
    )


def refs(spark: SparkSession, folder: str) -> DataFrame:
    """HEAD, the last commit on the main line, and ``v1`` at six tenths of the way."""
    main = commits(spark, folder).filter(F.col("i") % 4 != 3)
    heads = main.groupBy("repo").agg(F.max("i").alias("head"))
    named = heads.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit("HEAD").alias("name"), F.col("head").alias("i")),
                F.struct(
                    F.lit("v1").alias("name"),
                    (F.floor(F.floor(F.col("head") * 6 / 10) / 4) * 4).alias("i"),
                ),
            )
        ).alias("r"),
    ).select("repo", "r.*")
    return named.join(main, ["repo", "i"]).select("repo", "name", "sha")


def _part_file(key: Column) -> Column:
    return F.concat(F.lit("svc/api/part_"), key.cast("string"), F.lit(".py"))


def _commit_of(order: Column, part: Column) -> Column:
    """The order at or just below in the repo of the part (orders are dealt by key mod 3)."""
    below = order - F.pmod(order - part, F.lit(3))
    return F.when(below < 1, below + 3).otherwise(below)


def blame_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a part's file belongs to the last order of the same repo for it."""
    p = F.col("l_partkey")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey", "l_linenumber")
        .agg(F.max(_commit_of(F.col("l_orderkey"), p)).alias("k"))
        .select(
            F.concat(F.lit("h"), (p % 3).cast("string")).alias("repo"),
            _part_file(p).alias("path"),
            F.col("l_linenumber").alias("line"),
            _sha(F.col("k")).alias("sha"),
        )
    )


# Each of a part's lines stands for a block of so many lines in the file whose blame is ranges.
BLOCK_LINES = 12


def blame_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """``(repo, path, first, last, sha)``: blocks as blame joins them, a row for a run of one commit."""
    runs = history_source.blame_ranges(blame_lines(spark, folder))
    return runs.select(
        "repo", "path", ((F.col("first") - 1) * BLOCK_LINES + 1).cast("int").alias("first"),
        (F.col("last") * BLOCK_LINES).cast("int").alias("last"), "sha",
    )


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of a part adds its file, later ones modify it."""
    p = F.col("l_partkey")
    touched = (
        table(spark, folder, "lineitem")
        .select("l_partkey", _commit_of(F.col("l_orderkey"), p).alias("l_orderkey"))
        .distinct()
    )
    first = touched.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first"))
    return touched.join(first, "l_partkey").select(
        F.concat(F.lit("h"), (p % 3).cast("string")).alias("repo"),
        _sha(F.col("l_orderkey")).alias("sha"),
        _part_file(p).alias("path"),
        F.when(F.col("l_orderkey") == F.col("first"), "A").otherwise("M").alias("change"),
    )


def ref_files(spark: SparkSession, folder: str) -> DataFrame:
    """File lists: all parts at HEAD, those with p_size <= 30 already at ``v1``."""
    part = table(spark, folder, "part")
    at = F.when(F.col("p_size") <= 30, F.array(F.lit("HEAD"), F.lit("v1"))).otherwise(
        F.array(F.lit("HEAD"))
    )
    return part.select(
        F.concat(F.lit("h"), (F.col("p_partkey") % 3).cast("string")).alias("repo"),
        F.explode(at).alias("ref"),
        _part_file(F.col("p_partkey")).alias("path"),
    )


# What became of a file between ``v1`` and HEAD, by the part's key: it stayed, moved as it
# was, moved with two lines changed, made way for another text elsewhere, is one of many
# equal files that moved to new folders under one name, or came anew.
FATES = ["stayed", "stayed", "moved", "edited", "replaced", "stub", "new", "stub", "moved", "newstub"]


def _fate(key: Column) -> Column:
    return pick(key % 10, FATES)


def moving_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(repo, ref, path, blob, lines)``: all parts' files at ``v1`` and at HEAD."""
    k = F.col("p_partkey")
    key = k.cast("string")
    fate = _fate(k)
    at = F.explode(
        F.when(fate.isin("new", "newstub"), F.array(F.lit("HEAD")))
        .otherwise(F.array(F.lit("v1"), F.lit("HEAD")))
    )
    head = F.col("ref") == "HEAD"
    place = F.when(
        fate.isin("stub", "newstub"), F.concat(F.when(head, "z").otherwise("a"), key, F.lit("/index.py"))
    ).otherwise(
        F.concat(
            F.when(head & (fate != "stayed"), "svc/").otherwise("app/"),
            F.when(head & (fate == "edited"), "v2_").otherwise("part_"), key, F.lit(".py"),
        )
    )
    own = [
        F.concat(F.lit(f"{word} = "), key, F.lit(" "), F.col(column).cast("string"))
        for word, column in (("name", "p_name"), ("kind", "p_type"), ("size", "p_size"), ("brand", "p_brand"),
                             ("price", "p_retailprice"), ("label", "p_name"))
    ]
    changed = [
        F.when(head & (fate == "replaced") & F.lit(n < 5) | head & (fate == "edited") & F.lit(n < 2),
               F.concat(F.lit("# new "), line)).otherwise(line)
        for n, line in enumerate(own)
    ]
    body = F.when(fate.isin("stub", "newstub"), F.array(F.lit("# index"))).otherwise(
        F.array(F.lit("import os"), *changed, F.lit("os.sync()"))
    )
    rows = table(spark, folder, "part").select("*", at.alias("ref"))
    return rows.select(
        F.concat(F.lit("h"), (k % 3).cast("string")).alias("repo"), "ref", place.alias("path"),
        F.sha1(F.array_join(body, "\n").cast("binary")).alias("blob"), body.alias("lines"),
    )


def blobs(files: DataFrame) -> DataFrame:
    """``(repo, blob, lines)``: each content once, its lines as hashes."""
    hashes = F.transform("lines", lambda line: F.xxhash64(line))
    return files.groupBy("repo", "blob").agg(F.first("lines").alias("lines")).select(
        "repo", "blob", hashes.alias("lines")
    )


def history_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Seven endpoints per part, one per block of lines, plus a runtime row at line 0."""
    k, n = F.col("p_partkey"), F.col("n")
    within = (n - 1) * BLOCK_LINES + 1 + F.pmod(k + n, F.lit(BLOCK_LINES))
    return table(spark, folder, "part").select(
        F.concat(F.lit("h"), (k % 3).cast("string")).alias("repo"),
        F.concat(F.lit("api/part_"), k.cast("string"), F.lit(".py")).alias("source_file"),
        k.alias("p_partkey"),
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n"),
    ).select(
        "repo",
        F.concat(F.lit("/x/"), n.cast("string")).alias("path"),
        F.lit("GET").alias("method"),
        (n % 2 == 0).alias("auth_required"),
        "source_file",
        F.when(n == 0, 0).otherwise(within).cast("int").alias("line_number"),
        F.lit("FastAPI").alias("framework"),
    )


def history(spark: SparkSession, folder: str) -> dict:
    return {
        "commits": commits(spark, folder),
        "refs": refs(spark, folder),
        "blame": blame_ranges(spark, folder),
        "file_changes": file_changes(spark, folder),
        "ref_files": ref_files(spark, folder),
    }


def blame_text(spark: SparkSession, folder: str) -> DataFrame:
    """Porcelain text per part file; author facts stand at a sha's first line only."""
    joined = blame_lines(spark, folder).join(
        commits(spark, folder).select("repo", "sha", "author", "author_time"), ["repo", "sha"]
    )
    firsts = joined.groupBy("repo", "path", "sha").agg(F.min("line").alias("first_line"))
    rows = joined.join(firsts, ["repo", "path", "sha"])
    is_first = F.col("line") == F.col("first_line")
    line = F.col("line").cast("string")
    header = F.concat_ws(" ", "sha", F.lit("1"), line)
    facts = F.array(
        header,
        F.when(is_first, F.concat(F.lit("author "), "author")),
        F.when(is_first, F.concat(F.lit("author-time "), F.col("author_time").cast("string"))),
        F.when(is_first, F.lit("summary edit")),
        F.concat(F.lit("\tcode line "), line),
    )
    return rows.select(
        "repo", "path", F.col("line"), F.posexplode(F.filter(facts, lambda f: f.isNotNull())).alias("n", "raw")
    ).select("repo", "path", (F.col("line") * 10 + F.col("n")).alias("pos"), "raw")


# --- texts ------------------------------------------------------------------------

SECRET_TAIL = ' api_key = "k-%id%-secret" '
JWT_TAIL = " eyJh%id%.eyJz%id%.sig_%id%! "
ECHO_TAIL = " My_Secret_%id%: 'Secret_%id%' ops+%id%@acme.example "


def leaky(text: Column, key: Column) -> Column:
    """The whole text with a planted token, assignment, echoing assignment or nothing."""
    return (
        F.when(key % 4 == 0, F.concat(text, fill(SECRET_TAIL, id=key)))
        .when(key % 4 == 1, F.concat(text, fill(JWT_TAIL, id=key)))
        .when(key % 4 == 2, F.concat(text, fill(ECHO_TAIL, id=key)))
        .otherwise(text)
    )
