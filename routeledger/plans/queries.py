"""Named queries over the given tables; each one runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact
from ..functions.auth import AuthRules
from ..functions.paths import normalize_path, path_shape
from ..operators import (
    compare,
    java_routes,
    js_routes,
    provenance,
    python_routes,
    remedy,
    renames,
    report,
)
from ..operators.joins import shared_folder, stage
from ..operators.logical_lines import logical_lines
from ..sources import config, files, history, openapi, runtime, trees
from ..sources.sinks import append_documents, append_endpoints, read_documents, read_endpoints
from . import batch, corpus
from .scan import scan, scan_errors, staged_js_lines, staged_syntax

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_ENDPOINT = [
    "repo", "path", "method", "auth_required", "auth_info", "source_file", "line_number",
    "framework", "language",
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- sources ----------------------------------------------------------------------

@query
def scan_filter(spark, folder):
    return files.select_sources(corpus.file_paths(spark, folder)).select("repo", "rel_path")


@query
def tree_scan(spark, folder):
    """Whole documents written as a tree of files, then read back without excluded folders."""
    root = f"{shared_folder(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    trees.write_files(corpus.document_tree(spark, folder), root)
    found = files.read_tree(spark, root)
    return found.select(
        "repo", "rel_path", files.language_of(F.col("rel_path")).alias("language"),
        F.length("content").alias("n_chars"), F.md5("content").alias("digest"),
    )


@query
def scan_filter_override(spark, folder):
    chosen = files.select_sources(corpus.file_paths(spark, folder), ["src", "out"])
    return chosen.select("repo", "rel_path")


@query
def lang_dispatch(spark, folder):
    return (
        files.select_sources(corpus.file_paths(spark, folder))
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


@query
def parse_errors(spark, folder):
    return scan_errors(corpus.python_files(spark, folder)).select("repo", "rel_path", "reason")


@query
def registry(spark, folder):
    return openapi.registry(corpus.openapi_specs(spark, folder))


@query
def registry_invalid(spark, folder):
    return openapi.invalid_specs(corpus.openapi_specs(spark, folder))


def _brand_configs(spark, folder) -> DataFrame:
    """Configuration text per brand, by the brand's number."""
    brand = (
        corpus.table(spark, folder, "part")
        .select(F.lower("p_brand").alias("repo"))
        .distinct()
        .withColumn("n", F.regexp_extract("repo", "([0-9]+)", 1).cast("int"))
    )
    text = corpus.pick(
        F.col("n") % 5,
        [
            '{"auth": {"keywords": ["Gatekeeper", "cached"]}}',
            '{"extend_keywords": ["gatekeeper", "jwt"], "extend_spring_auth_annotations": ["Inner"]}',
            '{"auth": {"keywords": ["only"], "extend_keywords": ["never"]}, "keywords": ["outer"]}',
            '{"auth": {"express_auth_middleware": [], "extend_python_auth_dependency_hints": ["Tenant"]}}',
            "{}",
        ],
    )
    # Every tenth brand has no configuration at all.
    return brand.filter(F.col("n") % 10 != 9).select("repo", text.alias("config_json"))


def _resolved_config(spark, folder) -> DataFrame:
    return config.resolve_config(config.read_config_json(_brand_configs(spark, folder)))


@query
def auth_config(spark, folder):
    resolved = _resolved_config(spark, folder)
    fields = [f for f in resolved.columns if f != "repo"]
    return resolved.select(
        "repo",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        F.array_join(F.array_sort(f), ",").alias("words"),
                    )
                    for f in fields
                ]
            )
        ).alias("x"),
    ).select("repo", "x.*")


@query
def blame_parse(spark, folder):
    records = history.blame_records(corpus.blame_text(spark, folder))
    records = stage(records, "blame-records")
    authors = history.blame_authors(records)
    return history.blame_lines(records).join(authors, ["repo", "sha"], "left").select(
        "repo", "path", "line", history.short_sha(F.col("sha")).alias("commit"), "author",
        history.iso_utc(history.commit_time(F.col("author_time"))).alias("committed_at"),
    )


# --- column functions -------------------------------------------------------------

@query
def blame_ranges(spark, folder):
    """Porcelain text folded to runs of lines of one commit."""
    records = history.blame_records(corpus.blame_text(spark, folder))
    return history.blame_ranges(history.blame_lines(records))


@query
def normalized_paths(spark, folder):
    return corpus.raw_paths(spark, folder).select(
        "page_id", normalize_path(F.col("raw")).alias("path")
    )


@query
def path_shapes(spark, folder):
    return (
        corpus.raw_paths(spark, folder)
        .groupBy(path_shape(F.col("raw")).alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def normalized_rows(spark, folder):
    k = F.col("o_orderkey")
    rows = corpus.table(spark, folder, "orders").select(
        F.lit("r").alias("repo"),
        F.concat(F.lit("/o/"), k.cast("string")).alias("path"),
        corpus.pick(k % 3, ["get", "Post", "DELETE"]).alias("method"),
        corpus.pick(
            k % 8,
            [" FastAPI ", "flask", "SPRING", "springboot", "Spring Boot", "express", " Gin ", "  "],
        ).alias("framework"),
        F.when(k % 5 == 0, "kotlin").alias("language"),
        F.lit("f").alias("source_file"),
        F.lit(1).alias("line_number"),
    )
    kept, rejected = compare.split_rejects(rows)
    return kept.withColumn("rejected", F.lit(False)).unionByName(
        rejected.withColumn("rejected", F.lit(True))
    ).select("path", "method", "framework", "language", "auth_required", "is_new", "rejected")


def _named_parts(spark, folder, names: list[str]) -> DataFrame:
    part = corpus.table(spark, folder, "part")
    k = F.col("p_partkey")
    named = part.select(
        k.alias("p_partkey"),
        F.lower("p_brand").alias("repo"),
        F.replace(
            corpus.pick(k % len(names), names), F.lit("%n%"), F.replace("p_name", F.lit(" "), F.lit("_"))
        ).alias("name"),
    )
    return named


def _predicate(spark, folder, names: list[str], test: Callable[[AuthRules], Column]) -> DataFrame:
    rows, rules = config.with_rules(
        _named_parts(spark, folder, names), _resolved_config(spark, folder), ["p_partkey"]
    )
    return rows.select("p_partkey", "name", test(rules).alias("is_auth"))


@query
def auth_keyword(spark, folder):
    names = ["login_%n%", "get_%n%", "VerifyAll", "author_%n%", "Cached_%n%", "gatekeeper", "onlyOne", ""]
    return _predicate(spark, folder, names, lambda r: r.keyword(F.col("name")))


@query
def auth_dep(spark, folder):
    names = [
        "Depends(get_db)", "Depends( get_current_user )", "Security(oauth2.%n%)", "MyDepends(login)",
        "Annotated[str, Depends(db), Depends(tenant_of)]", "Body(token)", "[Depends(only_%n%)]",
    ]
    return _predicate(spark, folder, names, lambda r: r.expression(F.col("name")))


@query
def auth_spring(spark, folder):
    names = ["PreAuthorize", "GetMapping", "MyRolesAllowed", "securedBy", "InnerOnly", "Login"]
    return _predicate(spark, folder, names, lambda r: r.annotation(F.col("name")))


@query
def auth_express(spark, folder):
    names = ["requireAuth", "cors", "passportInit", "protectRoute", "cachedView", "helmet", "jwtCheck"]
    return _predicate(spark, folder, names, lambda r: r.middleware(F.col("name")))


@query
def auth_argument(spark, folder):
    names = [
        "requireAuth", "authController.list", "auth('x', y)", "passport.authenticate('jwt')",
        "a.b.c(d)", "(req, res) => auth(req)", "function authHandler(a)", "%n%", "ctrl.login(x)",
    ]
    return _predicate(spark, folder, names, lambda r: r.handler_argument(F.col("name")))


# --- extraction -------------------------------------------------------------------

def _sources(frame: DataFrame) -> DataFrame:
    return files.select_sources(frame)


def _syntax(spark, folder) -> DataFrame:
    return staged_syntax(_sources(corpus.python_files(spark, folder)))


@query
def py_prefix(spark, folder):
    return python_routes.include_prefixes(_syntax(spark, folder))


@query
def py_auth(spark, folder):
    return python_routes.route_candidates(_syntax(spark, folder)).select(
        "repo", "rel_path", "line_number", "caller", "raw_path", "local_prefix", "framework",
        F.array_join("methods", ",").alias("methods"), "auth_local", "auth_info",
    )


@query
def alias_auth(spark, folder):
    syntax = _syntax(spark, folder)
    candidates = python_routes.route_candidates(syntax)
    hits = python_routes.alias_hits(candidates, python_routes.alias_names(syntax))
    return hits.groupBy("repo", "alias_expr").agg(F.count(F.lit(1)).alias("n_routes"))


@query
def py_endpoints(spark, folder):
    return python_routes.python_endpoints(_syntax(spark, folder)).select(*_ENDPOINT)


def _texts(spark, folder) -> DataFrame:
    """Whole documents with brackets and leading dots made frequent by substitution."""
    text = F.replace(F.translate("text", "xqkw", "()()"), F.lit("\nT"), F.lit("\n .T"))
    text = F.replace(text, F.lit("\nL"), F.lit("\n\t.L"))
    return corpus.table(spark, folder, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("rel_path"),
        text.alias("content"),
    )


@query
def logical_lines_plain(spark, folder):
    return logical_lines(_texts(spark, folder)).withColumnRenamed("rel_path", "doc")


@query
def logical_lines_fluent(spark, folder):
    return logical_lines(_texts(spark, folder), fluent=True).withColumnRenamed("rel_path", "doc")


@query
def java_endpoints(spark, folder):
    return java_routes.java_endpoints(_sources(corpus.java_files(spark, folder))).select(*_ENDPOINT)


def _js_lines(spark, folder) -> DataFrame:
    return staged_js_lines(_sources(corpus.js_files(spark, folder)))


@query
def js_mounts(spark, folder):
    return js_routes.js_mounts(js_routes.mount_facts(_js_lines(spark, folder)))


@query
def js_endpoints(spark, folder):
    return js_routes.js_endpoints(_js_lines(spark, folder)).select(*_ENDPOINT)


@query
def auth_info(spark, folder):
    """The authentication texts in use, over all languages."""
    return (
        scan(corpus.all_files(spark, folder))
        .groupBy("language", "framework", "auth_required", "auth_info")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def endpoints_all(spark, folder):
    return scan(corpus.all_files(spark, folder)).select(*_ENDPOINT)


@query
def endpoints_configured(spark, folder):
    """Python endpoints under word lists that repos extend, replace or leave as they are."""
    brand = corpus.table(spark, folder, "part").select(F.lower("p_brand").alias("repo")).distinct()
    n = F.regexp_extract("repo", "([0-9]+)", 1).cast("int") % 3
    texts = brand.filter(n < 2).select(
        "repo",
        corpus.pick(n, ['{"extend_keywords": ["timed"]}', '{"auth": {"keywords": ["ledger"]}}'])
        .alias("config_json"),
    )
    lists = stage(config.resolve_config(config.read_config_json(texts)), "lists")
    return scan(corpus.python_files(spark, folder), lists).select(*_ENDPOINT)


# --- runtime ----------------------------------------------------------------------

@query
def endpoints_runtime(spark, folder):
    """A scan of all files with inventories that replace two repos' JavaScript rows."""
    number = F.replace("repo", F.lit("rt-"), F.lit("")).cast("int")
    dumps = corpus.runtime_dumps(spark, folder).withColumn(
        "repo", corpus.pick(number % 2, ["building", "furniture"])
    )
    return scan(corpus.all_files(spark, folder), runtime=runtime.read_dumps(dumps)).select(*_ENDPOINT)


@query
def runtime_routes(spark, folder):
    return runtime.runtime_endpoints(
        runtime.read_dumps(corpus.runtime_dumps(spark, folder))
    ).select(*_ENDPOINT)


@query
def runtime_invalid(spark, folder):
    """Cut-off dumps and those of failed runs, among sound ones and ones without routes."""
    k = F.col("event_id") % 5
    dumps = corpus.runtime_dumps(spark, folder, "event_id").withColumn(
        "dump_json",
        F.when(k == 1, F.substring("dump_json", 1, 30)).when(k == 2, F.lit('{"error": "no module"}'))
        .when(k == 3, F.lit('{"entry": "main"}')).otherwise(F.col("dump_json")),
    )
    return runtime.invalid_dumps(dumps)


@query
def runtime_supersede(spark, folder):
    """JavaScript repos of even segments get an inventory, which replaces their static rows."""
    observed = corpus.observed_endpoints(spark, folder).withColumn(
        "language", F.when(F.col("line_number") % 2 == 0, "javascript").otherwise(F.col("language"))
    )
    inventory = runtime.runtime_endpoints(
        runtime.read_dumps(corpus.runtime_dumps(spark, folder))
        .withColumn("repo", F.replace("repo", F.lit("rt-"), F.lit("svc-")))
    )
    return (
        runtime.supersede(observed.select(*inventory.columns), inventory)
        .groupBy("repo", "language", (F.col("line_number") == 0).alias("at_runtime"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("auth_required").alias("n_auth"))
    )


@query
def router_flatten(spark, folder):
    return runtime.flatten_router(corpus.router_layers(spark, folder)).select(
        "app", "path", "method", F.array_join("middleware", ",").alias("middleware")
    )


# --- comparison -------------------------------------------------------------------

def _observed(spark, folder) -> tuple[DataFrame, DataFrame]:
    return (
        corpus.observed_endpoints(spark, folder),
        openapi.registry(corpus.openapi_specs(spark, folder)),
    )


def _matches(spark, folder) -> DataFrame:
    return compare.match(*_observed(spark, folder))


@query
def match_exact(spark, folder):
    """Distinct keys whose spelling is registered as it stands."""
    endpoints, known = _observed(spark, folder)
    keys = endpoints.select("repo", "path", "method").distinct()
    return keys.join(known.select("repo", "path", "method"), ["repo", "path", "method"], "left_semi")


@query
def match_shape(spark, folder):
    endpoints, known = _observed(spark, folder)
    keys = endpoints.select(
        "repo", "path", "method", F.col("path").alias("source_file"), F.lit(0).alias("line_number")
    ).distinct()
    return compare.with_registered(keys, known).select("repo", "path", "method", "registered")


@query
def match_status(spark, folder):
    return _matches(spark, folder).select(
        "repo", "path", "method", "source_file", "line_number", "registered", "status"
    )


@query
def shadow_list(spark, folder):
    shadow = compare.shadow_endpoints(*_observed(spark, folder))
    return compare.with_location(shadow).select("repo", "method", "path", "framework", "location")


@query
def missing_auth_list(spark, folder):
    bare = corpus.observed_endpoints(spark, folder).filter(~F.col("auth_required"))
    return compare.with_location(bare).select("repo", "method", "path", "framework", "location")


def _repos(endpoints: DataFrame, known: DataFrame) -> DataFrame:
    return endpoints.select("repo").union(known.select("repo")).distinct()


@query
def coverage_ratio(spark, folder):
    endpoints, known = _observed(spark, folder)
    ratios = compare.coverage(endpoints, known, _repos(endpoints, known))
    return ratios.select("repo", F.round("coverage_ratio", 6).alias("coverage_ratio"))


def _posture(spark, folder) -> DataFrame:
    endpoints, known = _observed(spark, folder)
    return compare.posture(compare.match(endpoints, known), known).withColumn(
        "coverage_ratio", F.round("coverage_ratio", 6)
    )


@query
def posture(spark, folder):
    return _posture(spark, folder)


@query
def posture_summary(spark, folder):
    return report.summary(_posture(spark, folder)).select(
        "repo", "parsed_routes_count", "shadow_count", "missing_auth_count", "coverage_ratio", "band"
    )


@query
def gate(spark, folder):
    return compare.gate(_matches(spark, folder))


@query
def gate_new_only(spark, folder):
    return compare.gate(_matches(spark, folder), new_only=True)


@query
def compare_rows(spark, folder):
    """The public comparison over rows in another spelling, which it normalises first."""
    endpoints, known = _observed(spark, folder)
    loose = endpoints.select(
        "repo", "path", F.lower("method").alias("method"), "auth_required", "source_file",
        "line_number", F.concat(F.lit(" "), F.lower("framework")).alias("framework"),
    )
    matches = batch.compare(loose, known)["matches"]
    return matches.groupBy("repo", "framework", "language", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- provenance -------------------------------------------------------------------

def _head(spark, folder, name: str) -> DataFrame:
    return corpus.refs(spark, folder).filter(F.col("name") == name)


_SINCE = "1999-06-01"


@query
def prov_date_window(spark, folder):
    return provenance.commits_since_date(
        corpus.commits(spark, folder), _head(spark, folder, "HEAD"), provenance.window_start(_SINCE)
    )


@query
def prov_ref_window(spark, folder):
    return provenance.commits_since_ref(
        corpus.commits(spark, folder), _head(spark, folder, "HEAD"), _head(spark, folder, "v1")
    )


@query
def prov_added(spark, folder):
    listed = corpus.ref_files(spark, folder)
    return provenance.added_since_ref(
        listed.filter(F.col("ref") == "HEAD"), listed.filter(F.col("ref") == "v1")
    )


@query
def prov_added_renamed(spark, folder):
    """All files at HEAD only: moved, with whence and how alike, or truly added."""
    files = corpus.moving_files(spark, folder)
    now, then = files.filter("ref = 'HEAD'"), files.filter("ref = 'v1'")
    pairs = renames.renames(now, then, corpus.blobs(files))
    fresh = now.select("repo", "path").join(then.select("repo", "path"), ["repo", "path"], "left_anti")
    return fresh.join(pairs, ["repo", "path"], "left").select(
        "repo", "path", F.when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("change"),
        "old_path", F.round("score", 6).alias("score"),
    )


@query
def prov_added_date(spark, folder):
    _, added = batch.window_commits(corpus.history(spark, folder), _SINCE)
    return added


def _annotated(spark, folder, since: str) -> DataFrame:
    return batch.annotate_since(
        corpus.history_endpoints(spark, folder), corpus.history(spark, folder), since, "svc"
    )


@query
def prov_annotate(spark, folder):
    return _annotated(spark, folder, "v1").select(
        "repo", "source_file", "line_number", "is_new", "change_type", "commit", "author",
        history.iso_utc(F.col("committed_at")).alias("committed_at"),
    )


@query
def new_unauth(spark, folder):
    offenders = compare.new_unauthenticated(_annotated(spark, folder, _SINCE))
    return offenders.groupBy("repo").agg(F.count(F.lit(1)).alias("new_unauthenticated_count"))


@query
def new_list(spark, folder):
    new = _annotated(spark, folder, _SINCE).filter("is_new")
    return new.select(
        "repo", "source_file", "line_number", "method", "path", "auth_required", "change_type", "author"
    )


# --- redaction --------------------------------------------------------------------

@query
def redact_documents(spark, folder):
    text = corpus.leaky(F.col("text"), F.col("doc_id"))
    return corpus.table(spark, folder, "documents").select(
        "doc_id", redact.redact_text(text).alias("text")
    )


@query
def redact_pages(spark, folder):
    return redact.redact_frame(corpus.table(spark, folder, "pages"), ["html"])


@query
def redact_nested(spark, folder):
    turns = corpus.table(spark, folder, "conversations")
    said = F.array(corpus.leaky(F.col("text"), F.col("conv_id") + F.col("turn")))
    payloads = turns.select(
        "conv_id", F.struct("turn", F.create_map("role", said).alias("said")).alias("payload")
    )
    clean = redact.redact_frame(payloads)
    return clean.select(
        "conv_id", "payload.turn", F.explode("payload.said").alias("role", "texts")
    ).select("conv_id", "turn", "role", F.element_at("texts", 1).alias("text"))


# --- reports ----------------------------------------------------------------------

@query
def sarif_results(spark, folder):
    return report.findings(_matches(spark, folder)).select(
        "repo", "rule_id", "level", "message", "uri", "start_line", "method", "path", "framework",
        "language", "is_new",
    )


_RESULT = (
    "ruleId string, level string, message struct<text: string>, locations array<struct<"
    "physicalLocation: struct<artifactLocation: struct<uri: string>, "
    "region: struct<startLine: int>>>>, properties struct<method: string, path: string>"
)
_LOG = (
    "version string, runs array<struct<tool: struct<driver: struct<name: string, "
    "rules: array<struct<id: string>>>>, results: array<string>>>"
)
_ENTRY = (
    "path string, method string, auth_required boolean, auth_info string, source_file string, "
    "line_number int, is_new boolean, commit string, author string, committed_at string"
)


def _entries(lines: DataFrame, schema: str) -> DataFrame:
    """List lines parsed, with ``leads`` where no comma stands before one."""
    return lines.filter("copy > 0").select(
        "repo", "section", (~F.startswith("line", F.lit(","))).alias("leads"),
        F.from_json(F.ltrim("line", F.lit(",")), schema).alias("e"),
    )


@query
def sarif_doc(spark, folder):
    """SARIF logs: a row per document (head and foot make a log) and per result."""
    endpoints, known = _observed(spark, folder)
    lines = report.sarif_documents(compare.match(endpoints, known), _repos(endpoints, known))
    # Only head and foot come together; the list between them stays spread.
    logs = (
        lines.filter("copy = 0").groupBy("repo")
        .agg(F.min(F.struct("section", "line")).alias("head"), F.max(F.struct("section", "line")).alias("foot"),
             F.count_if(F.col("section") == 0).alias("documents"))
        .withColumn("log", F.from_json(F.concat("head.line", "foot.line"), _LOG))
        .select(
            "repo", "documents", "log.version",
            F.array_join(F.transform(F.col("log.runs")[0]["tool"]["driver"]["rules"], lambda r: r["id"]), ",")
            .alias("rules"),
        )
    )
    place = F.col("e.locations")[0]["physicalLocation"]
    results = _entries(lines, _RESULT).select(
        "repo", "leads", F.col("e.ruleId").alias("rule_id"), F.col("e.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"),
        F.col("e.properties.method").alias("method"), F.col("e.properties.path").alias("path"),
    )
    return logs.unionByName(results, allowMissingColumns=True)


@query
def sarif_written(spark, folder):
    """SARIF logs appended by the sink, packed, and read back: lines of each repo."""
    endpoints, known = _observed(spark, folder)
    lines = report.sarif_documents(compare.match(endpoints, known), _repos(endpoints, known))
    path = f"{shared_folder(spark)}/sarif-{uuid.uuid4().hex}"
    append_documents(lines, path, compression="gzip")
    return read_documents(spark, path).groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.startswith("value", F.lit('{"$schema"'))).alias("documents"),
        F.count_if(F.startswith("value", F.lit(","))).alias("followers"),
    )


@query
def append_twice(spark, folder):
    """Three batches of endpoints, one run twice and one cut off before it was run whole."""
    rows = corpus.observed_endpoints(spark, folder)
    path = f"{shared_folder(spark).rstrip('/')}/endpoints-{uuid.uuid4().hex}"
    parts = [rows.filter(F.pmod("line_number", F.lit(3)) == n) for n in range(3)]
    parts[1].limit(100).write.parquet(f"{path}/data/attempt=cut-off")
    for n in (0, 1, 2, 0):
        append_endpoints(parts[n], path, f"part {n}")
    return read_endpoints(spark, path).select(
        "repo", "path", "method", "source_file", "line_number", "framework", "auth_required"
    )


@query
def report_json(spark, folder):
    """JSON reports: a row per document with its counts and per list entry."""
    endpoints, known = _observed(spark, folder)
    matches = compare.match(endpoints, known).withColumns({
        "commit": F.when(F.col("is_new"), F.lit("c0ffee1")),
        "author": F.when(F.col("is_new"), F.lit('A "quoted" name')),
        "committed_at": F.when(
            F.col("is_new"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("line_number"))
        ),
    })
    lines = report.report_documents(matches, compare.posture(matches, known))
    heads = lines.filter("section = 0").select(
        "repo", F.from_json(
            F.concat("line", F.lit("]}")),
            "parsed_routes_count bigint, registered_routes_count bigint, coverage_ratio double",
        ).alias("h"),
    ).select(
        "repo", "h.parsed_routes_count", "h.registered_routes_count",
        F.round("h.coverage_ratio", 6).alias("coverage_ratio"),
    )
    lists = F.element_at(
        F.create_map(*[F.lit(x) for x in (1, "shadow", 3, "missing_auth", 5, "new")]), F.col("section")
    )
    entries = _entries(lines, _ENTRY).select("repo", lists.alias("list"), "leads", "e.*")
    return heads.unionByName(entries, allowMissingColumns=True)


@query
def batch_written(spark, folder):
    """A batch job run twice under one name: what its datasets hold of each scanned repo."""
    out = f"{shared_folder(spark).rstrip('/')}/batch-{uuid.uuid4().hex}"
    sources = stage(corpus.js_files(spark, folder), "sources")
    known = openapi.registry(corpus.openapi_specs(spark, folder))
    for _ in range(2):
        written = batch.run_batch(sources, out, registry=known, batch="nightly")
    counts = [
        read_endpoints(spark, f"{out}/endpoints").groupBy("repo").agg(F.count(F.lit(1)).alias("n_endpoints")),
        written["findings"].groupBy("repo").agg(F.count(F.lit(1)).alias("n_findings")),
        read_documents(spark, f"{out}/sarif").groupBy("repo").agg(F.count(F.lit(1)).alias("n_sarif_lines")),
        written["gate"].select("repo", "violations", "passed"),
    ]
    return reduce(lambda a, b: a.join(b, "repo"), counts)


# --- remediation ------------------------------------------------------------------

def _flagged(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Unprotected endpoints of the Python files, some of them misplaced, and the files."""
    sources = corpus.python_files(spark, folder)
    found = python_routes.python_endpoints(staged_syntax(_sources(sources)))
    bare = found.filter(~F.col("auth_required"))
    moved = bare.withColumns(
        {
            "source_file": F.when(
                F.col("source_file").endswith("7.py"), F.concat("source_file", F.lit(".gone"))
            ).otherwise(F.col("source_file")),
            "line_number": F.when(
                F.col("source_file").endswith("3.py"), F.col("line_number") + 1000
            ).otherwise(F.col("line_number")),
        }
    )
    return moved, sources


@query
def remedy_edits(spark, folder):
    return remedy.remedy_edits(*_flagged(spark, folder))


@query
def remedy_diff(spark, folder):
    return remedy.remedy_diffs(*_flagged(spark, folder))
