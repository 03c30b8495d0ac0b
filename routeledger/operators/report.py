"""Findings, SARIF and JSON documents, and the summary row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.history import iso_utc

# Format identifiers, rule names and message texts.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
TOOL_NAME = "routeledger"
TOOL_VERSION = "0.1.0"
RULES = [
    (
        "shadow-endpoint",
        "ShadowEndpoint",
        "Undocumented (shadow) API endpoint",
        "The endpoint is present in the code but not in the OpenAPI registry.",
    ),
    (
        "missing-auth",
        "MissingAuthentication",
        "Endpoint lacks authentication/authorization",
        "No dependency, middleware or annotation that protects the endpoint was found.",
    ),
]
LEVEL = "error"
GREEN_FROM, YELLOW_FROM = 1.0, 0.8

_FINDING_KEYS = ["source_file", "line_number", "path", "method"]


def findings(matches: DataFrame) -> DataFrame:
    """One row per finding: shadow rows and open rows, so an endpoint can yield two."""
    what = F.concat_ws(" ", "method", "path")
    wanted = F.array(
        F.when(
            F.col("status") == "shadow",
            F.struct(
                F.lit(0).alias("rule_order"),
                F.lit(RULES[0][0]).alias("rule_id"),
                F.concat(
                    F.lit("Shadow endpoint "), what,
                    F.lit(" is not present in the OpenAPI registry."),
                ).alias("message"),
            ),
        ),
        F.when(
            ~F.col("auth_required"),
            F.struct(
                F.lit(1).alias("rule_order"),
                F.lit(RULES[1][0]).alias("rule_id"),
                F.concat(
                    F.lit("Endpoint "), what,
                    F.lit(" has no detected authentication/authorization control."),
                ).alias("message"),
            ),
        ),
    )
    return matches.select(
        "*", F.explode(F.filter(wanted, lambda w: w.isNotNull())).alias("finding")
    ).select(
        "*",
        "finding.*",
        F.lit(LEVEL).alias("level"),
        F.translate("source_file", "\\", "/").alias("uri"),
        F.greatest(F.lit(1), F.col("line_number")).alias("start_line"),
    ).drop("finding")


def sarif_result(properties: list[str] | None = None) -> Column:
    """A finding row as a SARIF result object."""
    names = properties or [
        "method", "path", "framework", "language", "is_new", "commit", "author",
    ]
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct("uri").alias("artifactLocation"),
                    F.struct(F.col("start_line").alias("startLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(*names).alias("properties"),
    )


def _null_kept(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _list_lines(items: DataFrame) -> DataFrame:
    """Lines of list entries ``(repo, section, at)``, all but the first after a comma.

    ``at`` orders a section and ends in the line itself, so only equal rows tie; they are
    counted and told apart by ``copy``. First entries are found among the counted rows with
    partial aggregation, so the lines are made and dealt once, and joined back on the whole
    key, by which the rows are dealt already, so a repo with most entries is spread like any.
    """
    counted = items.groupBy("repo", "section", "at").agg(F.count(F.lit(1)).alias("n"))
    # Both readers share one exchange: the sum keeps ``n`` in the plan of this one, and past
    # the filter, true for every row, the test of the join's keys does not go down.
    first = (
        counted.filter(F.spark_partition_id() >= 0).groupBy("repo", "section").agg(F.min("at").alias("at"), F.sum("n").alias("total"))
        .select("repo", "section", "at", (F.col("total") > 0).alias("leads"))
    )
    numbered = counted.join(first, ["repo", "section", "at"], "left").select(
        "repo", "section", "at", F.col("at.line").alias("line"), "leads",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    )
    leads = F.col("leads").isNotNull() & (F.col("copy") == 1)
    return numbered.select(
        "repo", "section", "at", "copy",
        F.when(leads, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"),
    )


def _document(frame: DataFrame, items: DataFrame) -> DataFrame:
    """List lines between the fixed ones of ``frame(repo, fixed)``, one document per repo."""
    listed = _list_lines(items)
    at = F.lit(None).cast(listed.schema["at"].dataType)
    fixed = frame.select("repo", F.inline("fixed")).select(
        "repo", "section", at.alias("at"), F.lit(0).alias("copy"), "line"
    )
    return fixed.unionByName(listed)


def _fixed(*lines: tuple[int, Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("section"), line.alias("line")) for n, line in lines
    ])


def _at(*leading: str) -> Column:
    return F.struct(*leading, *_FINDING_KEYS, "line")


def sarif_documents(matches: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``(repo, section, at, copy, line)``: the lines of one SARIF log per repo.

    Ordered by these columns (nulls first) the lines of a repo are its document, shadow
    findings first. Repos of ``repos`` without findings get a log without results.
    """
    rules = [
        {
            "id": rule_id, "name": name, "shortDescription": {"text": short},
            "fullDescription": {"text": full}, "defaultConfiguration": {"level": LEVEL},
        }
        for rule_id, name, short, full in RULES
    ]
    driver = {"driver": {"name": TOOL_NAME, "version": TOOL_VERSION, "rules": rules}}
    head = (
        f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"version":{json.dumps(SARIF_VERSION)},'
        f'"runs":[{{"tool":{json.dumps(driver)},"results":['
    )
    # A plain literal would be left out of the join's keys, and the rows dealt once more.
    items = findings(matches).withColumn("line", _null_kept(sarif_result())).select(
        "repo", F.explode(F.array(F.lit(1))).alias("section"), _at("rule_order").alias("at")
    )
    named = (items if repos is None else repos).select("repo").distinct()
    frame = named.withColumn("fixed", _fixed((0, F.lit(head)), (2, F.lit("]}]}"))))
    return _document(frame, items)


def report_documents(matches: DataFrame, posture: DataFrame) -> DataFrame:
    """``(repo, section, at, copy, line)``: the lines of one JSON report per repo of ``posture``.

    Ordered by these columns (nulls first) the lines of a repo are its document.
    """
    time = F.to_json(F.struct(iso_utc(F.col("committed_at")).alias("committed_at")))
    fields = [
        "path", "method", "auth_required", "auth_info", "source_file", "line_number",
        "framework", "language", "is_new", "change_type", "commit", "author",
    ]
    committed = F.when(F.col("committed_at").isNull(), F.lit('"committed_at":null}')).otherwise(
        F.substring(time, 2, 100)
    )
    entry = F.concat(F.regexp_replace(_null_kept(F.struct(*fields)), r"\}$", ","), committed)
    new = F.coalesce("is_new", F.lit(False))
    sections = F.filter(
        F.array(
            F.when(F.col("status") == "shadow", 1), F.when(~F.col("auth_required"), 3),
            F.when(new, 5),
        ),
        lambda s: s.isNotNull(),
    )
    items = matches.withColumn("line", entry).select(
        "repo", F.explode(sections).alias("section"), _at().alias("at")
    )
    head = F.concat(
        F.lit('{"parsed_routes_count":'), "parsed_routes_count",
        F.lit(',"registered_routes_count":'), "registered_routes_count",
        F.lit(',"coverage_ratio":'), "coverage_ratio", F.lit(',"shadow_endpoints":['),
    )
    frame = posture.select("repo", _fixed(
        (0, head), (2, F.lit('],"missing_auth_endpoints":[')),
        (4, F.lit('],"new_endpoints":[')), (6, F.lit("]}")),
    ).alias("fixed"))
    return _document(frame, items)


def render(matches: DataFrame, posture: DataFrame, fmt: str) -> DataFrame:
    """Lines of documents in the named format; an unknown name is an error."""
    if fmt.lower() == "json":
        return report_documents(matches, posture)
    if fmt.lower() == "sarif":
        return sarif_documents(matches, posture.select("repo"))
    raise ValueError(f"unknown report format {fmt!r}: use 'json' or 'sarif'")


def summary(posture: DataFrame) -> DataFrame:
    """The posture row with its colour band."""
    ratio = F.col("coverage_ratio")
    return posture.withColumn(
        "band",
        F.when(ratio >= GREEN_FROM, "green").when(ratio >= YELLOW_FROM, "yellow").otherwise("red"),
    )
