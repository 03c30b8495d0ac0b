"""Spring controllers: annotation runs over logical lines, all in SQL windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..functions.text import SPACE, WORD, join_present
from ..sources.config import with_rules
from .logical_lines import logical_lines

# Mapping annotations and their verbs.
VERB_ANNOTATIONS = {
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
}
GENERIC_ANNOTATION = "RequestMapping"

ANNOTATION = rf"(?s)^@({WORD}+){SPACE}*(?:\((.*)\))?{SPACE}*\z"
TYPE_DECLARATION = rf"(?<!{WORD})(?:class|interface|enum){SPACE}+{WORD}"


def _named_value(key: str) -> str:
    return rf"{key}{SPACE}*={SPACE}*\{{?{SPACE}*\"([^\"]*)\""


def annotation_path(args: Column) -> Column:
    """``value=`` first, then ``path=``, then the first quoted text; null if none."""
    quoted = r"\"([^\"]*)\""
    result = None
    for pattern in (_named_value("value"), _named_value("path"), quoted):
        found = F.when(args.rlike(pattern), F.regexp_extract(args, pattern, 1))
        result = found if result is None else F.coalesce(result, found)
    return result


def annotation_methods(name: Column, args: Column) -> Column:
    verbs = F.create_map(*[F.lit(x) for kv in VERB_ANNOTATIONS.items() for x in kv])
    named = F.transform(
        F.regexp_extract_all(args, F.lit(rf"RequestMethod\.({WORD}+)"), F.lit(1)), F.upper
    )
    return (
        F.when(verbs[name].isNotNull(), F.array(verbs[name]))
        .when(F.size(named) > 0, named)
        .otherwise(F.array(F.lit("GET")))
    )


def annotation_runs(lines: DataFrame) -> DataFrame:
    """Each non-annotation line with the run of annotations directly above it."""
    parsed = lines.withColumn("is_ann", F.col("text").rlike(ANNOTATION))
    parsed = parsed.withColumn(
        "is_type", ~F.col("is_ann") & F.col("text").rlike(TYPE_DECLARATION)
    )
    ordered = Window.partitionBy("repo", "rel_path").orderBy("start_line")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("repo", "rel_path")
    numbered = parsed.withColumn(
        "run",
        F.coalesce(F.sum(F.when(F.col("is_ann"), 0).otherwise(1)).over(before), F.lit(0)),
    ).withColumn("type_line", F.min(F.when(F.col("is_type"), F.col("start_line"))).over(whole))
    annotation = F.struct(
        F.col("start_line").alias("line"),
        F.regexp_extract("text", ANNOTATION, 1).alias("name"),
        F.regexp_extract("text", ANNOTATION, 2).alias("args"),
    )
    return (
        numbered.groupBy("repo", "rel_path", "type_line", "run")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("is_ann"), annotation))).alias("anns"),
            F.max(F.when(~F.col("is_ann"), F.col("start_line"))).alias("owner_line"),
        )
        # A run without an owner ends the file and belongs to nothing.
        .filter(F.col("owner_line").isNotNull() & (F.size("anns") > 0))
    )


def java_endpoints(files: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Endpoints of Spring controllers.

    Only files naming a mapping annotation are exploded into lines, so the text
    that crosses the one shuffle (by file) is that of controllers alone. The
    per-repo lists join the annotation runs, which are few.
    """
    controllers = files.filter(F.col("content").contains("Mapping"))
    runs, rules = with_rules(
        annotation_runs(logical_lines(controllers)), config, ["rel_path", "owner_line"]
    )
    mappings = [*VERB_ANNOTATIONS, GENERIC_ANNOTATION]
    runs = (
        runs.withColumn("is_type_run", F.col("owner_line") == F.col("type_line"))
        .withColumn(
            "auth_names",
            F.filter(F.transform("anns", lambda a: a["name"]), rules.annotation),
        )
        .withColumn(
            "mapping",
            F.try_element_at(
                F.filter("anns", lambda a: a["name"].isin(mappings)), F.lit(1)
            ),
        )
    )
    prefixes = F.filter(
        F.transform(
            F.filter("anns", lambda a: a["name"] == GENERIC_ANNOTATION),
            lambda a: annotation_path(a["args"]),
        ),
        lambda p: p != "",
    )
    # The lists of one type run, seen by every later run of the same file.
    whole = Window.partitionBy("repo", "rel_path")
    resolved = (
        runs.withColumn(
            "type_prefix",
            F.max(
                F.when(F.col("is_type_run"), F.try_element_at(prefixes, F.lit(-1)))
            ).over(whole),
        )
        .withColumn(
            "type_auth",
            F.max(F.when(F.col("is_type_run"), F.size("auth_names") > 0)).over(whole),
        )
        .filter(~F.coalesce(F.col("is_type_run"), F.lit(False)))
        .filter(F.col("mapping").isNotNull())
    )
    inside = F.coalesce(F.col("owner_line") > F.col("type_line"), F.lit(False))
    type_auth = inside & F.coalesce(F.col("type_auth"), F.lit(False))
    prefix = F.when(inside, F.coalesce("type_prefix", F.lit(""))).otherwise("")
    path = F.concat(prefix, F.coalesce(annotation_path(F.col("mapping.args")), F.lit("")))
    info = join_present(
        F.when(type_auth, F.lit("class-level authorization")),
        F.when(
            F.size("auth_names") > 0,
            F.concat(
                F.lit("annotations: "),
                F.array_join(F.array_sort(F.array_distinct("auth_names")), ", "),
            ),
        ),
    )
    return resolved.select(
        "repo",
        normalize_path(path).alias("path"),
        F.explode(
            annotation_methods(F.col("mapping.name"), F.col("mapping.args"))
        ).alias("method"),
        (type_auth | (F.size("auth_names") > 0)).alias("auth_required"),
        info.alias("auth_info"),
        F.col("rel_path").alias("source_file"),
        F.col("mapping.line").cast("int").alias("line_number"),
        F.lit("Spring Boot").alias("framework"),
        F.lit("java").alias("language"),
    )
