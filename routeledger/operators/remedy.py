"""Line edits and unified diffs that protect a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, newline_lines, strip
from .joins import lookup, stage

# The inserted texts and the distance searched for a decorator.
FASTAPI_IMPORT = "from fastapi import Depends"
FASTAPI_GUARD = "dependencies=[Depends(verify_token)]"
FLASK_IMPORT = "from flask_jwt_extended import jwt_required"
FLASK_GUARD = "@jwt_required()"
LOOK_BACK = 10
CONTEXT = 3

_KEYS = ["repo", "source_file"]


def file_outlines(files: DataFrame) -> DataFrame:
    """What the edits need to know of each file: narrow, a small part of the text.

    Only this outline meets the endpoints in a shuffle, never the content.
    """
    lines = newline_lines(F.col("content"))
    numbered = F.transform(
        F.col("lines"), lambda text, i: F.struct((i + 1).alias("line"), text.alias("text"))
    )
    code = F.filter(
        numbered, lambda l: (strip(l["text"]) != "") & ~strip(l["text"]).startswith("#")
    )
    return files.select(
        "repo", F.col("rel_path").alias("source_file"), "content", lines.alias("lines")
    ).select(
        *_KEYS,
        F.size("lines").alias("n_lines"),
        F.col("content").contains("Depends").alias("has_depends"),
        F.col("content").contains("jwt_required").alias("has_jwt"),
        F.coalesce(F.try_element_at(code, F.lit(1))["line"], F.lit(1)).alias("first_code"),
        F.filter(numbered, lambda l: strip(l["text"]).startswith("@")).alias("decorators"),
    )


def _guarded(line: Column) -> Column:
    """The decorator line with the guard among its arguments; null if it has no place."""
    opened = F.locate("(", line)
    before = F.regexp_extract(line, r"(?s)^(.*)\)", 1)
    after = F.regexp_extract(line, r"(?s)^.*\)(.*)\z", 1)
    inner = strip(F.substring(before, opened + 1, F.length(before)))
    changed = F.when(
        inner != "", F.concat(before, F.lit(f", {FASTAPI_GUARD})"), after)
    ).otherwise(
        F.concat(F.substring(line, F.lit(1), opened), F.lit(f"{FASTAPI_GUARD})"), after)
    )
    fits = ~line.contains("dependencies=") & strip(line).endswith(")") & (opened > 0)
    return F.when(fits, changed)


def plan_edits(endpoints: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """Endpoints with ``status``, the ``edits`` that protect them and ``more`` of the outline.

    ``status`` is generic (file unknown), out_of_bounds, unsupported (not Python) or
    edit; each edit is ``(op, at_line, old, new)`` with op insert_before, replace or
    insert_after.
    """
    endpoints = stage(endpoints, "flagged")
    wanted = endpoints.select("repo", F.col("source_file").alias("rel_path")).distinct()
    # Only files with a flagged endpoint are split into lines.
    flagged = lookup(files, wanted, ["repo", "rel_path"], "left_semi", spread=["rel_path"])
    joined = endpoints.join(file_outlines(flagged), _KEYS, "left")
    line = F.col("line_number")
    near = F.filter(
        "decorators",
        lambda d: (d["line"] <= line)
        & (d["line"] > line - LOOK_BACK)
        & (d["text"].contains("route") | F.contains(d["text"], F.lower(F.col("method")))),
    )
    planned = joined.withColumn("decorator", F.try_element_at(near, F.lit(-1)))
    fastapi = F.col("framework") == "FastAPI"
    at, text = F.col("decorator.line"), F.col("decorator.text")

    def edit(op: str, at_line: Column, old: Column, new: Column) -> Column:
        return F.struct(
            F.lit(op).alias("op"), at_line.cast("int").alias("at_line"),
            old.alias("old"), new.alias("new"),
        )

    nothing = F.lit(None).cast("string")
    indent = F.length(text) - F.length(F.ltrim(text, F.lit(WHITE_SPACE)))
    candidates = F.array(
        F.when(
            fastapi & ~F.col("has_depends"),
            edit("insert_before", F.col("first_code"), nothing, F.lit(FASTAPI_IMPORT)),
        ),
        F.when(
            ~fastapi & ~F.col("has_jwt"),
            edit("insert_before", F.col("first_code"), nothing, F.lit(FLASK_IMPORT)),
        ),
        F.when(
            fastapi & _guarded(text).isNotNull(), edit("replace", at, text, _guarded(text))
        ),
        F.when(
            ~fastapi & at.isNotNull(),
            edit(
                "insert_after", at, nothing,
                F.concat(F.repeat(F.lit(" "), indent), F.lit(FLASK_GUARD)),
            ),
        ),
    )
    status = (
        F.when(F.col("n_lines").isNull(), "generic")
        .when((line < 1) | (line > F.col("n_lines")), "out_of_bounds")
        .when(F.col("language") != "python", "unsupported")
        .otherwise("edit")
    )
    edits = F.when(
        status == "edit", F.filter(candidates, lambda e: e.isNotNull())
    )
    return planned.select(*endpoints.columns, status.alias("status"), edits.alias("edits"), *more)


def remedy_edits(endpoints: DataFrame, files: DataFrame) -> DataFrame:
    """One row per edit; endpoints that cannot be edited keep one row with their status."""
    planned = stage(plan_edits(endpoints, files), "planned")
    return planned.select(
        *_KEYS, "line_number", "method", "path", "framework", "status",
        F.posexplode_outer("edits").alias("seq", "e"),
    ).select(
        *_KEYS, "line_number", "method", "path", "framework", "status", "seq",
        "e.op", "e.at_line", "e.old", "e.new",
    )


def _span(edit: Column, n_lines: Column) -> tuple[Column, Column]:
    """The first and last old line that an edit's hunk shows: three around the change."""
    at = edit["at_line"]
    low = F.when(edit["op"] == "insert_after", at - CONTEXT + 1).otherwise(at - CONTEXT)
    high = F.when(edit["op"] == "insert_before", at + CONTEXT - 1).otherwise(at + CONTEXT)
    return F.greatest(low, F.lit(1)), F.least(high, n_lines)


def _hunks(edits: Column, n_lines: Column) -> Column:
    """Edits in file order, gathered where their surroundings touch: ``(low, high, edits)``."""
    ordered = F.array_sort(
        F.transform(
            edits,
            # An insertion before a line precedes its replacement, one behind it follows.
            lambda e: F.struct(
                e["at_line"].alias("at_line"),
                F.when(e["op"] == "insert_before", 0).when(e["op"] == "replace", 1).otherwise(2).alias("rank"),
                e["op"].alias("op"), e["old"].alias("old"), e["new"].alias("new"),
            ),
        )
    )
    one = "struct<at_line: int, rank: int, op: string, old: string, new: string>"
    kind = f"array<struct<low: int, high: int, edits: array<{one}>>>"

    def gather(found: Column, e: Column) -> Column:
        low, high = _span(e, n_lines)
        last = F.try_element_at(found, F.lit(-1))
        touches = F.coalesce(low <= last["high"] + 1, F.lit(False))
        grown = F.struct(
            last["low"].alias("low"), F.greatest(last["high"], high).alias("high"),
            F.concat(last["edits"], F.array(e)).alias("edits"),
        )
        fresh = F.struct(low.alias("low"), high.alias("high"), F.array(e).alias("edits"))
        before = F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(grown))).otherwise(
            F.concat(found, F.array(fresh))
        ).cast(kind)

    return F.aggregate(ordered, F.array().cast(kind), gather)


def _entry(sign: str, at: Column, text: Column) -> Column:
    """A diff line: its sign, the old line it stands at and its text (null: that line's)."""
    return F.struct(
        F.lit(sign).alias("sign"), at.cast("int").alias("old_line"), text.cast("string").alias("text")
    )


def _inserted(edits: Column) -> Column:
    return F.size(F.filter(edits, lambda e: e["op"] != "replace"))


def _range(start: Column, count: Column) -> Column:
    """Where a hunk stands, with the count left out if it is one."""
    return F.when(count == 1, start.cast("string")).otherwise(
        F.concat_ws(",", start.cast("string"), count.cast("string"))
    )


def _hunk_lines(hunk: Column, inserted_before: Column) -> Column:
    low, high, edits = hunk["low"], hunk["high"], hunk["edits"]
    count = high - low + 1
    head = F.concat(
        F.lit("@@ -"), _range(low, count), F.lit(" +"),
        _range(low + inserted_before, count + _inserted(edits)), F.lit(" @@"),
    )

    def around(x: Column) -> Column:
        here = F.filter(edits, lambda e: e["at_line"] == x)

        def added(op: str) -> Column:
            chosen = F.filter(here, lambda e: e["op"] == op)
            return F.transform(chosen, lambda e: _entry("+", x, e["new"]))

        replaced = F.filter(here, lambda e: e["op"] == "replace")
        # Within one change, what goes stands before what comes.
        return F.when(
            F.size(replaced) > 0,
            F.concat(
                F.transform(replaced, lambda e: _entry("-", x, e["old"])),
                added("insert_before"), added("replace"), added("insert_after"),
            ),
        ).otherwise(
            F.concat(
                added("insert_before"), F.array(_entry(" ", x, F.lit(None))), added("insert_after")
            )
        )

    body = F.flatten(F.transform(F.sequence(low, high), around))
    return F.concat(F.array(_entry("@", low, head)), body)


def _diff_lines(source_file: Column, hunks: Column) -> Column:
    """All lines of a unified diff, context still without text."""
    heads = F.array(
        _entry("h", F.lit(0), F.concat(F.lit("--- a/"), source_file)),
        _entry("h", F.lit(0), F.concat(F.lit("+++ b/"), source_file)),
    )

    def each(hunk: Column, k: Column) -> Column:
        earlier = F.flatten(F.transform(F.slice(hunks, F.lit(1), k), lambda h: h["edits"]))
        return _hunk_lines(hunk, _inserted(earlier))

    return F.concat(heads, F.flatten(F.transform(hunks, each)))


def _other_lines() -> Column:
    """What stands in place of a diff where there is no place for an edit."""
    n = F.col("line_number").cast("string")
    generic = F.array(
        F.concat(F.lit("--- a/"), "source_file"),
        F.concat(F.lit("+++ b/"), "source_file"),
        F.concat(F.lit("@@ -"), n, F.lit(",3 +"), n, F.lit(",4 @@")),
        F.concat(F.lit("# Generic Remediation Patch for "), "framework", F.lit(" Endpoint")),
        F.concat(F.lit("# Target: "), "method", F.lit(" "), "path"),
        F.lit("# Action: Inject authentication token validation controls."),
    )
    error = F.concat(
        F.lit("# Error: Line number "), n, F.lit(" is out of bounds for "), F.col("source_file")
    )
    return F.when(F.col("status") == "generic", generic).when(
        F.col("status") == "out_of_bounds", F.array(error)
    )


def remedy_diffs(endpoints: DataFrame, files: DataFrame) -> DataFrame:
    """A unified diff per endpoint, one row ``(.., status, at, line)`` per line from 0.

    Edits become hunks with three lines around them, hunks that touch are one, and both
    sides are numbered, all from the planned edits alone. Only then are the texts of the
    context lines fetched: each flagged file is told once which of its lines are shown, and
    only these leave it, so neither content nor files' line lists meet the endpoints. An
    endpoint without edits keeps one row without a line.
    """
    keys = [*_KEYS, "line_number", "method", "path", "framework", "status"]
    planned = stage(plan_edits(endpoints, files, "n_lines"), "planned")
    edited = F.coalesce(F.size("edits") > 0, F.lit(False))
    listed = stage(
        planned.filter(edited)
        .withColumn("hunks", _hunks(F.col("edits"), F.col("n_lines")))
        .withColumn("entries", _diff_lines(F.col("source_file"), F.col("hunks")))
        .select(*keys, F.posexplode("entries").alias("at", "e")).select(*keys, "at", "e.*"),
        "diff-lines",
    )
    shown = (
        listed.filter("sign = ' '")
        .groupBy("repo", F.col("source_file").alias("rel_path"))
        .agg(F.collect_set("old_line").alias("wanted"))
    )
    told = lookup(files, shown, ["repo", "rel_path"], "inner", spread=["rel_path"])
    texts = told.withColumn("lines", newline_lines(F.col("content"))).select(
        "repo", F.col("rel_path").alias("source_file"),
        F.explode(
            F.transform(
                "wanted", lambda n: F.struct(n.alias("old_line"), F.get("lines", n - 1).alias("found"))
            )
        ).alias("l"),
    ).select(*_KEYS, "l.*", F.lit(" ").alias("sign"))
    full = listed.join(texts, [*_KEYS, "old_line", "sign"], "left")
    mark = F.when(F.col("sign").isin(" ", "+", "-"), F.col("sign")).otherwise("")
    diffs = full.select(
        *keys, "at", F.concat(mark, F.coalesce("text", "found")).alias("line")
    )
    others = planned.filter(~edited).select(
        *keys, F.posexplode_outer(_other_lines()).alias("at", "line")
    ).withColumn("at", F.coalesce("at", F.lit(0)))
    return diffs.unionByName(others).drop("framework")


def diff_texts(lines: DataFrame) -> DataFrame:
    """``remedy_diffs`` with one row and one text per endpoint; an edit bounds its lines."""
    keys = [c for c in lines.columns if c not in ("at", "line")]
    ordered = F.array_sort(F.collect_set(F.struct("at", "line")))
    text = F.array_join(F.transform("lines", lambda l: l["line"]), "\n")
    return lines.groupBy(*keys).agg(ordered.alias("lines")).select(*keys, text.alias("diff"))
