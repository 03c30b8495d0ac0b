"""Comparison, gate, documents, remediation, runtime inventories and jobs."""

import datetime
import difflib
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from routeledger import compare, remediation, run_batch, scan
from routeledger.operators import compare as ops
from routeledger.operators import joins, remedy, report
from routeledger.plans import queries
from routeledger.sources import openapi, runtime
from routeledger.sources.sinks import append_documents, append_endpoints, read_documents, read_endpoints
from routeledger.streaming.jobs import open_counts, open_counts_stream, redact_stream, rescan_stream
from tests.harbor import DESK, TIDES

SPEC = {
    "paths": {
        "/berths/{id}/lock": {"put": {}},
        "/crews/{n}": {"delete": {}, "summary": "no verb"},
        "/crews/": {"GET": {}},
        "/": {"head": {}},
        "/wrong": "text",
    }
}


@pytest.fixture(scope="module")
def project(spark, make_files):
    files = make_files({"a.py": TIDES, "b.py": DESK}).cache()
    specs = spark.createDataFrame(
        [("r", json.dumps(SPEC)), ("idle", '{"paths": {}}'), ("bad", "nope")],
        "repo string, spec_json string",
    )
    known = openapi.registry(specs)
    return files, known, compare(scan(files), known)["matches"].cache()


def test_posture(project):
    _, known, matches = project
    row = ops.posture(matches, known).first()
    assert row.parsed_routes_count == 9 and row.registered_routes_count == 4
    assert row.shadow_count == 5 and row.missing_auth_count == 5
    assert row.coverage_ratio == pytest.approx(4 / 9)
    shadow = {r.path for r in matches.filter("status = 'shadow'").collect()}
    assert shadow == {
        "/berths/:berth", "/tides/:port/today", "/tides/:port", "/crews/:crew", "/notices"
    }
    assert ops.gate(matches).first().violations == 10
    assert not ops.gate(matches).first().passed


def test_posture_of_repos_without_rows(spark, project):
    _, known, matches = project
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    rows = {r.repo: r for r in ops.posture(matches, known, repos).collect()}
    gates = {r.repo: r for r in ops.gate(matches, repos=repos).collect()}
    assert gates["none"].passed and gates["none"].violations == 0 and not gates["r"].passed
    assert rows["none"].coverage_ratio == 1.0 and rows["none"].parsed_routes_count == 0


def test_strict_registry_fails_on_bad_json(spark):
    specs = spark.createDataFrame([("bad", "nope")], "repo string, spec_json string")
    assert openapi.registry(specs).count() == 0
    with pytest.raises(Exception, match="not a JSON object"):
        openapi.registry(specs, strict=True).collect()


def test_gate_new_only_counts_old_rows_of_a_new_key(spark):
    rows = [("r", "/a", "GET", False, True), ("r", "/a", "GET", False, False), ("r", "/b", "GET", False, False)]
    matches = spark.createDataFrame(
        rows, "repo string, path string, method string, auth_required boolean, is_new boolean"
    ).withColumn("status", F.lit("missing_auth"))
    assert ops.gate(matches, new_only=True).first().violations == 2


def document(lines, repo="r"):
    order = ["section", "at", "copy"]
    rows = lines.filter(F.col("repo") == repo).orderBy(*order).collect()
    return json.loads("\n".join(r.line for r in rows))


def test_sarif(spark, project):
    _, _, matches = project
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    lines = report.sarif_documents(matches.union(matches), repos)  # equal rows stay apart
    log = document(lines)
    results = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and len(log["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert [x["ruleId"] for x in results] == ["shadow-endpoint"] * 10 + ["missing-auth"] * 10
    assert all(
        x["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for x in results
    )
    assert document(lines, "none")["runs"][0]["results"] == []


def test_json_report(spark, project):
    _, known, matches = project
    new = matches.withColumn("is_new", F.col("path") == "/crews").withColumn(
        "committed_at", F.when(F.col("is_new"), F.timestamp_seconds(F.lit(86399)))
    )
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    lines = report.report_documents(new, ops.posture(new, known, repos))
    found = document(lines)
    assert found["coverage_ratio"] == pytest.approx(4 / 9) and found["parsed_routes_count"] == 9
    assert len(found["shadow_endpoints"]) == 5 and len(found["missing_auth_endpoints"]) == 5
    assert {x["committed_at"] for x in found["new_endpoints"]} == {"1970-01-01T23:59:59+00:00"}
    assert {x["committed_at"] for x in found["shadow_endpoints"]} <= {None, "1970-01-01T23:59:59+00:00"}
    assert document(lines, "none")["new_endpoints"] == []


def test_render_rejects_unknown_format(project):
    _, known, matches = project
    with pytest.raises(ValueError):
        report.render(matches, ops.posture(matches, known), "xml")


def test_remediation_diffs(project):
    files, _, matches = project
    diffs = {r.path: r.diff for r in remediation(matches.filter("NOT auth_required"), files).collect()}
    # The first file imports Depends already: only the decorator changes.
    lines = TIDES.splitlines()
    changed = [*lines]
    at = lines.index('@tides.patch("/{port}")')
    changed[at] = '@tides.patch("/{port}", dependencies=[Depends(verify_token)])'
    want = difflib.unified_diff(lines, changed, "a/a.py", "b/a.py", lineterm="")
    assert diffs["/tides/:port"] == "\n".join(want)
    # The second names the guard already: one line below the decorator.
    assert "+@jwt_required()" in diffs["/crews"] and "import jwt" not in diffs["/crews"]


def test_remediation_inserts_imports_on_the_decorator_line(spark, make_files):
    files = make_files({"x.py": "# c\n\n@app.get()\ndef f(): ...\n", "y.py": "@bp.route('/')\ndef g(): ..."})
    rows = spark.createDataFrame(
        [
            ("r", "x.py", 4, "GET", "/", "FastAPI", "python"),
            ("r", "y.py", 2, "GET", "/", "Flask", "python"),
            ("r", "y.py", 9, "GET", "/", "Flask", "python"),
            ("r", "gone.py", 3, "PUT", "/g", "Flask", "python"),
        ],
        "repo string, source_file string, line_number int, method string, path string, "
        "framework string, language string",
    )
    diffs = {(r.source_file, r.line_number): r.diff for r in remediation(rows, files).collect()}
    x = [line for line in diffs["x.py", 4].splitlines() if line]
    assert "+from fastapi import Depends" in x
    assert "+@app.get(dependencies=[Depends(verify_token)])" in x and "-@app.get()" in x
    y = [line for line in diffs["y.py", 2].splitlines() if line]
    assert y.index("+from flask_jwt_extended import jwt_required") < y.index("+@jwt_required()")
    assert diffs["y.py", 9] == "# Error: Line number 9 is out of bounds for y.py"
    assert "# Target: PUT /g" in diffs["gone.py", 3]


def test_hunks_match_a_plain_diff(spark):
    rng = random.Random(6)
    cases = []
    for case in range(120):
        n = rng.randrange(1, 40)
        places = sorted(rng.sample(range(1, n + 1), min(n, rng.randrange(1, 5))))
        edits = [(rng.choice(["insert_before", "replace", "insert_after"]), at) for at in places]
        # Neighbouring places would let a plain diff pair the new lines otherwise.
        edits = [e for k, e in enumerate(edits) if k == 0 or places[k] > places[k - 1] + 1]
        edits = [(op, at, f"line {at}" if op == "replace" else None, f"new {at}") for op, at in edits]
        rng.shuffle(edits)
        cases.append((case, n, edits))
    planned = spark.createDataFrame(
        cases, "id int, n_lines int, edits array<struct<op: string, at_line: int, old: string, new: string>>"
    )
    hunks = planned.withColumn("hunks", remedy._hunks(F.col("edits"), F.col("n_lines")))
    found = hunks.select("id", remedy._diff_lines(F.lit("f"), F.col("hunks")).alias("e")).collect()
    entries = {r.id: r.e for r in found}
    for case, n, edits in cases:
        old = [f"line {k}" for k in range(1, n + 1)]
        new = []
        for k, line in enumerate(old, 1):
            here = {op: text for op, at, _, text in edits if at == k}
            new += [here["insert_before"]] if "insert_before" in here else []
            new += [here.get("replace", line)]
            new += [here["insert_after"]] if "insert_after" in here else []
        got = [
            e.text if e.sign in "h@" else e.sign + (e.text or f"line {e.old_line}") for e in entries[case]
        ]
        assert got == list(difflib.unified_diff(old, new, "a/f", "b/f", lineterm=""))


LAYERS = (
    "app string, layer_id bigint, parent_id bigint, pos int, kind string, path string, "
    "regexp_source string, fast_slash boolean, methods array<string>, name string, "
    "handlers array<string>"
)


def test_router_stack(spark):
    mount = r"^\/yard\/?(?=\/|$)"
    rows = [
        ("dock", 20, None, 5, "route", "/signal", None, False, ["put", "head"], None, ["wave"]),
        ("dock", 21, None, 6, "router", None, mount, False, None, None, []),
        ("dock", 22, 21, 1, "use", None, None, False, None, "requireAuth", []),
        ("dock", 23, 21, 0, "route", "/free/:n", None, False, ["patch"], None, []),
        ("dock", 24, 21, 2, "route", "/kept", None, False, ["delete"], None, ["scrap"]),
    ]
    flat = runtime.flatten_router(spark.createDataFrame(rows, LAYERS)).select(
        F.col("app").alias("repo"), F.lit("bin/dock.js").alias("entry"), "path", "method", "middleware"
    )
    found = {(r.method, r.path): r for r in runtime.runtime_endpoints(flat).collect()}
    assert {k for k, r in found.items() if not r.auth_required} == {
        ("PUT", "/signal"), ("HEAD", "/signal"), ("PATCH", "/yard/free/:n")
    }
    assert found["DELETE", "/yard/kept"].auth_required
    assert {(r.source_file, r.line_number) for r in found.values()} == {("dock.js", 0)}


def test_router_cycles_are_refused(spark):
    rows = [
        ("a", 1, None, 0, "router", None, None, True, None, None, []),
        ("a", 1, 1, 0, "router", None, None, True, None, None, []),
    ]
    with pytest.raises(ValueError, match="own ancestor"):
        runtime.flatten_router(spark.createDataFrame(rows, LAYERS))


def test_unreadable_dumps_are_rejected(spark):
    rows = [("a", "x.js", "{nope"), ("b", "y.js", '{"error": "boom"}'), ("c", "z.js", '{"routes": [{"path": "/k"}]}'),
            ("d", "z.js", "{}"), ("e", "z.js", None)]
    dumps = spark.createDataFrame(rows, "repo string, entry string, dump_json string")
    bad = {r.repo: r.reason for r in runtime.invalid_dumps(dumps).collect()}
    assert bad == {"a": "not JSON", "b": "error: boom", "e": "not JSON"}
    assert [(r.repo, r.path) for r in runtime.read_dumps(dumps).collect()] == [("c", "/k")]


def test_batch_job(spark, project, tmp_path):
    files, known, _ = project
    written = run_batch(files, str(tmp_path), registry=known)
    assert read_endpoints(spark, f"{tmp_path}/endpoints").count() == 9
    assert written["posture"].first().shadow_count == 5
    assert written["findings"].count() == 10
    files_in_order = sorted((tmp_path / "sarif").glob("data/attempt=*/repo=r/part-*"))
    text = "".join(p.read_text() for p in files_in_order)
    assert len(json.loads(text)["runs"][0]["results"]) == 10
    assert set(run_batch(files, f"{tmp_path}/bare")) == {"endpoints"}


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "i int")
    append_endpoints(rows(1, 2), path, "a")
    append_endpoints(rows(9), path)
    rows(7, 7).write.parquet(f"{path}/data/attempt=cut-off")
    assert sorted(r.i for r in read_endpoints(spark, path).collect()) == [1, 2, 9]
    append_endpoints(rows(1, 3), path, "a")
    assert sorted(r.i for r in read_endpoints(spark, path).collect()) == [1, 3, 9]
    lines = spark.createDataFrame([("r", 0, 0, 0, "x"), ("s", 0, 0, 0, "y")], "repo string, section int, at int, copy int, line string")
    for _ in range(2):
        append_documents(lines, f"{path}-docs", "d")
    assert {tuple(r) for r in read_documents(spark, f"{path}-docs").collect()} == {("x", "r"), ("y", "s")}


def test_heavy_keys_are_spread_by_their_weight(spark, monkeypatch):
    monkeypatch.setattr(joins, "KEY_ROWS", 40)
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)], "k string, i int")
    heavy = {r.k: r._tasks for r in joins.heavy_keys(left, ["k"]).collect()}
    assert heavy == {"hot": 5}
    right = spark.createDataFrame([("hot", 1), ("k7", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = joins.lookup(left, right, ["k"], how, spread=["i"], small=False)
        want = left.join(right, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how
    got = joins.lookup(left, right.limit(0), ["k"], spread=["i"])
    assert got.count() == 600


def test_streams(spark, project, tmp_path):
    files, _, _ = project
    spark.createDataFrame([("mail a@b.co",)], "text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    redact_stream(source, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "mail [REDACTED_EMAIL]"

    files.write.parquet(f"{tmp_path}/files")
    files.select("repo", "rel_path").write.parquet(f"{tmp_path}/changes")
    changes = spark.readStream.schema("repo string, rel_path string").parquet(f"{tmp_path}/changes")
    rescan_stream(
        changes, lambda: spark.read.parquet(f"{tmp_path}/files"), f"{tmp_path}/scans", f"{tmp_path}/c2"
    ).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/scans").count() == 9


def test_open_counts_in_windows(spark, tmp_path):
    schema = "repo string, is_new boolean, auth_required boolean, committed_at timestamp"
    def at(minute):
        return datetime.datetime(2024, 5, 1, 12) + datetime.timedelta(minutes=minute)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.random() < 0.8, rng.random() < 0.4, at(rng.randrange(600))) for _ in range(300)]
    rows += [("a", True, False, None), ("a", None, False, at(5)), ("a", True, None, at(5))]
    late = ("b", True, False, at(-600))
    for part in (rows, [late, ("b", True, False, at(1000))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        open_counts_stream(source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {(r.repo, r.window_start, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = open_counts(spark.createDataFrame(rows, schema))
    assert got == {(r.repo, r.window_start, r.n) for r in table.collect()} and len(got) > 10


def test_counted_report_lines_are_dealt_once(spark):
    """Equal lines are counted by the key of the join that marks the first one, copies as rows."""
    rows = [("r", "/a", "GET", False, "x.py", 1)] * 2 + [("r", "/b", "GET", True, "x.py", 2), ("s", "/c", "GET", False, None, 3)]
    endpoints = spark.createDataFrame(
        rows, "repo string, path string, method string, auth_required boolean, source_file string, line_number int"
    )
    matches = ops.normalize_rows(endpoints).withColumn("status", F.lit("shadow"))
    lines = report.sarif_documents(matches)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(repo" in x and "at#" in x]
    assert dealt and not any("line#" in x for x in dealt)
    got = sorted((r.repo, r.copy, r.line[:2]) for r in lines.filter("section = 1").collect())
    assert got == [("r", 1, ",{"), ("r", 1, ",{"), ("r", 1, '{"'), ("r", 2, ",{"), ("r", 2, ",{"), ("s", 1, ",{"), ("s", 1, '{"')]


def test_report_lines_are_made_once_for_both_readers(spark):
    """The search for first entries reads the counted rows' exchange, which the join needs as it is."""
    rows = [("r", "/a", "GET", False, "x.py", 1), (None, "/b", "GET", True, "x.py", 2)]
    endpoints = spark.createDataFrame(
        rows, "repo string, path string, method string, auth_required boolean, source_file string, line_number int"
    ).filter(F.col("line_number") + F.rand() >= 0)
    matches = ops.normalize_rows(endpoints).withColumn("status", F.lit("shadow"))
    lines = report.sarif_documents(matches, spark.createDataFrame([("r",)], "repo string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(repo" in x and "at#" in x]
    assert sum("ReusedExchange" not in x for x in dealt) == 2 and "ReusedExchange" in plan
    got = sorted((r.repo or "", r.line[:2]) for r in lines.filter("section = 1").collect())
    assert got == [("", ",{"), ("r", ",{"), ("r", '{"')]


def test_written_sarif_logs_are_packed(spark, tmp_path, monkeypatch):
    """The query's documents hold every result, in a fraction of their text's bytes."""
    n = F.col("id")
    spark.range(1500).select(
        n.alias("l_orderkey"), (n * 7 % 400).alias("l_partkey"), (n % 50).alias("l_suppkey"),
        (n % 7).cast("int").alias("l_linenumber"), (n % 50).cast("double").alias("l_quantity"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).select(n.alias("r_regionkey")).write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path))
    counts = queries.sarif_written(spark, str(tmp_path)).collect()
    held = packed = 0
    for row in counts:
        parts = [p.read_bytes() for p in sorted(tmp_path.glob(f"sarif-*/data/attempt=*/repo={row.repo}/part-*"))]
        text = b"".join(map(gzip.decompress, parts))
        results = json.loads(text)["runs"][0]["results"]
        assert len(text.splitlines()) == row.n_lines == len(results) + 2 and row.documents == 1
        held, packed = held + len(text), packed + sum(map(len, parts))
    assert len(counts) > 40 and sum(r.followers for r in counts) > 700 and packed * 3 < held


def test_packed_documents_hold_the_plain_text(spark, tmp_path):
    """Plain and packed batches of a dataset are read alike and replace each other."""
    rows = [(repo, 1, at, copy, f"{at} é,{copy}") for repo in "rs" for at in range(200) for copy in (1, 2)]
    lines = spark.createDataFrame(rows, "repo string, section int, at int, copy int, line string")
    path = str(tmp_path / "docs")
    texts = {}
    for codec in (None, "gzip"):
        append_documents(lines, path, "nightly", compression=codec)
        seen = sorted((r.repo, r.value) for r in read_documents(spark, path).collect())
        assert seen == sorted((r[0], r[4]) for r in rows)
        unpack = gzip.decompress if codec else bytes
        new = {p for p in (tmp_path / "docs").glob("data/attempt=*/repo=*/part-*") if (p.suffix == ".gz") == bool(codec)}
        texts[codec] = {
            repo: b"".join(unpack(p.read_bytes()) for p in sorted(new) if p.parent.name == f"repo={repo}") for repo in "rs"
        }
    assert texts[None] == texts["gzip"] and texts[None]["r"].startswith("0 é,1\n0 é,2\n".encode())
    append_documents(lines.filter("repo = 's'"), path, compression="gzip")
    append_documents(lines.filter("repo = 'r'"), path, "other")
    assert read_documents(spark, path).count() == 1600
