"""Ancestor closure, windows and attribution."""

import random

import pytest
from pyspark.sql import functions as F

from routeledger.operators import joins, provenance
from routeledger.plans import batch


def ancestors(parents, start):
    seen, todo = {start}, [start]
    while todo:
        for p in parents[todo.pop()]:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def random_history(n, seed):
    rng = random.Random(seed)
    parents = {0: []}
    for i in range(1, n):
        first = i - 1 if rng.random() < 0.7 else rng.randrange(i)
        extra = [rng.randrange(i)] if rng.random() < 0.3 else []
        parents[i] = list(dict.fromkeys([first, *extra]))
    return parents


@pytest.fixture(scope="module")
def histories(spark):
    graphs = {"a": random_history(120, 1), "b": random_history(60, 2)}
    graphs["line"] = {i: [i - 1] if i else [] for i in range(100)}
    rows = [
        (repo, str(c), [str(p) for p in ps], f"who{c}", 1000 + c, 1000 + c)
        for repo, graph in graphs.items()
        for c, ps in graph.items()
    ]
    commits = spark.createDataFrame(
        rows,
        "repo string, sha string, parents array<string>, author string, "
        "author_time bigint, commit_time bigint",
    )
    return graphs, commits


@pytest.mark.parametrize("limit", [provenance.GROUP_LIMIT, 0, 110])
def test_reachable_matches_a_plain_walk(spark, histories, limit):
    graphs, commits = histories
    starts = [(r, "head", str(max(g))) for r, g in graphs.items()]
    starts += [(r, "base", str(max(g) // 2)) for r, g in graphs.items()]
    frame = spark.createDataFrame(starts, "repo string, label string, sha string")
    found = provenance.reachable(commits, frame, limit)
    got = {(r.repo, r.label, r.sha) for r in found.collect()}
    want = {
        (repo, label, str(c))
        for repo, label, sha in starts
        for c in ancestors(graphs[repo], int(sha))
    }
    assert got == want


def test_windows(spark, histories):
    graphs, commits = histories
    head = spark.createDataFrame([("line", "HEAD", "90")], "repo string, name string, sha string")
    base = spark.createDataFrame([("line", "v1", "85")], "repo string, name string, sha string")
    since_ref = provenance.commits_since_ref(commits, head, base)
    assert {r.sha for r in since_ref.collect()} == {"86", "87", "88", "89", "90"}
    since = provenance.commits_since_date(commits, head, F.timestamp_seconds(F.lit(1088)))
    assert {r.sha for r in since.collect()} == {"88", "89", "90"}


def test_annotate(spark):
    endpoints = spark.createDataFrame(
        [
            ("r", "/a", "GET", False, "app.py", 3),
            ("r", "/b", "GET", True, "app.py", 5),
            ("r", "/c", "GET", False, "new.py", 3),
            ("r", "/d", "GET", False, "app.js", 0),
        ],
        "repo string, path string, method string, auth_required boolean, "
        "source_file string, line_number int",
    )
    new, old = "a" * 40, "b" * 40
    blame = spark.createDataFrame(
        [("r", "svc/app.py", 3, new), ("r", "svc/app.py", 5, old), ("r", "svc/new.py", 3, new)],
        "repo string, path string, line int, sha string",
    )
    commits = spark.createDataFrame(
        [("r", new, "Ann", 86400), ("r", old, "Bo", 0)],
        "repo string, sha string, author string, author_time bigint",
    )
    window = commits.filter(F.col("sha") == new).select("repo", "sha")
    added = spark.createDataFrame([("r", "svc/new.py")], "repo string, path string")
    rows = {
        r.path: r
        for r in provenance.annotate(endpoints, blame, commits, window, added, "svc").collect()
    }
    assert rows["/a"].is_new and rows["/a"].change_type == "modified"
    assert rows["/a"].commit == "a" * 10 and rows["/a"].author == "Ann"
    assert rows["/a"].committed_at.isoformat() == "1970-01-02T00:00:00"
    assert not rows["/b"].is_new and rows["/b"].commit is None
    assert rows["/c"].change_type == "added"
    assert not rows["/d"].is_new


def test_relative_window():
    assert provenance._RELATIVE.match("1 week ago").groups() == ("1", "week")
    assert provenance._RELATIVE.match("2024-01-01") is None


def test_window_of_each_repo(spark):
    """A tag that looks like a date counts where it exists; elsewhere it is the date."""
    schema = "repo string, sha string, parents array<string>, commit_time bigint"
    commits = spark.createDataFrame(
        [(r, str(n), [str(n - 1)] if n else [], 946684800 + n - 2) for r in "pq" for n in range(5)], schema
    )
    refs = spark.createDataFrame(
        [("p", "HEAD", "4"), ("q", "HEAD", "4"), ("p", "2000-01-01", "3")],
        "repo string, name string, sha string",
    )
    changes = spark.createDataFrame(
        [("q", "3", "n.py", "A"), ("q", "0", "o.py", "A")],
        "repo string, sha string, path string, change string",
    )
    listed = spark.createDataFrame(
        [("p", "HEAD", "a.py"), ("p", "HEAD", "b.py"), ("p", "2000-01-01", "a.py"), ("q", "HEAD", "o.py")],
        "repo string, ref string, path string",
    )
    history = {"commits": commits, "refs": refs, "file_changes": changes, "ref_files": listed}
    window, added = batch.window_commits(history, "2000-01-01")
    assert {(r.repo, r.sha) for r in window.collect()} == {("p", "4"), ("q", "2"), ("q", "3"), ("q", "4")}
    assert {(r.repo, r.path) for r in added.collect()} == {("p", "b.py"), ("q", "n.py")}
    assert batch.window_rejects(history, "2000-01-01").count() == 0
    refs = refs.replace("2000-01-01", "v1")
    assert [r.repo for r in batch.window_rejects(history | {"refs": refs}, "v1").collect()] == ["q"]


def test_scan_root_of_each_repo(spark):
    endpoints = spark.createDataFrame(
        [("r", "a.py", 1, "GET"), ("s", "a.py", 1, "GET")],
        "repo string, source_file string, line_number int, method string",
    )
    blame = spark.createDataFrame(
        [("r", "svc/a.py", 1, "x"), ("s", "a.py", 1, "x")], "repo string, path string, line int, sha string"
    )
    commits = spark.createDataFrame(
        [("r", "x", "Ann", 0), ("s", "x", "Bo", 0)], "repo string, sha string, author string, author_time bigint"
    )
    added = spark.createDataFrame([], "repo string, path string")
    roots = spark.createDataFrame([("r", "svc/")], "repo string, scan_root string")
    found = provenance.annotate(endpoints, blame, commits, commits.select("repo", "sha"), added, roots)
    assert {(r.repo, r.is_new) for r in found.collect()} == {("r", True), ("s", True)}


def test_a_long_history_shrinks_to_its_limit(spark, monkeypatch):
    """Runs, merged branches and dead ends are merged away, so no large history needs chains."""
    def chains(*_):
        raise AssertionError("not contracted")

    monkeypatch.setattr(provenance, "_reachable_by_chains", chains)
    graph = {0: []}
    for i in range(1, 2000):
        # Every fourth commit is a branch of one; every fifth branch is never merged.
        merges = [i - 1] if i % 4 == 0 and (i - 1) % 20 != 19 else []
        graph[i] = [i - 2, *merges] if i % 4 == 0 else [i - 1]
    rows = [("long", f"s{c}", [f"s{p}" for p in ps]) for c, ps in graph.items()]
    # A repo without a start, a row that comes twice and one without parents take part.
    rows += [("idle", f"s{c}", [f"s{p}" for p in ps]) for c, ps in graph.items()]
    rows += [rows[7], ("long", "apart", None)]
    commits = spark.createDataFrame(rows, "repo string, sha string, parents array<string>")
    starts = [("long", "head", 1998), ("long", "base", 1000), ("long", "base", 1003)]
    frame = spark.createDataFrame(
        [(r, label, f"s{c}") for r, label, c in starts], "repo string, label string, sha string"
    )
    found = [(r.label, r.sha) for r in provenance.reachable(commits, frame, 100).collect()]
    want = {(label, f"s{c}") for _, label, start in starts for c in ancestors(graph, start)}
    assert len(found) == len(want) and set(found) == want


def test_a_costly_left_side_is_worked_out_once(spark, monkeypatch):
    """On the way without a broadcast the left side is counted, spread and joined."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    left = spark.range(40).selectExpr("id % 4 AS k", "id").mapInArrow(pass_on, "k bigint, id bigint")
    right = spark.range(3).selectExpr("id AS k")
    found = joins.lookup(left, right, ["k"], "left_semi", spread=["id"], costly=True)
    assert sorted(r.id for r in found.collect()) == [n for n in range(40) if n % 4 < 3]
    assert seen.value == 40
