"""End-to-end scans of small source trees."""

import ast

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeledger import scan
from routeledger.operators import python_syntax
from routeledger.plans import corpus
from routeledger.sources import files
from tests.harbor import CRANES, DESK, PILOTS, QUAY, TIDES


def keyed(df):
    return {(r.method, r.path): r for r in df.collect()}


@pytest.fixture(scope="module")
def rows(make_files):
    sources = {
        "tides.py": TIDES, "desk.py": DESK, "Pilots.java": PILOTS,
        "quay.js": QUAY, "cranes.js": CRANES,
    }
    return keyed(scan(make_files(sources)))


def test_routers_of_one_file_keep_their_own_prefix(rows):
    mine = {k: r for k, r in rows.items() if r.source_file == "tides.py"}
    assert {k: r.auth_info for k, r in mine.items()} == {
        ("PUT", "/berths/:berth/lock"): "Decorator dependencies: [Depends(verify_token)]",
        ("DELETE", "/berths/:berth"): None,
        ("GET", "/tides/:port/today"): "Argument keeper default: Depends(verify_token)",
        ("PATCH", "/tides/:port"): None,
        ("HEAD", "/"): None,
    }
    assert [r.line_number for r in mine.values()].count(14) == 1
    assert {r.framework for r in mine.values()} == {"FastAPI"}


def test_flask_methods_and_verbs(rows):
    mine = {k: r for k, r in rows.items() if r.source_file == "desk.py"}
    guarded = {k for k, r in mine.items() if r.auth_required}
    assert guarded == {("PUT", "/crews/:crew"), ("DELETE", "/crews/:crew")}
    assert set(mine) - guarded == {("GET", "/crews"), ("POST", "/notices")}
    assert {r.auth_info for k, r in mine.items() if k in guarded} == {"Flask Decorators: jwt_required"}


def test_the_first_java_class_sets_the_prefix(rows):
    # Annotations of a later class of the file count as those of a method.
    mine = {k: r.auth_info for k, r in rows.items() if r.language == "java"}
    assert mine == {
        ("DELETE", "/pilots/:no"): "annotations: Secured",
        ("PATCH", "/pilots/:no"): None,
        ("GET", "/tugs"): None,
        ("PUT", "/:name/tow"): "annotations: PreAuthorize",
    }


def test_guard_at_the_mount_and_all_verbs(rows):
    mine = {k: r for k, r in rows.items() if r.language == "javascript"}
    below = {k for k, r in mine.items() if r.source_file == "cranes.js"}
    assert below == {("PUT", "/cranes/:crane"), ("DELETE", "/cranes/:crane")}
    assert {mine[k].auth_info for k in below} == {"mount-level middleware on 'cranes'"}
    horn = {k for k, r in mine.items() if k[1] == "/horn" and not r.auth_required}
    assert horn == {(v, "/horn") for v in ("GET", "POST", "PUT", "DELETE", "PATCH")}


def test_a_chain_over_lines_starts_at_its_owner(make_files):
    text = (
        "const locks = express.Router();\n\n"
        "locks.route('/gate/:side')\n"
        "  .patch(\n    ensureAuthenticated(['pilot', 'master']),\n    swing,\n  )\n"
        "  .head(look);\nlocks.delete('/gate', drop);\n"
    )
    found = keyed(scan(make_files({"locks.js": text})))
    assert found["PATCH", "/gate/:side"].auth_required
    assert found["PATCH", "/gate/:side"].line_number == 3
    assert not found["DELETE", "/gate"].auth_required


def test_mount_in_another_file_and_several_verbs(make_files):
    files = {
        "fleet/__init__.py": "fleet = FastAPI()\nfleet.include_router(buoys, prefix='/sea/v9')\n",
        "fleet/buoys.py": "buoys = APIRouter()\n\n"
        "@buoys.api_route('/b/{n}', methods=['PATCH', 'PUT'])\ndef place(n): ...\n",
    }
    assert set(keyed(scan(make_files(files)))) == {("PATCH", "/sea/v9/b/:n"), ("PUT", "/sea/v9/b/:n")}


def test_several_aliases_on_one_route(make_files):
    files = {
        "kit/types.py": "Clock = Annotated[int, Depends(read_clock)]\n"
        "Master = Annotated[str, Depends(get_current_user)]\n",
        "kit/logbook.py": "logbook = APIRouter(prefix='/logbook')\n"
        "@logbook.put('/{day}')\ndef write(day, at: Clock, by: Master): ...\n"
        "@logbook.head('/{day}')\ndef peek(day, at: Clock): ...\n"
        "@logbook.patch('/{day}')\ndef fix(day, by: MasterList): ...\n",
    }
    found = keyed(scan(make_files(files)))
    assert found["PUT", "/logbook/:day"].auth_info == "alias dependency: Master"
    assert not found["HEAD", "/logbook/:day"].auth_required
    assert not found["PATCH", "/logbook/:day"].auth_required


def test_excluded_folders(make_files):
    text = "x = FastAPI()\n@x.delete('/from/{}')\ndef f(): ...\n"
    files = {f"{d}f.py": text.format(n) for n, d in enumerate(("", "pkg/tests/", "a/node_modules/"))}
    assert {p for _, p in keyed(scan(make_files(files)))} == {"/from/0"}
    every = {p for _, p in keyed(scan(make_files(files), excluded=[]))}
    assert every == {"/from/0", "/from/1", "/from/2"}


def test_tree(spark, tmp_path):
    for path, content in {
        "one/api/Main.PY": b"@app.get('/buoys')\ndef f(): ...\n",
        "one/api/logo.png": b"\x89PNG", "one/notes.md": b"@app.get('/no')",
        "one/bad.py": b"x = '\xff'", "one/tests/t.py": b"@app.get('/test')\ndef f(): ...\n",
        "two/w.mjs": b"app.put('/winch', run)\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    tree = files.read_tree(spark, str(tmp_path), excluded=[])
    pruned = files.read_tree(spark, str(tmp_path))
    assert {(r.repo, r.rel_path) for r in tree.exceptAll(pruned).collect()} == {("one", "tests/t.py")}
    assert {(r.repo, r.rel_path) for r in tree.collect()} == {
        ("one", "api/Main.PY"), ("one", "bad.py"), ("one", "tests/t.py"), ("two", "w.mjs")
    }
    assert [r.rel_path for r in files.unreadable(tree).collect()] == ["bad.py"]
    found = {(r.repo, r.method, r.path) for r in scan(tree).collect()}
    assert found == {("one", "GET", "/buoys"), ("two", "PUT", "/winch")}


def test_tests_of_a_query_run_behind_the_spread_of_a_small_table(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    table = corpus.table(spark, str(tmp_path), "part")
    found = table.filter(F.upper("p_name").rlike("7$"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("upper(") < plan.index("Repartition")
    assert found.count() == 5 and table.count() == 50


def test_syntax_leaves_the_worker_in_slices(monkeypatch):
    monkeypatch.setattr(python_syntax, "FILES", 2)
    texts = ["import flask\n@bp.get('/x', dependencies=[a, b])\ndef f(q=Depends(u)):\n    pass\n", "def (", None, "", "x = 1"]
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 5, "rel_path": list("abcde"), "content": texts})
    slices = list(python_syntax._read_batches(iter([batch])))
    assert [s.num_rows for s in slices] == [2, 2, 1]
    rows = [r for s in slices for r in s.to_pylist()]
    assert [r["error"] for r in rows] == [None, "SyntaxError", None, None, None]
    assert rows[0]["modules"] == ["flask"] and rows[0]["functions"][0]["exprs"][0]["text"] == "Depends(u)"


def test_the_walk_keeps_the_order_of_the_nodes_it_yields():
    tree = ast.parse("a = Router(x, prefix='/p')\n@a.get('/q', y)\nasync def f(z: int = Depends(g)): return [z]\n")
    full = [n for n in ast.walk(tree) if not isinstance(n, python_syntax._LEAVES)]
    assert list(python_syntax._walk(tree)) == full
