"""Folder trees: what is listed, what is opened, what is read."""

import os

from routeledger.sources import files, trees


def build(root, names):
    for name, content in names.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(content)


def test_excluded_folders_are_never_opened(spark, tmp_path):
    root = str(tmp_path / "work tree")
    build(root, {
        "a/src/x.py": b"one", "a/src/deep/er/Y.JAVA": "zwö".encode(), "b/m.mjs": b"", "b/README.md": b"no",
        "b/bad.ts": b"\xff\xfe", "a/src/tests/t.py": b"no", "node_modules/p/i.js": b"no", "top.py": b"top",
        "a/.git/hooks/h.py": b"no", "c/buildings/k.py": b"kept",
    })
    # Opening a pipe would wait for ever, and so would a walk around a linked folder.
    os.mkfifo(f"{root}/a/src/tests/pipe.py")
    os.symlink(root, f"{root}/a/again")
    os.symlink(f"{root}/nowhere", f"{root}/b/gone.py")
    listed = {r.rel_path: r.bytes for r in trees.list_tree(spark, root).collect()}
    assert set(listed) - {"b/gone.py"} == {
        "a/src/x.py", "a/src/deep/er/Y.JAVA", "b/m.mjs", "b/bad.ts", "top.py", "c/buildings/k.py",
    }
    found = {(r.repo, r.rel_path): r.content for r in files.read_tree(spark, root).collect()}
    assert found["a", "src/x.py"] == "one" and found["a", "src/deep/er/Y.JAVA"] == "zwö"
    assert found["b", "m.mjs"] == "" and found["b", "bad.ts"] is None
    own = files.read_tree(spark, f"file://{root}/a/src".replace(" ", "%20"), "mine", excluded=["tests", "er"])
    assert [(r.repo, r.rel_path) for r in own.collect()] == [("mine", "x.py")]


def test_trees_without_files(spark, tmp_path):
    assert trees.list_tree(spark, str(tmp_path / "missing")).count() == 0
    assert files.read_tree(spark, str(tmp_path)).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [(f"r{k % 3}/d{k}/f.py", f"text {k}\r\n" * k) for k in range(40)] + [("r0/none.py", None)]
    written = spark.createDataFrame(rows, "rel_path string, content string")
    assert trees.write_files(written, f"{tmp_path}/t") == 40
    back = {f"{r.repo}/{r.rel_path}": r.content for r in files.read_tree(spark, f"{tmp_path}/t").collect()}
    assert back == dict(rows[:-1])
