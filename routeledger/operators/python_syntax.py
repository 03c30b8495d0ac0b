"""Reads Python files into plain syntax rows; the rules are applied later, in Spark.

This is the only part of the Python path that runs in Python workers: the standard
library parses the text (it is never executed) and each node of interest becomes
plain data.
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.auth import DEPENDENCY_CALLABLES
from ..schemas import PYTHON_SYNTAX

# The calls that mount a router and the classes that build one.
MOUNT_CALLS = ("register_blueprint", "include_router")
ROUTER_CLASSES = ("APIRouter", "Blueprint")

FILES = 256  # files read before their rows leave the worker

# Nodes without a child that a rule could read.
_LEAVES = (ast.Constant, ast.Name, ast.expr_context, ast.operator, ast.cmpop, ast.alias)


def _dotted(node: ast.AST) -> str | None:
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names)) or None


def _text(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except (ValueError, RecursionError):
        return ""


def _constants(call: ast.Call) -> list[dict]:
    return [
        {"name": k.arg, "value": str(k.value.value)}
        for k in call.keywords
        if isinstance(k.value, ast.Constant)
    ]


def _decorator(node: ast.expr) -> dict:
    call = node if isinstance(node, ast.Call) else None
    target = call.func if call else node
    row = dict.fromkeys(("caller", "attr", "path", "methods", "dependencies"))
    if isinstance(target, ast.Attribute):
        row["caller"], row["attr"] = _dotted(target.value), target.attr
    elif isinstance(target, ast.Name):
        row["attr"] = target.id
    if call is None:
        return row
    named = {k.arg: k.value for k in call.keywords}
    places = call.args[:1] or [
        k.value for k in call.keywords if k.arg in ("path", "rule")
    ]
    texts = [str(p.value) for p in places if isinstance(p, ast.Constant)]
    row["path"] = texts[-1] if texts else None
    listed = named.get("methods")
    if isinstance(listed, (ast.List, ast.Set, ast.Tuple)):
        row["methods"] = [str(e.value) for e in listed.elts if isinstance(e, ast.Constant)]
    elif isinstance(listed, ast.Constant):
        row["methods"] = [str(listed.value)]
    if "dependencies" in named:
        row["dependencies"] = _text(named["dependencies"])
    return row


def _signature(args: ast.arguments) -> list[dict]:
    """Annotations first, then defaults, each with the parameter it belongs to."""
    annotated = [a for a in args.args + args.posonlyargs + args.kwonlyargs if a.annotation]
    positional = args.posonlyargs + args.args
    paired = list(zip(reversed(positional), reversed(args.defaults)))[::-1]
    paired += [(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults) if d]
    found = [(a.arg, "annotation", a.annotation) for a in annotated]
    found += [(a.arg, "default", d) for a, d in paired]
    return [{"param": p, "slot": s, "text": _text(n)} for p, s, n in found]


def _walk(tree: ast.AST) -> Iterator[ast.AST]:
    """``ast.walk`` without the leaves, which are most nodes: the same breadth-first order."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                todo.extend([x for x in value if isinstance(x, ast.AST) and not isinstance(x, _LEAVES)])
            elif isinstance(value, ast.AST) and not isinstance(value, _LEAVES):
                todo.append(value)
        yield node


def read_syntax(content: str) -> dict:
    """Syntax of one file in breadth-first order; ``error`` is set if unreadable."""
    row: dict = {"error": None, "modules": [], "mounts": [], "assigns": [], "functions": []}
    can_alias = not content.isascii() or any(c in content for c in DEPENDENCY_CALLABLES)
    try:
        for node in _walk(ast.parse(content)):
            match node:
                case ast.Import():
                    row["modules"] += [n.name for n in node.names]
                case ast.ImportFrom(module=str(module)):
                    row["modules"].append(module)
                case ast.Call(func=ast.Attribute(attr=name), args=[first, *_]) if (
                    name in MOUNT_CALLS
                ):
                    row["mounts"].append(
                        {"call": name, "target": _dotted(first), "constants": _constants(node)}
                    )
                case ast.Assign(
                    targets=[ast.Name(id=target)], value=ast.Call() | ast.Subscript() as value
                ):
                    is_call = isinstance(value, ast.Call)
                    callee = (_dotted(value.func) or "") if is_call else ""
                    text = _text(value) if can_alias else ""
                    is_router = callee.endswith(ROUTER_CLASSES)
                    if is_router or any(c in text for c in DEPENDENCY_CALLABLES):
                        row["assigns"].append(
                            {
                                "target": target,
                                "callee": callee,
                                "text": text,
                                "constants": _constants(value) if is_router else [],
                            }
                        )
                case ast.FunctionDef() | ast.AsyncFunctionDef() if node.decorator_list:
                    row["functions"].append(
                        {
                            "line": node.lineno,
                            "exprs": _signature(node.args),
                            "decorators": [_decorator(d) for d in node.decorator_list],
                        }
                    )
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        empty = dict.fromkeys(row, [])
        return {**empty, "error": type(e).__name__}
    return row


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(PYTHON_SYNTAX)
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            rows = [
                {"repo": f["repo"], "rel_path": f["rel_path"], **read_syntax(f["content"] or "")}
                for f in batch.slice(at, FILES).to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def python_syntax(files: DataFrame) -> DataFrame:
    """One nested row per Python file. Narrow: no shuffle, the text goes no further.

    A worker holds the syntax of ``FILES`` files, however many its task has.
    """
    return files.select("repo", "rel_path", "content").mapInArrow(
        _read_batches, PYTHON_SYNTAX
    )


def may_matter(content):
    """Files that can hold a route, a mount or an alias (a superset, cheap to test).

    Identifiers in non-ASCII spelling are normalised by the parser, so files with
    such characters always pass.
    """
    verb = r"(?i)get|post|put|delete|patch|options|head|route"
    return (
        (content.contains("@") & content.rlike(verb))
        | content.rlike("include_router|register_blueprint|Depends|Security")
        | content.rlike(r"[^\x00-\x7f]")
    )


def parse_errors(syntax: DataFrame) -> DataFrame:
    return syntax.filter(F.col("error").isNotNull()).select(
        "repo", "rel_path", F.col("error").alias("reason")
    )
