"""Bracket-aware scanning of call text.

Matching brackets is beyond regular expressions and built-in functions, so these
two run in Arrow batches; they see single matched lines, never whole files.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Verbs that register a route, and identifiers.
JS_VERBS = "get|post|put|delete|patch|options|head|all"
JS_NAME = r"[A-Za-z_$][\w$]*"

_CALLS = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("owner", "verb", "path", "args")]
    )
)
_MARKS = re.compile(r"""'[^']*(?:'|\Z)|"[^"]*(?:"|\Z)|`[^`]*(?:`|\Z)|[()\[\]{},]""")
_CHAIN = re.compile(rf"({JS_NAME})\.route\s*\(\s*(['\"`])([^'\"`]*)\2\s*\)")
_VERB_CALL = re.compile(rf"\.({JS_VERBS})\s*\(")


def split_arguments(text: str) -> list[str]:
    """Split at commas outside brackets and quotes; pieces are stripped."""
    pieces, depth, begin = [], 0, 0
    for mark in _MARKS.finditer(text):
        char = mark.group()
        if char in "([{":
            depth += 1
        elif char in ")]}":
            depth -= 1
        elif char == "," and depth == 0:
            pieces.append(text[begin : mark.start()].strip())
            begin = mark.end()
    last = text[begin:].strip()
    return [*pieces, last] if last else pieces


def inside_parens(text: str, start: int) -> str:
    """Text after the '(' at ``start`` up to its ')', or to the end if unclosed."""
    depth = 0
    for mark in _MARKS.finditer(text, start):
        depth += {"(": 1, ")": -1}.get(mark.group(), 0)
        if mark.group() == ")" and depth == 0:
            return text[start + 1 : mark.start()]
    return text[start + 1 :]


def chained_calls(line: str) -> list[dict]:
    """Verb calls behind each ``x.route('/p')`` of a line."""
    return [
        {
            "owner": chain.group(1),
            "verb": verb.group(1),
            "path": chain.group(3),
            "args": inside_parens(line, verb.end() - 1),
        }
        for chain in _CHAIN.finditer(line)
        for verb in _VERB_CALL.finditer(line, chain.end())
    ]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_arguments_udf(texts: pd.Series) -> pd.Series:
    return texts.map(split_arguments, na_action="ignore")


@F.pandas_udf(_CALLS)
def chained_calls_udf(lines: pd.Series) -> pd.Series:
    return lines.map(chained_calls, na_action="ignore")
