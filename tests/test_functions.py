"""Column functions against literals and against plain Python on random input."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeledger.functions import brackets
from routeledger.functions.auth import AuthRules
from routeledger.functions.paths import normalize_path, path_shape
from routeledger.functions.redact import redact_frame, redact_text
from routeledger.operators.logical_lines import logical_lines
from routeledger.sources.config import read_config_json, resolve_config


def values(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_path(spark):
    cases = {
        "/users/{id}": "/users/:id",
        "/users/<int:id>": "/users/:id",
        "/users/<name>": "/users/:name",
        "/users/{id}/profile/": "/users/:id/profile",
        "/": "/",
        "": "/",
        "//": "/",
        "///a//": "///a",
        "a/b": "/a/b",
        "/{f:path}": "/{f:path}",
        "/{größe}": "/:größe",
        None: "/",
    }
    assert values(spark, normalize_path, cases) == list(cases.values())
    again = values(spark, normalize_path, cases.values())
    assert again == list(cases.values())


def test_path_shape(spark):
    assert values(spark, path_shape, ["/a/{b}/<int:c>", "/x:y/:z"]) == ["/a/:{}/:{}", "/x:{}/:{}"]


def test_redaction_literals(spark):
    cases = {
        "key api_key='super-key-999' end": "key api_key='[REDACTED_SECRET]' end",
        "eyJhbGciOi.eyJzdWIi.abc": "[REDACTED_JWT]",
        "ask a.b+c@acme.co.uk now": "ask [REDACTED_EMAIL] now",
        'token = "eyJhbGciOi.eyJzdWIi.abc"': 'token = "[REDACTED_SECRET]"',
        "my_word_secret: 'word'": "my_[REDACTED_SECRET]_secret: '[REDACTED_SECRET]'",
        "PASSWORD=\"abcd\" x Token : 'wxyz'": "PASSWORD=\"[REDACTED_SECRET]\" x Token : '[REDACTED_SECRET]'",
        "token_type": "token_type",
        "secret='abc'": "secret='abc'",
        "plain": "plain",
        None: None,
    }
    assert values(spark, redact_text, cases) == list(cases.values())


def test_redaction_of_nested_values(spark):
    row = {
        "meta": {"token": "eyJhbGciOi.eyJzdWIi.xyz"},
        "mails": ["a@b.co", None],
        "inner": {"n": 42, "text": "secret_key = 'hidden-one'"},
    }
    frame = spark.createDataFrame(
        [row], "meta map<string,string>, mails array<string>, inner struct<n:int,text:string>"
    )
    clean = redact_frame(frame).first()
    assert clean.meta == {"token": "[REDACTED_JWT]"}
    assert clean.mails == ["[REDACTED_EMAIL]", None]
    assert clean.inner.n == 42 and clean.inner.text == "secret_key = '[REDACTED_SECRET]'"


def test_custom_keywords(spark):
    only = AuthRules(["gatekeeper"], [], [], [])
    found = values(spark, only.keyword, ["gatekeeper_required", "login_required", "", None])
    assert found == [True, False, False, False]


def test_config_extend_and_replace(spark):
    texts = [
        ("a", '{"auth": {"extend_keywords": ["gatekeeper"]}}'),
        ("b", '{"keywords": ["x"], "extend_keywords": ["y"]}'),
    ]
    configs = spark.createDataFrame(texts, "repo string, config_json string")
    rows = {r.repo: r.keywords for r in resolve_config(read_config_json(configs)).collect()}
    assert {"gatekeeper", "jwt"} <= set(rows["a"])
    assert rows["b"] == ["x"]


def walk_lines(text, fluent):
    """The sequential definition of logical lines."""
    lines = re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text)
    if lines[-1] == "":
        lines.pop()
    out = []
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        delta = line.count("(") - line.count(")")
        if out and out[-1][2] > 0:
            start, body, balance = out.pop()
            out.append((start, body + " " + bare, balance + delta))
        elif out and fluent and bare.startswith("."):
            start, body, balance = out.pop()
            out.append((start, body.rstrip() + bare, balance + delta))
        else:
            out.append((number, line, delta))
    return [(start, body.strip()) for start, body, _ in out]


@pytest.mark.parametrize("fluent", [False, True])
def test_logical_lines_match_the_sequential_walk(spark, fluent):
    rng = random.Random(7)
    pieces = ["(", ")", "a", " ", "\n", "\n", ".", "\r\n", "\t", "\x0c", "é", "\n."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(400)]
    files = spark.createDataFrame(
        [("r", str(i), t) for i, t in enumerate(texts)], "repo string, rel_path string, content string"
    )
    got = {}
    for r in logical_lines(files, fluent).collect():
        got.setdefault(int(r.rel_path), []).append((r.start_line, r.text))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == walk_lines(text, fluent), repr(text)


def walk_arguments(text):
    out, depth, quote, buffer = [], 0, "", ""
    for char in text:
        if quote:
            quote = "" if char == quote else quote
        elif char in "'\"`":
            quote = char
        elif char in "([{":
            depth += 1
        elif char in ")]}":
            depth -= 1
        elif char == "," and depth == 0:
            out.append(buffer.strip())
            buffer = ""
            continue
        buffer += char
    return out + [buffer.strip()] if buffer.strip() else out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab,'\"`()[]{} \n", max_size=30))
def test_split_arguments(text):
    assert brackets.split_arguments(text) == walk_arguments(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab,'\"()", max_size=30))
def test_inside_parens(text):
    depth, quote, want = 0, "", text
    for i, char in enumerate("(" + text):
        if quote:
            quote = "" if char == quote else quote
        elif char in "'\"`":
            quote = char
        else:
            depth += {"(": 1, ")": -1}.get(char, 0)
            if char == ")" and depth == 0:
                want = text[: i - 1]
                break
    assert brackets.inside_parens("(" + text, 0) == want


@pytest.mark.parametrize("limit", [32 * 1024 * 1024, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_is_the_same_on_both_paths(spark, monkeypatch, limit, how):
    from routeledger.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    left = spark.range(300).selectExpr("if(id < 100, 'hot', cast(id AS string)) AS k", "id")
    right = spark.createDataFrame([("hot", 1), ("150", 2), ("x", 3)], "k string, v int")
    got = joins.lookup(left, right, ["k"], how, spread=["id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
