"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

ENDPOINTS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("auth_required", T.BooleanType()),
        T.StructField("auth_info", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("framework", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("committed_at", T.TimestampType()),
    ]
)

ENDPOINT_COLUMNS = ENDPOINTS.fieldNames()

# What the Python syntax reader returns: one row per file, nested, no rules applied.
_TEXT = T.StringType()
_PAIRS = T.ArrayType(
    T.StructType([T.StructField("name", _TEXT), T.StructField("value", _TEXT)])
)
PYTHON_SYNTAX = T.StructType(
    [
        T.StructField("repo", _TEXT),
        T.StructField("rel_path", _TEXT),
        T.StructField("error", _TEXT),
        T.StructField("modules", T.ArrayType(_TEXT)),
        T.StructField(
            "mounts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("call", _TEXT),
                        T.StructField("target", _TEXT),
                        T.StructField("constants", _PAIRS),
                    ]
                )
            ),
        ),
        T.StructField(
            "assigns",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("target", _TEXT),
                        T.StructField("callee", _TEXT),
                        T.StructField("text", _TEXT),
                        T.StructField("constants", _PAIRS),
                    ]
                )
            ),
        ),
        T.StructField(
            "functions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("line", T.IntegerType()),
                        T.StructField(
                            "exprs",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("param", _TEXT),
                                        T.StructField("slot", _TEXT),
                                        T.StructField("text", _TEXT),
                                    ]
                                )
                            ),
                        ),
                        T.StructField(
                            "decorators",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("caller", _TEXT),
                                        T.StructField("attr", _TEXT),
                                        T.StructField("path", _TEXT),
                                        T.StructField("methods", T.ArrayType(_TEXT)),
                                        T.StructField("dependencies", _TEXT),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
