"""Redaction of tokens, assigned secrets and e-mail addresses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, WORD, WORD_EDGE, bind

# The three patterns and their replacement texts, in order of use.
JWT = (
    rf"{WORD_EDGE}ey[A-Za-z0-9\-_=]+\.ey[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_.+/=]*{WORD_EDGE}"
)
CREDENTIAL_NAMES = [
    "api_key", "secret", "password", "passwd", "token", "private_key", "credential",
]
CREDENTIAL = (
    rf"(?iu)(?<!{WORD})({WORD}*"
    rf"(?:{'|'.join(CREDENTIAL_NAMES)})"
    rf"{WORD}*+{SPACE}*+[:=]{SPACE}*+['\"])([^'\"]{{4,}})(['\"])"
)
EMAIL = rf"{WORD_EDGE}[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+{WORD_EDGE}"
JWT_MARK = "[REDACTED_JWT]"
SECRET_MARK = "[REDACTED_SECRET]"
EMAIL_MARK = "[REDACTED_EMAIL]"

_ASSIGNED = rf"[:=]{SPACE}*+['\"]"
# A credential without the start of its key: found in one pass, with no word starts tried.
_ASSIGNMENT = (
    rf"(?iu)(?:{'|'.join(CREDENTIAL_NAMES)})"
    rf"{WORD}*+{SPACE}*+[:=]{SPACE}*+['\"][^'\"]{{4,}}['\"]"
)

# Noncharacters that frame the pieces of a match; they never occur in real text.
_OPEN, _VALUE, _QUOTE, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def _redact_credentials(text: Column) -> Column:
    """Replace the assigned value wherever it occurs inside its own match.

    The value may also be part of the key (``secret = 'secret'``), so a plain
    group replacement is not enough: matches are framed, split off and replaced
    one by one.
    """
    framed = F.regexp_replace(
        text, CREDENTIAL, f"{_OPEN}$1{_VALUE}$2{_QUOTE}$3{_CLOSE}"
    )

    def replace_in(piece: Column) -> Column:
        value = F.substring_index(F.substring_index(piece, _QUOTE, 1), _VALUE, -1)
        match = F.translate(
            F.substring_index(piece, _CLOSE, 1), _VALUE + _QUOTE, ""
        )
        rest = F.substring_index(piece, _CLOSE, -1)
        return F.concat(F.replace(match, value, F.lit(SECRET_MARK)), rest)

    exact = bind(
        F.split(framed, _OPEN),
        lambda pieces: F.concat(
            F.element_at(pieces, 1),
            F.array_join(
                F.transform(F.slice(pieces, 2, F.size(pieces)), replace_in), ""
            ),
        ),
    )
    simple = F.regexp_replace(text, CREDENTIAL, rf"$1{SECRET_MARK}$3")
    return F.when(text.rlike(f"[{_OPEN}-{_CLOSE}]"), simple).otherwise(exact)


def _redact_tokens(text: Column) -> Column:
    return F.when(text.contains(".ey"), F.regexp_replace(text, JWT, JWT_MARK)).otherwise(text)


def _redact_secrets(text: Column) -> Column:
    # Upper first: it folds the long s, which case-insensitive matching accepts as s.
    named = bind(
        F.lower(F.upper(text)),
        lambda folded: reduce(or_, [F.contains(folded, F.lit(k)) for k in CREDENTIAL_NAMES]),
    )
    suspect = text.rlike(_ASSIGNED) & named & text.rlike(_ASSIGNMENT)
    return F.when(suspect, _redact_credentials(text)).otherwise(text)


def _redact_addresses(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL, EMAIL_MARK)).otherwise(text)


def redact_text(text: Column) -> Column:
    """Tokens, then assigned secrets, then addresses; the order decides overlaps.

    Each step is guarded by the cheapest test that every match must pass (a byte
    search where the pattern holds a literal), so clean text is scanned, not matched.
    """
    return bind(
        _redact_tokens(text), lambda a: bind(_redact_secrets(a), _redact_addresses)
    )


def redact_value(value: Column, dtype: T.DataType) -> Column:
    """Redact every string inside a nested value; keys and other types are kept."""
    if isinstance(dtype, T.StringType):
        return redact_text(value)
    if isinstance(dtype, T.ArrayType) and _has_text(dtype.elementType):
        return F.transform(value, lambda x: redact_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_text(dtype.valueType):
        return F.transform_values(value, lambda _, v: redact_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_text(dtype):
        rebuilt = F.struct(
            *[
                redact_value(value.getField(f.name), f.dataType).alias(f.name)
                for f in dtype.fields
            ]
        )
        return F.when(value.isNotNull(), rebuilt)
    return value


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    return False


def redact_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Redact all (or the named) columns of a frame, whatever their nesting."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[
            redact_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            if f.name in chosen
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
