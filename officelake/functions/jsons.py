"""JSON decoding, typing and canonical hashing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The two accepted forms of a model's JSON answer.
FENCED = r"(?s)^```(?: *json)?\s*\n(.*)\n```\s*$"
BARE = r'(?s)^\s*(["{\[0-9].*["}\]0-9])\s*$'


def json_text(answer: Column) -> Column:
    """The JSON part of an answer that is one fenced block or bare JSON, else null."""
    fenced = F.when(answer.rlike(FENCED), F.regexp_extract(answer, FENCED, 1))
    bare = F.when(answer.rlike(BARE), F.regexp_extract(answer, BARE, 1))
    return F.coalesce(fenced, bare)


def decode_json(answer: Column) -> Column:
    """The answer as a variant in struct<value, error>."""
    text = json_text(answer)
    value = F.try_parse_json(text)
    error = F.when(text.isNull(), "JSON is not in known format").when(value.isNull(), "Could not parse result.")
    return F.struct(value.alias("value"), F.when(answer.isNotNull(), error).alias("error"))


_CORRUPT = "_corrupt"


def parsed(text: Column, schema: T.StructType) -> Column:
    """JSON text as a struct of the schema with one more field, which holds a text that does not fit."""
    full = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def checked(row: Column, schema: T.StructType, required: list[str] = []) -> Column:
    """What ``parsed`` gave as struct<value, error>; it uses ``row`` several times."""
    missing = F.array_compact(F.array(*[F.when(row[name].isNull(), F.lit(name)) for name in required]))
    missing = missing.cast("array<string>")
    error = (
        F.when(row.isNull() | row[_CORRUPT].isNotNull(), F.lit("not an object of the expected type"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    )
    value = F.struct(*[row[f.name].alias(f.name) for f in schema.fields])
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def typed(text: Column, schema: T.StructType, required: list[str] = []) -> Column:
    """JSON text as a typed struct in struct<value, error>; unknown fields are dropped."""
    return checked(parsed(text, schema), schema, required)


def plain(c: Column, kind: T.DataType, as_set: bool = False) -> Column:
    """A value in JSON-able form: times as UTC ``…Z`` text, dates as text, sets as sorted arrays."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.StructType):
        return F.when(
            c.isNotNull(), F.struct(*[plain(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        )
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: plain(x, kind.elementType))
        return F.array_sort(F.array_distinct(items)) if as_set else items
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: plain(v, kind.valueType))
    if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
        return c
    raise TypeError(f"no JSON form for {kind.simpleString()}")


@F.pandas_udf(T.StringType())
def _quote_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else json.dumps(s))


def json_quote(c: Column) -> Column:
    """A JSON string literal with every non-ASCII character escaped.

    Printable ASCII is quoted natively; only other rows reach Python (it gets null for the rest).
    """
    simple = c.rlike(r"^[\x20-\x7E\n\r\t]*$")
    native = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return F.when(simple, native).otherwise(_quote_any(F.when(~simple, c)))


def call_text(args: list[Column], kwargs: dict[str, Column] | None = None) -> Column:
    """The canonical text of a call. ``args`` and ``kwargs`` are columns holding JSON text already."""
    listed = F.concat_ws(", ", *args) if args else F.lit("")
    named = [F.concat(F.lit(json.dumps(k) + ": "), v) for k, v in sorted((kwargs or {}).items())]
    pairs = F.concat_ws(", ", *named) if named else F.lit("")
    return F.concat(F.lit('{"args": ['), listed, F.lit('], "kwargs": {'), pairs, F.lit("}}"))


def call_hash(args: list[Column], kwargs: dict[str, Column] | None = None) -> Column:
    """Key of a call in the result cache."""
    return F.md5(call_text(args, kwargs))


def encode_list(c: Column) -> Column:
    """A list column as JSON text; null stays null."""
    return F.to_json(c)


def decode_list(c: Column, element: str = "string") -> Column:
    """JSON text as a list column; null stays null."""
    return F.from_json(c, f"array<{element}>")
