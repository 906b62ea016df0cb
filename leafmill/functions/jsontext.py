"""JSON documents kept as text and opened one level at a time.

A level is a ``map<string,string>`` whose order is the source order; nested
values stay JSON text until somebody asks for them.
"""

from __future__ import annotations

import json
import secrets

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.specshape import is_renderable

OBJECT = "map<string,string>"
OBJECT_LIST = "array<map<string,string>>"


#: No limit of its own: a value may be as long and as deep as the text that holds it.
PARSER = {
    "maxStringLen": "2147483647",
    "maxNestingDepth": "2147483647",
    "maxNumLen": "2147483647",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "true",
}


def parsed(c: Column, kind: str) -> Column:
    """``from_json`` for text that ``checked`` lets pass."""
    return F.from_json(c, kind, PARSER)


def as_object(c: Column) -> Column:
    """One level of an object; NULL for anything that is not an object."""
    return parsed(c, OBJECT)


def entries(c: Column) -> Column:
    """Ordered ``array<struct<key,value>>`` of an object given as text."""
    return F.coalesce(F.map_entries(as_object(c)), F.array().cast("array<struct<key:string,value:string>>"))


#: A string that no text holds: made anew in every driver.
MARK = secrets.token_hex(16)
#: Digits at which Python's parser gives an integer up.
INT_DIGITS = 4300
#: Values of Jackson's that JSON texts do not have, outside of strings.
FOREIGN = ["INF", "+I", "+N"]


def _bare(c: Column) -> Column:
    """A JSON text without its strings; neither pattern backtracks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\\.", ""), r'"[^"]*+"', "")


def checked(c: Column) -> Column:
    """The text if all of it is one JSON value, else NULL, without a Python worker.

    One object holds the text twice, in a list and behind a key, each time followed by a
    member whose value is ``MARK``, which no text knows. After its first value, a list takes
    a comma and a value, an object a comma, a key and a colon; so a text that fits both places
    is one value and nothing else, and one that leaves a string or bracket open, or closes one
    too many, hides a mark. The parser walks over the text without copying it.

    NaN and infinities count; single quotes, raw control characters and trailing text
    do not. As in Python, an integer of more than ``INT_DIGITS`` digits is no value. Nesting
    has no limit.
    """
    held = F.concat(F.lit('{"v":['), c, F.lit(f'],"m":"{MARK}1","w":{{"k":'), c, F.lit(f'}},"n":"{MARK}2"}}'))
    both = F.struct(F.lit(f"{MARK}1").alias("m"), F.lit(f"{MARK}2").alias("n"))
    foreign = F.lit(False)
    for name in FOREIGN:
        foreign = foreign | (F.contains(c, F.lit(name)) & F.contains(_bare(c), F.lit(name)))
    digits = rf"[0-9]{{{INT_DIGITS + 1}}}"
    long_integer = c.rlike(digits) & _bare(c).rlike(rf"(?<![0-9.eE+]|[eE]-){digits}[0-9]*+(?![.eE])")
    long_integer = (F.octet_length(c) > INT_DIGITS) & long_integer
    return F.when(parsed(held, "struct<m:string,n:string>").eqNullSafe(both) & ~foreign & ~long_integer, c)


def keyed(c: Column, keys: list[str]) -> Column:
    """Whether a text that ``checked`` lets pass is an object with one of ``keys`` at the top.

    The keys are put before the object's own members with ``MARK`` in their value. A later
    member of the same name takes its place, or does not fit its type and is reported;
    other members are walked over. A text that spells no key, with escapes or without, is
    not parsed.
    """
    spelled = F.contains(c, F.lit("\\u"))
    for k in keys:
        spelled = spelled | F.contains(c, F.lit(json.dumps(k)))
    given = "{" + "".join(f'{json.dumps(k)}:{{"s":"{MARK}"}},' for k in keys)
    kind = "struct<" + "".join(f"`{k}`:struct<s:string>," for k in keys) + "_misfit:string>"
    fresh = F.struct(*[F.struct(F.lit(MARK).alias("s")).alias(k) for k in keys], F.lit(None).cast("string").alias("_misfit"))
    own = F.substr(F.ltrim(c, F.lit(" \t\r\n")), F.lit(2))
    seen = F.from_json(F.concat(F.lit(given), own), kind, {**PARSER, "columnNameOfCorruptRecord": "_misfit"})
    return F.coalesce(c.rlike(r"\A[ \t\r\n]*+\{[ \t\r\n]*+[^ \t\r\n}]") & spelled & ~seen.eqNullSafe(fresh), F.lit(False))


def renderable(c: Column) -> Column:
    """Whether a text is an object of the shape a specification needs, in Arrow batches."""

    @F.arrow_udf("boolean")
    def check(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            try:
                value = json.loads(text.as_py()) if text.is_valid else None
            except (ValueError, RecursionError):
                value = None
            rows.append(isinstance(value, dict) and is_renderable(value))
        return pa.array(rows, pa.bool_())

    return check(c)


def has_any_key(c: Column, keys: list[str]) -> Column:
    """A whole JSON text that is an object with one of ``keys`` at the top."""
    return checked(c).isNotNull() & keyed(c, keys)


def has(obj: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(obj, key), F.lit(False))


def get(obj: Column, key: str, default: str | Column) -> Column:
    """Value with a default for a missing key; an explicit null prints as None."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(has(obj, key), F.coalesce(obj[key], F.lit("None"))).otherwise(fallback)


def truthy(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).isin("", "false", "0", "0.0", "{}", "[]", "null")


def ref_name(ref: Column) -> Column:
    return F.substring_index(ref, "/", -1)


def _indent_all(blobs: pd.Series) -> pd.Series:
    return blobs.map(
        lambda items: None
        if items is None
        else {blob: json.dumps(json.loads(blob), indent=2) for blob in items}
    )


def indented(blobs: Column) -> Column:
    """Two-space rendering of each JSON text in an array, keyed by that text.

    Marked nondeterministic only to keep the optimizer from pushing later
    filters below it, which would open the documents a second time.
    """
    udf = F.pandas_udf(_indent_all, T.MapType(T.StringType(), T.StringType())).asNondeterministic()
    return udf(blobs)
