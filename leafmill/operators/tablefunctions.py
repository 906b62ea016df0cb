"""One file to many rows from SQL: Python table functions.

``file_rows(content, kind)`` is polymorphic: its columns follow from the literal ``kind``
(``functions``, ``classes``, ``cells`` or ``endpoints``), and it is called laterally::

    SELECT path, r.* FROM files, LATERAL file_rows(content, 'functions') r

``source_totals(TABLE(...) PARTITION BY ...)`` counts over the files of a partition in constant
memory; partition by a salt as well and add up where a repository is large.

Text that does not parse, other JSON than an object, and NULL give no row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from leafmill.functions import patterns as P
from leafmill.operators.pysource import find_classes, find_functions
from leafmill.schema import HTTP_METHODS

KINDS = {
    "functions": "ordinal int, name string, return_type string, docstring string, full_definition string",
    "classes": "ordinal int, name string, parents string, docstring string, n_methods int",
    "cells": "ordinal int, cell_type string, source string",
    "endpoints": "ordinal int, method string, endpoint string, summary string, description string",
}
_TYPES = {"int": IntegerType(), "long": LongType(), "string": StringType()}
_DOCSTRING = re.compile(P.DOCSTRING, re.DOTALL)


def _schema(columns: str) -> StructType:
    """From names and types; analysis runs where no session can read DDL."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


def _docstring(body: str) -> str:
    found = _DOCSTRING.search(body)
    return found[1].strip() if found else ""


def _object(content: str) -> dict:
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _shown(value) -> str:
    """A JSON value as text."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _joined(value) -> str | None:
    if isinstance(value, list):
        return "".join(_shown(v) for v in value if v is not None)
    return None if value is None or isinstance(value, dict) else _shown(value)


def functions(content: str):
    for f in find_functions(content):
        yield f["name"], f["returns"], _docstring(f["body"]), f["definition"]


def classes(content: str):
    for c in find_classes(content):
        yield c["name"], c["parents"], _docstring(c["body"]), len(c["methods"])


def cells(content: str):
    notebook = _object(content)
    found = notebook.get("cells")
    if found is None:
        found = [c for w in notebook.get("worksheets") or [] for c in w.get("cells") or []]
    for c in found:
        source = next((s for s in (_joined(c.get("source")), _joined(c.get("input"))) if s is not None), "")
        if c.get("cell_type") == "heading":
            yield "markdown", "#" * (c.get("level") or 1) + " " + source
        else:
            yield c.get("cell_type"), source


def endpoints(content: str):
    paths = _object(content).get("paths")
    for path, methods in paths.items() if isinstance(paths, dict) else ():
        for method, details in methods.items() if isinstance(methods, dict) else ():
            if method in HTTP_METHODS:
                details = details if isinstance(details, dict) else {}
                yield method.upper(), path, *(_shown(details.get(k, "")) for k in ("summary", "description"))


_ROWS = {"functions": functions, "classes": classes, "cells": cells, "endpoints": endpoints}


class FileRows:
    @staticmethod
    def analyze(content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"kind is a literal, one of {sorted(KINDS)}")
        return AnalyzeResult(schema=_schema(KINDS[kind.value]))

    def eval(self, content: str, kind: str):
        if content is not None:
            for ordinal, row in enumerate(_ROWS[kind](content)):
                yield ordinal, *row


class SourceTotals:
    """Over the rows of a partition by repository (and perhaps a salt): files, functions and classes."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or not {"repo_name", "content"} <= set(files.dataType.fieldNames()):
            raise ValueError("a table with columns repo_name and content is asked for")
        return AnalyzeResult(schema=_schema("repo_name string, n_files long, n_functions long, n_classes long"))

    def __init__(self):
        self.repo, self.files, self.functions, self.classes = None, 0, 0, 0

    def eval(self, row: Row):
        self.repo = row["repo_name"]
        self.files += 1
        if row["content"] is not None:
            self.functions += len(find_functions(row["content"]))
            self.classes += len(find_classes(row["content"]))

    def terminate(self):
        yield self.repo, self.files, self.functions, self.classes


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udtf.register("file_rows", udtf(FileRows))
    spark.udtf.register("source_totals", udtf(SourceTotals))
