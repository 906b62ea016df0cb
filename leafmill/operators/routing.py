"""Predicates on files: route, specification, documentation, exclusion."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import jsontext as J
from leafmill.functions import text as X
from leafmill.functions.reuse import built_once
from leafmill.schema import EXCLUDED_GLOBS, MARKDOWN_MARKS, SPEC_DOC_KEYS, SPEC_ROUTE_KEYS

DOCUMENT_SUFFIXES = [".md", ".rst", ".txt"]


def is_api_spec(content: Column) -> Column:
    """JSON object with a specification key at the top level."""
    return J.has_any_key(content, SPEC_ROUTE_KEYS)


def route(path: Column, content: Column) -> Column:
    """``api``, ``json``, ``bad_json``, ``notebook``, ``python``, ``copy`` or NULL.

    Only ``.json`` rows look at the text.
    """
    ext = F.lower(X.extension(path))
    return (
        F.when(ext.isin(DOCUMENT_SUFFIXES), "copy")
        .when(ext == ".py", "python")
        .when(ext == ".ipynb", "notebook")
        .when(
            ext == ".json",
            F.when(J.checked(content).isNull(), "bad_json").when(J.keyed(content, SPEC_ROUTE_KEYS), "api").otherwise("json"),
        )
    )


def with_route(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("route", route(F.col(path), F.col("content")))


def is_documentation(path: Column, content: Column) -> Column:
    """Specification-like ``.json`` no; md/rst/txt yes; else a Markdown mark decides."""
    json_text = F.when(path.endswith(".json"), content)
    looks_like_spec = J.has_any_key(json_text, SPEC_DOC_KEYS)
    plain = F.lower(X.extension(path)).isin(DOCUMENT_SUFFIXES)
    marked = X.contains_any(content, MARKDOWN_MARKS)
    return F.coalesce(
        F.when(path.endswith(".json") & looks_like_spec, F.lit(False)).when(plain, True).otherwise(marked),
        F.lit(False),
    )


@built_once
def _documentation(path: str) -> Column:
    return is_documentation(F.col(path), F.col("content"))


def keep_documentation(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.filter(_documentation(path))


def is_existing_candidate(path: Column, content: Column) -> Column:
    """Inclusion rule for an already converted tree."""
    return X.ends_with_any(path, [".py", ".ipynb", ".md", ".rst", ".txt"]) | is_documentation(path, content)


def drop_failed(converted: DataFrame) -> DataFrame:
    """Failed conversions have no text and leave the job here."""
    return converted.filter(F.col("error").isNull())


def is_excluded(path: Column, globs: list[str] | None = None) -> Column:
    """Shell globs, matched against the whole relative path."""
    test = F.lit(False)
    for glob in globs or EXCLUDED_GLOBS:
        java = fnmatch.translate(glob).replace(r"\Z", r"\z")
        test = test | path.rlike(r"\A" + java)
    return test


def exclude_globs(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    return files.filter(~is_excluded(F.col("rel_path"), globs))
