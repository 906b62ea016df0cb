"""The standard record: title, description, file facts, fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import text as X
from leafmill.functions.reuse import built_once
from leafmill.schema import DESCRIPTION_CHARS, RECORD_DEFAULTS


def title(content: Column, file_name: Column) -> Column:
    """First level-one heading, else the file name."""
    return F.coalesce(F.nullif(X.first_match(content, P.TITLE, 1, "m"), F.lit("")), file_name)


def description(content: Column) -> Column:
    """First paragraph below a leading heading, else the first 200 characters.

    The paragraph exists exactly if the text starts with ``#`` and something
    follows its first newline, which is cheaper to ask than to match.
    """
    newline = F.instr(content, "\n")
    has_paragraph = content.startswith("#") & (newline > 0) & (newline < F.length(content))
    return X.strip(
        F.when(has_paragraph, X.first_match(content, P.PARAGRAPH_AFTER_TITLE, 1, "s")).otherwise(
            F.substring(content, 1, DESCRIPTION_CHARS)
        )
    )


def file_type(path: Column) -> Column:
    ext = F.lower(X.extension(path))
    return F.when(ext != "", ext.substr(F.lit(2), F.length(ext))).otherwise("unknown")


@built_once
def _metadata() -> tuple[Column, dict[str, Column]]:
    readable = F.col("content").isNotNull()
    stamp = F.coalesce(F.when(readable, X.iso_time(F.col("modified"))), F.lit(""))
    return X.basename(F.col("file_path")), {
        "title": F.when(readable, title(F.col("content"), F.col("file_name"))).otherwise(F.col("file_name")),
        "description": F.when(readable, description(F.col("content"))).otherwise(""),
        "file_type": F.when(readable, file_type(F.col("file_path"))).otherwise("unknown"),
        "file_size": F.when(readable, F.col("size")).otherwise(F.lit(0)).cast("long"),
        "creation_date": stamp,
        "modification_date": stamp,
    }


def with_metadata(files: DataFrame) -> DataFrame:
    """Record columns from ``file_path, content, size, modified``.

    A row without text (it could not be read) keeps its name and gets defaults
    and the type ``unknown``.
    """
    name, others = _metadata()
    return files.withColumn("file_name", name).withColumns(others)


def standardise(records: DataFrame, compat_flags: bool = False) -> DataFrame:
    """Exactly the 14 record columns: defaults for missing ones, extras dropped.

    ``compat_flags`` reproduces the source tool's always-false type flags.
    """
    return records.select(*_standard(frozenset(records.columns), compat_flags))


@built_once
def _standard(present: frozenset[str], compat_flags: bool) -> list[Column]:
    columns = []
    for name, kind, default in RECORD_DEFAULTS:
        value = F.lit(default).cast(kind)
        lost = compat_flags and name in ("is_api_spec", "is_sdk_file")
        if name in present and not lost:
            value = F.coalesce(F.col(name).cast(kind), value)
        columns.append(value.alias(name))
    return columns


def union_records(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union of record sets from several roots."""
    result = first
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
