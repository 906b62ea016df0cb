"""The repository catalog: ``name, type, source, url, num_files``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.schema import TARGET_FOLDERS

CATALOG_COLUMNS = ["name", "type", "source", "url", "num_files"]


def repository_url(name: Column, url: Column) -> Column:
    """Explicit URL, else a URL made from the name."""
    return (
        F.when(F.coalesce(url, F.lit("")) != "", url)
        .when(name.contains("github.com") & name.startswith("http"), name)
        .when(name.contains("github.com"), F.concat(F.lit("https://"), name))
        .otherwise(F.concat(F.lit("https://github.com/"), name))
    )


def entered_url(entry: Column) -> Column:
    """URL for what a user typed: shorthand with a ``/`` is completed."""
    e = strip(entry)
    complete = e.startswith("http://") | e.startswith("https://") | ~e.contains("/")
    return (
        F.when(complete, e)
        .when(e.startswith("github.com/"), F.concat(F.lit("https://"), e))
        .otherwise(F.concat(F.lit("https://github.com/"), e))
    )


def url_segment(url: Column, from_end: int) -> Column:
    """Segment counted from the end, trailing slashes ignored."""
    return F.try_element_at(F.split(F.rtrim(url, F.lit("/")), "/"), F.lit(-from_end))


def full_name(url: Column) -> Column:
    return F.concat_ws("/", url_segment(url, 2), url_segment(url, 1))


def with_repository(catalog: DataFrame) -> DataFrame:
    """Add ``repo_url, full_name, short_name``."""
    located = catalog.withColumn("repo_url", repository_url(F.col("name"), F.col("url")))
    return located.withColumns(
        {"full_name": full_name(F.col("repo_url")), "short_name": url_segment(F.col("repo_url"), 1)}
    )


def infer_entry(name: Column) -> list[Column]:
    """Catalog columns for a typed name."""
    return [
        strip(name).alias("name"),
        F.when(strip(name).contains("/"), "repository").otherwise("organization").alias("type"),
        F.when(strip(name).contains("github.com"), "github").otherwise("huggingface").alias("source"),
        F.lit(None).cast("string").alias("url"),
        F.lit(0).cast("long").alias("num_files"),
    ]


def infer_entries(names: DataFrame, column: str = "name") -> DataFrame:
    return names.filter(strip(F.col(column)) != "").select(*infer_entry(F.col(column)))


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of name, type or source."""
    needle = F.lower(F.lit(query))
    hits = [F.contains(F.lower(F.col(c)), needle) for c in ("name", "type", "source")]
    return catalog.filter(reduce(lambda a, b: a | b, hits))


def append_if_absent(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Add entries whose (type, name), NULLs equal, is not in the catalog yet, each once."""
    a, b = new.dropDuplicates(["type", "name"]).alias("a"), catalog.alias("b")
    known = F.col("a.type").eqNullSafe(F.col("b.type")) & F.col("a.name").eqNullSafe(F.col("b.name"))
    return catalog.unionByName(a.join(b, known, "left_anti"), allowMissingColumns=True)


def remove(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop every row equal to one of ``gone`` in all columns, NULLs equal."""
    a, b = catalog.alias("a"), gone.alias("b")
    same = reduce(
        lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in catalog.columns]
    )
    return a.join(b, same, "left_anti")


def has_target_folder(folder_listing: DataFrame) -> DataFrame:
    """Per repository: does its top-level listing show a target folder?"""
    hit = (F.col("type") == "dir") & F.lower("name").isin(TARGET_FOLDERS)
    return folder_listing.groupBy("repo_name").agg(F.bool_or(hit).alias("has_target"))
