"""Which files are selected, under which category and destination.

Works on the slim file columns (``repo_name, rel_path, path`` and whatever else
the caller keeps); text is read afterwards, for the rows that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.joins import sized_join
from leafmill.schema import FALLBACK_CATEGORY, FILE_SUFFIXES, RESERVED_FOLDERS, TARGET_FOLDERS
from leafmill.session import written


def exclude_git(files: DataFrame) -> DataFrame:
    """Drop paths with a ``.git`` segment."""
    return files.filter(~F.array_contains(F.split("rel_path", "/"), ".git"))


def select_suffixes(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Keep file names with a wanted suffix, case-sensitively."""
    return files.filter(X.ends_with_any(F.col("rel_path"), suffixes or FILE_SUFFIXES))


def target_folders(rel_path: Column) -> Column:
    """Distinct target folders among the directory segments, in path order."""
    parts = F.split(rel_path, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    return F.array_distinct(F.filter(folders, lambda x: x.isin(TARGET_FOLDERS)))


def has_target_folder(rel_path: Column) -> Column:
    """The same question as a plain pattern, which is compiled and much cheaper."""
    return F.lower(rel_path).rlike(rf"(?:\A|/)(?:{'|'.join(TARGET_FOLDERS)})/")


def assign_categories(files: DataFrame) -> DataFrame:
    """One row per (file, category).

    A file below target folders appears under each distinct one. A repository
    without any target folder sends everything to ``other``. Whether it has one
    is decided on all its files, wanted suffix or not.

    The repositories with a target folder are found by a pre-aggregated distinct
    over slim columns, and written. All files are then joined with that table by
    its measured size, in one pass, so files that carry text stay where they are.
    """
    tagged = exclude_git(files)
    inside = has_target_folder(F.col("rel_path"))
    with_target = written(tagged.filter(inside).select("repo_name").distinct(), "targets").withColumn("_has", F.lit(True))
    flagged = sized_join(select_suffixes(tagged), with_target, ["repo_name"], "left", "path")
    categories = F.when(inside, target_folders(F.col("rel_path"))).when(F.col("_has").isNull(), F.array(F.lit(FALLBACK_CATEGORY)))
    return flagged.withColumn("category", F.explode(categories)).select(*files.columns, "category")


def path_in_category(rel_path: Column, category: Column) -> Column:
    """Segments after the first one equal to the category, else the base name."""
    parts = F.split(rel_path, "/")
    at = F.array_position(F.transform(parts, F.lower), category).cast("int")
    rest = F.array_join(F.slice(parts, at + 1, F.size(parts) - at), "/")
    return F.when((at > 0) & (at < F.size(parts)), rest).otherwise(X.basename(rel_path))


def with_path_in_category(files: DataFrame) -> DataFrame:
    return files.withColumn("rel_in_category", path_in_category(F.col("rel_path"), F.col("category")))


def destination_name(rel: Column, is_spec: Column) -> Column:
    """Name of the converted file."""
    ext = F.lower(X.extension(rel))
    return (
        F.when((ext == ".json") & is_spec, F.concat(X.stem(rel), F.lit("_api_spec.md")))
        .when(ext.isin(".ipynb", ".py"), F.concat(X.stem(rel), F.lit(".md")))
        .otherwise(X.basename(rel))
    )


def with_destination(files: DataFrame, is_spec: Column) -> DataFrame:
    """``dest_path`` = repo / category / folder inside the category / name."""
    folder = X.dirname(F.col("rel_in_category"))
    return files.withColumn(
        "dest_path",
        F.concat_ws(
            "/",
            "repo_name",
            "category",
            F.when(folder != "", folder),
            destination_name(F.col("rel_in_category"), is_spec),
        ),
    )


def collisions(converted: DataFrame) -> DataFrame:
    """Per destination the one source that is kept, and how many were not.

    A minimum over (suffix, source path), so it is combined before the shuffle
    and a destination shared by millions of files is still one small group.
    """
    rank = F.struct(F.lower(X.extension(F.col("path"))).alias("ext"), F.col("path"))
    return converted.groupBy("dest_path").agg(
        F.min(rank)["path"].alias("path"), (F.count(F.lit(1)) - 1).alias("losers")
    )


def collision_losers(converted: DataFrame) -> DataFrame:
    """``dest_path, path`` of every row that gives way to another one.

    The winners of real collisions are joined back by their measured number, so
    that one destination shared by very many sources stays spread out.
    """
    slim = converted.select("dest_path", "path")
    winners = collisions(slim).filter("losers > 0").select("dest_path", F.col("path").alias("_kept"))
    both = sized_join(slim, written(winners, "winners"), ["dest_path"], "inner", "path")
    return both.filter(F.col("path") != F.col("_kept")).select("dest_path", "path")


def drop_collision_losers(converted: DataFrame, losers: DataFrame | None = None) -> DataFrame:
    """Keep one row per destination. ``losers`` is a written table if given."""
    beaten = written(collision_losers(converted), "losers") if losers is None else losers
    return sized_join(converted, beaten, ["dest_path", "path"], "left_anti", "path")


def existing_outputs(files: DataFrame) -> DataFrame:
    """Files of an already converted tree ``<repo>/<category>/**``."""
    segments = F.split("rel_path", "/")
    return (
        files.filter(~F.col("repo_name").isin(RESERVED_FOLDERS))
        .withColumn("category", F.get(segments, F.lit(0)))
        .filter((F.size(segments) > 1) & F.col("category").isin([*TARGET_FOLDERS, FALLBACK_CATEGORY]))
    )


def count_by_category(assigned: DataFrame) -> DataFrame:
    """Files per (repository, category); empty groups do not appear."""
    return assigned.groupBy("repo_name", "category").agg(F.count(F.lit(1)).alias("n_files"))


def count_with_totals(assigned: DataFrame) -> DataFrame:
    """The same counts with per-repository and overall totals in one pass."""
    return assigned.rollup("repo_name", "category").agg(F.count(F.lit(1)).alias("n_files"))
