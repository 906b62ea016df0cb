"""Per-type conversion of files to Markdown in one pass over the input.

One projection holds every route. The scanner for Python sources and the JSON
parsers get NULL for rows of other routes, so a file's text is only looked at
by its own converter and the input is read once, not once per route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.notebook import with_notebook_markdown
from leafmill.operators.openapi import with_api_markdown
from leafmill.operators.pysource import with_plain_python_markdown, with_python_markdown
from leafmill.operators.routing import with_route
from leafmill.operators.scan import with_destination
from leafmill.session import slim_batches

PASS_THROUGH = ["copy", "json"]
_STAGING = [
    "_api_text", "_nb_text", "_py_text", "_api_md", "_nb_md", "_py_md", "_api_md_ok", "_nb_md_ok",
    "file_name", "content",
]


def convert_files(files: DataFrame, plain_python: bool = False) -> DataFrame:
    """Add ``route, dest_path, markdown, size, is_api_spec, is_sdk_file, error``.

    Input: ``repo_name, category, path, rel_in_category, content, length``.
    ``markdown`` is NULL and ``error`` says why when a file has no conversion.
    """
    slim_batches(files.sparkSession)
    routed = with_route(files)

    def only(route: str):
        return F.when(F.col("route") == route, F.col("content"))

    staged = routed.withColumns(
        {
            "file_name": X.basename(F.col("path")),
            "_api_text": only("api"),
            "_nb_text": only("notebook"),
            "_py_text": only("python"),
        }
    )
    staged = with_api_markdown(staged, "_api_text", "_api_md")
    staged = with_notebook_markdown(staged, "_nb_text", "file_name", "_nb_md")
    to_python = with_plain_python_markdown if plain_python else with_python_markdown
    staged = to_python(staged, "_py_text", "file_name", "_py_md")
    markdown = (
        F.when(F.col("route") == "api", F.col("_api_md"))
        .when(F.col("route") == "notebook", F.col("_nb_md"))
        .when(F.col("route") == "python", F.col("_py_md"))
        .when(F.col("route").isin(PASS_THROUGH), F.col("content"))
    )
    converted = with_destination(staged, F.col("route") == "api").withColumn("markdown", markdown)
    return converted.withColumns(
        {
            # A copied file keeps its byte count, undecodable bytes included.
            "size": F.when(F.col("route").isin(PASS_THROUGH), F.col("length"))
            .otherwise(F.octet_length("markdown"))
            .cast("long"),
            "is_api_spec": F.col("route") == "api",
            "is_sdk_file": F.col("route") == "python",
            # From flags, not from the text: a filter on it stays cheap.
            "error": F.when(F.col("content").isNull(), "unreadable").when(
                (F.col("route") == "bad_json")
                | ((F.col("route") == "api") & ~F.col("_api_md_ok"))
                | ((F.col("route") == "notebook") & ~F.col("_nb_md_ok")),
                F.concat(F.lit("not convertible: "), F.col("route")),
            ),
        }
    ).drop(*_STAGING)


def count_routes(files: DataFrame) -> DataFrame:
    return with_route(files).groupBy("route").agg(F.count(F.lit(1)).alias("n_files"))


def conversion_errors(converted: DataFrame) -> DataFrame:
    return converted.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n_files"))
