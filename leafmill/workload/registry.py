"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import text as X
from leafmill.operators import scan as S
from leafmill.operators.metadata import with_metadata
from leafmill.schema import FILE_SUFFIXES, TARGET_FOLDERS
from leafmill.workload import fixture, golden

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


files = fixture.files


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_path_in_category(S.assign_categories(files(spark, sf_dir)))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as a record of its unconverted text; a map-only plan."""
    found = files(spark, sf_dir).withColumnsRenamed({"path": "file_path", "length": "size"})
    category = F.coalesce(F.get(S.target_folders(F.col("rel_path")), F.lit(0)), F.lit("other"))
    return with_metadata(found.withColumn("category", category))


def of_type(spark: SparkSession, sf_dir: str, *suffixes: str) -> DataFrame:
    return files(spark, sf_dir).filter(X.ends_with_any(F.col("path"), list(suffixes)))


# --- SQL for the check engine ------------------------------------------------------


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "") -> str:
    """A fixed pattern as an RE2 literal."""
    body = pattern.replace(r"\Z", r"\z")
    return quoted(f"(?{flags}){body}" if flags else body)


BASENAME = "regexp_extract({0}, '[^/]*$')"
EXTENSION = r"lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '[^.].*?(\.[^.]*)\z', 1))"
SPACE = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160))
TARGETS = ", ".join(quoted(t) for t in TARGET_FOLDERS)
SUFFIX = "(" + " OR ".join(f"suffix(rel_path, {quoted(s)})" for s in FILE_SUFFIXES) + ")"


def py_strip(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def basename(expr: str) -> str:
    return BASENAME.format(expr)


def extension(expr: str) -> str:
    return EXTENSION.format(expr)


def iso(expr: str) -> str:
    return (
        f"CASE WHEN microsecond({expr}) % 1000000 = 0 THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def title_sql(content: str, name: str) -> str:
    return f"coalesce(nullif(regexp_extract({content}, {rx(P.TITLE, 'm')}, 1), ''), {name})"


def description_sql(content: str) -> str:
    pattern = rx(P.PARAGRAPH_AFTER_TITLE, "s")
    return py_strip(
        f"CASE WHEN regexp_matches({content}, {pattern}) THEN regexp_extract({content}, {pattern}, 1) "
        f"ELSE substring({content}, 1, 200) END"
    )


FILES = "WITH " + fixture.files_cte("duckdb")

ASSIGNED = FILES + f""",
tagged AS (
  SELECT *, string_split(rel_path, '/') AS parts,
    list_distinct(list_filter(list_transform(string_split(rel_path, '/')[:-2], lambda x: lower(x)),
      lambda x: x IN ({TARGETS}))) AS targets
  FROM files WHERE NOT list_contains(string_split(rel_path, '/'), '.git')),
placed AS (
  SELECT * EXCLUDE (targets), unnest(targets) AS category FROM tagged WHERE len(targets) > 0 AND {SUFFIX}
  UNION ALL
  SELECT * EXCLUDE (targets), 'other' AS category FROM tagged
  WHERE len(targets) = 0 AND {SUFFIX}
    AND repo_name NOT IN (SELECT repo_name FROM tagged WHERE len(targets) > 0)),
assigned AS (
  SELECT *, CASE WHEN coalesce(pos, 0) > 0 AND pos < len(parts) THEN array_to_string(parts[pos + 1:], '/')
                 ELSE {basename('rel_path')} END AS rel_in_category
  FROM (SELECT *, list_position(list_transform(parts, lambda x: lower(x)), category) AS pos FROM placed))"""

ROUTE = f"""CASE {extension('path')}
      WHEN '.md' THEN 'copy' WHEN '.rst' THEN 'copy' WHEN '.txt' THEN 'copy'
      WHEN '.py' THEN 'python' WHEN '.ipynb' THEN 'notebook'
      WHEN '.json' THEN CASE WHEN NOT json_valid(content) THEN 'bad_json'
        WHEN list_has_any(json_keys(content), ['swagger', 'openapi', 'paths']) THEN 'api' ELSE 'json' END END"""

STEM = f"regexp_replace({basename('path')}, '\\.[^.]*$', '')"

CONVERTED = ASSIGNED + f""",
routed AS (
  SELECT a.*, d.text, d.n_chars, {ROUTE} AS route, {basename('path')} AS fname
  FROM assigned a JOIN documents d USING (doc_id)),
named AS (
  SELECT *, repo_name || '/' || category || '/' ||
      coalesce(nullif(regexp_extract(rel_in_category, '^(.*/)', 1), ''), '') ||
      CASE route WHEN 'api' THEN {STEM} || '_api_spec.md' WHEN 'python' THEN {STEM} || '.md'
                 WHEN 'notebook' THEN {STEM} || '.md' ELSE fname END AS dest_path,
    {golden.markdown_case()} AS markdown
  FROM routed),
kept AS (SELECT * FROM named WHERE markdown IS NOT NULL),
winners AS (
  SELECT * EXCLUDE (turn) FROM (
    SELECT *, row_number() OVER (PARTITION BY dest_path ORDER BY {extension('path')}, path) AS turn FROM kept)
  WHERE turn = 1)"""


def documentation_sql(path: str, content: str) -> str:
    marks = " OR ".join(f"contains({content}, {quoted(m)})" for m in ["# ", "## ", "```", "**", "__"])
    return (
        f"CASE WHEN suffix({path}, '.json') AND json_valid({content}) AND coalesce(list_has_any(json_keys("
        f"CASE WHEN json_valid({content}) THEN {content} END), "
        f"['swagger', 'openapi', 'paths', 'components', 'servers']), false) THEN false "
        f"WHEN {extension(path)} IN ('.md', '.rst', '.txt') THEN true ELSE ({marks}) END"
    )


def split_sql(source: str, path: str, ratio: float = 0.2, seed: int = 42) -> str:
    """``SELECT *, split`` over ``source`` by a plain window."""
    return f"""SELECT * EXCLUDE (turn, n), CASE WHEN turn <= greatest(1,
        floor(n * (CAST(1.0 AS DOUBLE) - CAST({ratio} AS DOUBLE)))) THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, category ORDER BY md5('{seed}:' || {path}), {path}) AS turn,
              CAST(count(*) OVER (PARTITION BY repo_name, category) AS DOUBLE) AS n FROM {source})"""


RECORDS = CONVERTED + f""",
split_rows AS ({split_sql('winners', 'dest_path')}),
records AS (
  SELECT {basename('dest_path')} AS file_name, dest_path AS file_path, repo_name, category,
    {title_sql('markdown', basename('dest_path'))} AS title,
    {description_sql('markdown')} AS description,
    coalesce(nullif(substring({extension('dest_path')}, 2), ''), 'unknown') AS file_type,
    CAST(strlen(markdown) AS BIGINT) AS file_size,
    {iso('modified')} AS creation_date, {iso('modified')} AS modification_date,
    markdown AS content, split, route = 'api' AS is_api_spec, route = 'python' AS is_sdk_file
  FROM split_rows WHERE {documentation_sql('dest_path', 'markdown')})"""

RAW = FILES + f""",
records AS (
  SELECT {basename('path')} AS file_name, path AS file_path, repo_name,
    coalesce(list_filter(list_transform(string_split(rel_path, '/')[:-2], lambda x: lower(x)),
      lambda x: x IN ({TARGETS}))[1], 'other') AS category,
    {title_sql('content', basename('path'))} AS title,
    {description_sql('content')} AS description,
    coalesce(nullif(substring({extension('path')}, 2), ''), 'unknown') AS file_type,
    length AS file_size, {iso('modified')} AS modification_date, content, ext
  FROM files)"""
