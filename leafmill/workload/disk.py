"""Checks on a real tree: the derived files exported to the shared folder, listed, read and built."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import tablefunctions
from leafmill.plans import build as B
from leafmill.plans.incremental import conversions, tree_reader, update_conversions
from leafmill.session import scratch, written
from leafmill.sinks.versions import publish_version, read_published
from leafmill.sinks.writers import export_tree
from leafmill.sources import treesource
from leafmill.sources.tree import list_tree, read_contents, read_tasks
from leafmill.streaming.counts import category_counts, keep_counts
from leafmill.streaming.ingest import ingest, ingested
from leafmill.streaming.retractions import keep_changes, net
from leafmill.workload import extraction
from leafmill.workload import registry as G
from leafmill.workload.corpora import EXISTING
from leafmill.workload.registry import files, query

_ROOTS: dict[tuple[str, str], str] = {}
OPEN_PATHS = " WHERE NOT list_contains(string_split(rel_path, '/'), '.git')"


def _export(spark, sf, root):
    return written(export_tree(files(spark, sf).selectExpr("path AS dest_path", "content AS markdown"), root), "exported")


def tree(spark, sf) -> str:
    """The files on disk, exported once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ROOTS:
        root = scratch(spark, "checkout")
        _export(spark, sf, root)
        _ROOTS[key] = root
    return _ROOTS[key]


@query("tree_export", G.FILES + " SELECT path AS dest_path, length AS n_bytes FROM files")
def tree_export(spark, sf):
    return _export(spark, sf, scratch(spark, "checkout"))


@query("tree_listing", G.FILES + " SELECT repo_name, rel_path, length FROM files" + OPEN_PATHS)
def tree_listing(spark, sf):
    return list_tree(spark, tree(spark, sf)).select("repo_name", "rel_path", "length")


@query("tree_contents", G.FILES + " SELECT repo_name, rel_path, md5(content) AS content_md5 FROM files" + OPEN_PATHS)
def tree_contents(spark, sf):
    root = tree(spark, sf)
    manifest = written(list_tree(spark, root), "manifest")
    return read_contents(manifest, root, read_tasks(manifest)).select("repo_name", "rel_path", F.md5("content").alias("content_md5"))


def _profile(rows, *keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.sum("file_size").alias("n_bytes"))


@query("tree_corpus", G.RECORDS + " SELECT category, split, count(*) AS n_records, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM records GROUP BY 1, 2")
def tree_corpus(spark, sf):
    return _profile(B.build_from_tree(spark, tree(spark, sf), scratch(spark, "job")).standard, "category", "split")


@query("incremental_corpus", G.RECORDS + " SELECT category, split, count(*) AS n_records, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM records GROUP BY 1, 2")
def incremental_corpus(spark, sf):
    """The conversions of the Markdown files, then of all that came later; the corpus of both."""
    root, folder = tree(spark, sf), scratch(spark, "conversions")
    listing = written(list_tree(spark, root), "manifest")
    for files_now in (listing.filter("path LIKE '%.md'"), listing):
        update_conversions(B.plan_files(files_now), tree_reader(root), folder)
    return _profile(B.records_from_converted(conversions(spark, folder)), "category", "split")


@query("tree_rebuild", EXISTING + " SELECT category, count(*) AS n_records, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM records GROUP BY 1")
def tree_rebuild(spark, sf):
    return _profile(B.rebuild_existing(spark, tree(spark, sf), scratch(spark, "job")).standard, "category")


# --- the tree as a data source, committed sinks, table functions, streams ------------------

PLACED = G.FILES + f""", placed AS (SELECT *, '/' || rel_path AS p, regexp_extract(rel_path, '[^/]*$') AS name,
  list_filter(list_transform(string_split(rel_path, '/')[:-2], lambda x: lower(x)), lambda x: x IN ({G.TARGETS}))[1] AS category FROM files)"""
SOURCE_COLUMNS = "repo_name, rel_path, length, category, md5(content) AS content_md5"


def _source(spark, sf, **options):
    treesource.register(spark)
    return spark.read.format(treesource.NAME).options(**options).load(tree(spark, sf))


@query("tree_source", PLACED + f" SELECT {SOURCE_COLUMNS} FROM placed" + OPEN_PATHS)
def tree_source(spark, sf):
    folder = treesource.write_manifest(spark, tree(spark, sf), scratch(spark, "tree-manifest"), 1 << 20)
    rows = _source(spark, sf, manifest=folder).filter("NOT in_git")
    return rows.select("repo_name", "rel_path", "length", "category", F.md5("content").alias("content_md5"))


@query("tree_source_sql", PLACED + f""" SELECT {SOURCE_COLUMNS} FROM placed {OPEN_PATHS}
  AND suffix(rel_path, '.md') AND category IN ('docs', 'examples') AND repo_name <> 'src0' AND length > 100""")
def tree_source_sql(spark, sf):
    treesource.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW leafmill_files USING {treesource.NAME} OPTIONS (path '{tree(spark, sf)}', tasks '16')")
    return spark.sql(f"""SELECT {SOURCE_COLUMNS} FROM leafmill_files
      WHERE NOT in_git AND suffix = '.md' AND category IN ('docs', 'examples') AND repo_name <> 'src0' AND length > 100""")


@query("committed_tree", G.FILES + " SELECT path, length, md5(content) AS content_md5 FROM files")
def committed_tree(spark, sf):
    """The tree of half the files, then of all, in its place, then read back."""
    root = scratch(spark, "committed")
    made = files(spark, sf).selectExpr("path AS dest_path", "content AS markdown")
    treesource.commit_tree(made.filter("length(dest_path) % 2 = 0"), root)
    treesource.commit_tree(made, root)
    rows = spark.read.format(treesource.NAME).load(root)
    return rows.select(F.concat_ws("/", "repo_name", "rel_path").alias("path"), "length", F.md5("content").alias("content_md5"))


@query("published_versions", G.RAW + " SELECT category, count(*) AS n_records, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM records GROUP BY 1")
def published_versions(spark, sf):
    """A corpus published twice under one name; the second is what readers get."""
    root, records = scratch(spark, "versions"), G.raw_records(spark, sf).withColumn("split", F.lit("train"))
    publish_version(records.filter("category = 'docs'"), root, "corpus")
    publish_version(records, root, "corpus")
    return _profile(read_published(spark, root, "corpus"), "category")


@query("file_rows_functions", extraction.PY + " SELECT path, ordinal, name, return_type, docstring FROM documented")
def file_rows_functions(spark, sf):
    return _file_rows(spark, sf, ".py", "functions", "ordinal, name, return_type, docstring")


@query("file_rows_cells", G.FILES + """,
cells AS (SELECT path, c.value AS cell, row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS ordinal
  FROM files f, (SELECT value, rowid AS n FROM json_each(f.content, '$.cells')) c WHERE ext = 'ipynb')
SELECT path, ordinal, json_extract_string(cell, '$.cell_type') AS cell_type,
  CASE WHEN json_type(cell, '$.source') = 'ARRAY' THEN array_to_string(CAST(json_extract(cell, '$.source') AS VARCHAR[]), '')
       ELSE json_extract_string(cell, '$.source') END AS source FROM cells""")
def file_rows_cells(spark, sf):
    return _file_rows(spark, sf, ".ipynb", "cells", "ordinal, cell_type, source")


@query("file_rows_endpoints", extraction.SPECS + f""" SELECT path, endpoint_ordinal AS ordinal, method, endpoint,
  {extraction.get('d', 'summary')} AS summary, {extraction.get('d', 'description')} AS description FROM endpoints""")
def file_rows_endpoints(spark, sf):
    return _file_rows(spark, sf, ".json", "endpoints", "ordinal, method, endpoint, summary, description")


def _file_rows(spark, sf, suffix, kind, columns):
    tablefunctions.register(spark)
    G.of_type(spark, sf, suffix).createOrReplaceTempView("leafmill_typed")
    return spark.sql(f"SELECT path, {columns} FROM leafmill_typed, LATERAL file_rows(content, '{kind}')")


@query("source_totals", extraction.PY + """ SELECT repo_name, (SELECT count(*) FROM sources s WHERE s.repo_name = f.repo_name) AS n_files,
  count(*) AS n_functions FROM functions f GROUP BY repo_name""")
def source_totals(spark, sf):
    """Totals per repository, counted per salt so that a large one is not one task."""
    tablefunctions.register(spark)
    G.of_type(spark, sf, ".py").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(16))).createOrReplaceTempView("leafmill_sources")
    return spark.sql("""SELECT repo_name, sum(n_files) AS n_files, sum(n_functions) AS n_functions FROM
      source_totals(TABLE(SELECT repo_name, salt, content FROM leafmill_sources) PARTITION BY (repo_name, salt)) GROUP BY repo_name""")


@query("streamed_records", G.CONVERTED + f""" SELECT category, count(*) AS n_records, CAST(sum(strlen(markdown)) AS BIGINT) AS n_bytes FROM kept
  WHERE category <> 'other' AND NOT regexp_matches(rel_path, '(^|/)[._]') AND {G.documentation_sql('dest_path', 'markdown')} GROUP BY 1""")
def streamed_records(spark, sf):
    out = scratch(spark, "streamed")
    ingest(spark, tree(spark, sf), out, scratch(spark, "stream-checkpoint"), 1000).awaitTermination()
    return _profile(ingested(spark, out), "category")


@query("streamed_counts", G.ASSIGNED + """ SELECT repo_name, category, count(*) AS n_files, CAST(0 AS BIGINT) AS n_late FROM assigned
  WHERE category <> 'other' AND NOT regexp_matches(rel_path, '(^|/)[._]') GROUP BY 1, 2""")
def streamed_counts(spark, sf):
    out = scratch(spark, "streamed-counts")
    for started in keep_counts(spark, tree(spark, sf), out, scratch(spark, "counts-checkpoint")):
        started.awaitTermination()
    return category_counts(spark, out)


SHOWN = " NOT regexp_matches(rel_path, '(^|/)[._]')"


def _streamed_net(spark, sf, winners, *keys):
    out = scratch(spark, "streamed-changes")
    keep_changes(spark, tree(spark, sf), out, scratch(spark, "changes-checkpoint"), winners, 4000).awaitTermination()
    return net(spark, out, *keys)


@query("streamed_categories", G.ASSIGNED + " SELECT repo_name, category, path FROM assigned WHERE" + SHOWN)
def streamed_categories(spark, sf):
    return _streamed_net(spark, sf, False, "repo_name", "category", "path")


@query("streamed_winners", G.CONVERTED + f""" SELECT dest_path, path FROM (
    SELECT dest_path, path, row_number() OVER (PARTITION BY dest_path ORDER BY {G.extension('path')}, path) AS n FROM kept WHERE{SHOWN}) WHERE n = 1""")
def streamed_winners(spark, sf):
    return _streamed_net(spark, sf, True, "dest_path", "path")
